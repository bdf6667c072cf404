"""Blanking of comments and string bodies, length-preserving so offsets stay valid.

One tokenising pattern splits a file into strings, comments and the rest; every token is
rewritten to the same length and the pieces are joined again. All of it is one expression
per file row: no shuffle and no user code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Strings and comments first, then runs of ordinary text, then any single character.
# Repeated groups are possessive: they cannot match differently, and the matcher then loops instead of
# recursing, so a string of any length is safe.
TOKENS = (
    r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
    r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
    r"|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
    r"|//[^\n]*"
    r"|/\*[\s\S]*?\*/"
    r"""|[^"'`/]+|[\s\S]"""
)
# Inside a template literal: value slots are kept, the text around them is blanked.
TEMPLATE_PARTS = r"\$\{[^}]*\}|[^$]+|\$"
VISIBLE = r"[^\n]"


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, VISIBLE, " ")


def _blank_token(token: Column) -> Column:
    first = F.substring(token, 1, 1)
    inner = F.substr(token, F.lit(2), F.length(token) - 2)
    quoted = F.concat(first, _blank(inner), first)
    template = F.concat(
        first,
        F.array_join(
            F.transform(
                F.regexp_extract_all(inner, F.lit(TEMPLATE_PARTS), F.lit(0)),
                lambda part: F.when(part.startswith("${"), part).otherwise(_blank(part)),
            ),
            "",
        ),
        first,
    )
    closed = F.length(token) >= 2
    return (
        F.when(token.startswith("//") | token.startswith("/*"), _blank(token))
        .when(closed & first.isin('"', "'"), quoted)
        .when(closed & (first == "`"), template)
        .otherwise(token)
    )


def blank_code(content: Column) -> Column:
    """``content`` with comments and string bodies replaced by blanks; line breaks stay."""
    tokens = F.regexp_extract_all(content, F.lit(TOKENS), F.lit(0))
    return F.array_join(F.transform(tokens, _blank_token), "")

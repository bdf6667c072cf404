"""Rules are data: each one names a shape, a text, patterns and the metadata of its issues.

Two shapes cover most rules. A ``LineRule`` is a conjunction of tests on one line. A
``MatchRule`` yields one issue per match of a pattern over a whole file, so it may
span lines. Patterns are written without look-around or back-references where the
meaning allows, so that the same text runs on any engine with linear-time matching.
"""

from __future__ import annotations

from dataclasses import dataclass

from lintlake.schema import IMPACT

# File extensions per rule family.
JS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
TS = ("ts", "tsx")
REACT = ("tsx", "jsx")
WEB_JS = ("ts", "tsx", "js", "jsx")
WEB_PY = ("py",)


def word_without(starts: tuple[str, ...]) -> str:
    """A pattern of the words that begin with none of ``starts``, written without look-ahead.

    A word leaves the tree of the given beginnings at some letter: after each proper beginning comes another letter or the end.
    """
    parts = []
    for head in sorted({s[:k] for s in starts for k in range(len(s))}):
        if any(head.startswith(s) for s in starts):
            continue
        following = "".join(sorted({s[len(head)] for s in starts if s.startswith(head)}))
        rest = rf"[^\W{following}]\w*"
        parts.append(rf"{head}(?:{rest})?" if head else rest)
    return f"(?:{'|'.join(parts)})"


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    category: str
    severity: str
    confidence: int
    description: str
    impact: int | None = None
    engine: str = "regex"
    profile: str = "static"

    @property
    def effective_impact(self) -> int:
        return IMPACT[self.severity] if self.impact is None else self.impact


@dataclass(frozen=True)
class LineRule(Rule):
    """``has`` and ``lacks`` are ``(input, pattern)`` pairs; ``where`` names predicates of the line table."""

    family: str = "js"
    has: tuple = ()
    lacks: tuple = ()
    where: tuple = ()
    column: tuple = ("const", 0)
    end: str = "line"


@dataclass(frozen=True)
class MatchRule(Rule):
    """One issue per match of ``pattern`` over ``text`` (``content`` or ``code``).

    ``skip`` drops a leading part of the hit from the reported position; ``name_group`` puts a
    captured name into the title; ``hit_lacks``, ``raw_has``, ``raw_lacks`` and ``before_lacks``
    test the hit, the same stretch of the raw text and the text before it; ``nth`` keeps only the
    n-th match of a file; ``contexts`` limits the path kinds the rule applies to.
    """

    exts: tuple | None = None
    pattern: str = ""
    text: str = "content"
    skip: str | None = None
    name_group: int | None = None
    hit_lacks: str | None = None
    name_has: str | None = None
    name_lacks: str | None = None
    raw_has: str | None = None
    raw_lacks: str | None = None
    before_lacks: str | None = None
    nth: int | None = None
    contexts: tuple | None = None

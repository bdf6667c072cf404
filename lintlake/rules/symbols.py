"""Symbols, imports and exports of script files, read lexically."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.bind import pin
from lintlake.functions.paths import dot_extension
from lintlake.rules.lexer import blank_code
from lintlake.rules.matches import match_lines, match_offsets
from lintlake.rules.spans import IDENT, line_at, line_starts, structure
from lintlake.rules.spec import JS

VARIABLE = rf"(?m)^[ \t]*(?:export\s+)?(?:const|let|var)\s+({IDENT})"
TYPE_ALIAS = rf"(?m)^[ \t]*(?:export\s+)?type\s+({IDENT})\s*(?:<[^=\n]*>)?\s*="
DECLARED_FUNCTION = rf"\bfunction\s*\*?\s*({IDENT})"
IMPORT_STATEMENT = r"""(?m)^[ \t]*import\s+(?:type\s+)?(?:([\w$\s{},*]+?)\s+from\s+)?['"]([^'"\n]+)['"]"""
EXPORT_DECLARATION = (
    rf"(?m)^[ \t]*export\s+(default\s+)?(?:abstract\s+)?(?:async\s+)?"
    rf"(function|class|interface|type|enum|const|let|var)\s*\*?\s*({IDENT})"
)
EXPORT_LIST = r"\bexport\s*\{([^}]*)\}"
EXPORT_DEFAULT = rf"(?m)^[ \t]*export\s+default\s+({IDENT})[ \t]*;"


def _scripts(files: DataFrame) -> DataFrame:
    picked = files.select("project_id", "path", "content", dot_extension(F.col("path")).alias("ext"))
    return picked.where(F.col("ext").isin(*["." + e for e in JS]))


def _at(m: Column) -> Column:
    """Line of the first character of a hit that is not white space."""
    return line_at(m["offset"] + F.length(F.regexp_extract(m["hit"], r"^\s*", 0)))


def symbols(files: DataFrame) -> DataFrame:
    """``(project_id, path, name, kind, line_start, line_end, exported)`` per declared symbol."""
    base = structure(files, kinds=("function", "method", "class", "interface", "enum"))
    base = pin(
        base,
        variables=match_lines("code", VARIABLE, 1),
        aliases=match_lines("code", TYPE_ALIAS, 1),
        classes=F.filter("blocks", lambda b: b["kind"] == "class"),
    )
    row = lambda name, kind, start, end, exported: F.struct(
        name.alias("name"), kind.alias("kind"), start.alias("line_start"), end.alias("line_end"),
        exported.alias("exported"),
    )

    def from_block(b: Column) -> Column:
        owners = F.filter(
            "classes", lambda c: (c["line_start"] < b["line_start"]) & (b["line_start"] <= c["line_end"])
        )
        owner = F.array_max(F.transform(owners, lambda c: F.struct(c["line_start"], c["name"].alias("name"))))
        name = F.when(b["kind"] == "method", F.concat(owner["name"], F.lit("."), b["name"])).otherwise(b["name"])
        kind = F.when(b["kind"] == "method", "function").otherwise(b["kind"])
        return row(name, kind, b["line_start"], b["line_end"], b["exported"])

    declared = F.filter(
        "blocks",
        lambda b: b["kind"].isin("class", "interface", "enum", "method")
        | ((b["kind"] == "function") & F.get("lines", b["line_start"]).rlike(DECLARED_FUNCTION)),
    )
    from_match = lambda kind: lambda m: row(
        m["name"], kind(m), m["line"], m["line"], m["hit"].rlike(r"^\s*export\b")
    )
    found = F.concat(
        F.transform(declared, from_block),
        F.transform(
            "variables",
            from_match(lambda m: F.when(m["hit"].rlike(r"\bconst\b"), "constant").otherwise("variable")),
        ),
        F.transform("aliases", from_match(lambda m: F.lit("type"))),
    )
    return base.select("project_id", "path", F.explode(found).alias("s")).select("project_id", "path", "s.*").where(
        F.col("name").isNotNull()
    )


def imports(files: DataFrame) -> DataFrame:
    """One row per import statement with its module and the local names it binds."""
    base = pin(_scripts(files), found=match_offsets("content", IMPORT_STATEMENT, 0, 2), lines=F.split("content", "\n", -1))
    base = pin(base, line_starts=line_starts("lines"))
    rows = base.select("project_id", "path", F.posexplode(
        F.transform("found", lambda m: m.withField("line", _at(m)))
    ).alias("position", "m"))
    clause = F.regexp_extract("m.hit", IMPORT_STATEMENT, 1)
    named = F.regexp_extract(clause, r"\{([^}]*)\}", 1)
    local = F.transform(F.split(named, ","), lambda p: F.regexp_extract(p, rf"({IDENT})\s*$", 1))
    outside = F.regexp_replace(clause, r"\{[^}]*\}|\*\s+as\s+[\w$]+", "")
    return rows.select(
        "project_id",
        "path",
        "position",
        F.col("m.line").alias("line"),
        F.col("m.name").alias("module"),
        F.col("m.name").startswith(".").alias("is_relative"),
        F.regexp_extract(outside, IDENT, 0).alias("default_import"),
        F.regexp_extract(clause, rf"\*\s+as\s+({IDENT})", 1).alias("namespace_import"),
        F.filter(local, lambda n: n != "").alias("named_imports"),
    )


def exports(files: DataFrame) -> DataFrame:
    """One row per exported name with its kind and whether it is the default export."""
    base = pin(_scripts(files), code=blank_code(F.col("content")))
    base = pin(
        base,
        declared=match_offsets("code", EXPORT_DECLARATION, 0, 3),
        listed=F.regexp_extract_all("code", F.lit(EXPORT_LIST), F.lit(1)),
        defaults=F.regexp_extract_all("code", F.lit(EXPORT_DEFAULT), F.lit(1)),
    )
    kind = lambda hit: F.regexp_extract(hit, EXPORT_DECLARATION, 2)
    row = lambda name, kind, default: F.struct(name.alias("name"), kind.alias("kind"), default.alias("is_default"))
    by_declaration = F.transform(
        "declared",
        lambda m: row(
            m["name"],
            F.when(kind(m["hit"]) == "const", "constant").when(kind(m["hit"]).isin("let", "var"), "variable")
            .otherwise(kind(m["hit"])),
            F.regexp_extract(m["hit"], EXPORT_DECLARATION, 1) != "",
        ),
    )
    names = F.flatten(F.transform("listed", lambda l: F.transform(
        F.split(l, ","), lambda p: F.regexp_extract(p, rf"({IDENT})\s*$", 1))))
    by_list = F.transform(F.filter(names, lambda n: n != ""), lambda n: row(n, F.lit("variable"), F.lit(False)))
    by_default = F.transform("defaults", lambda n: row(n, F.lit("variable"), F.lit(True)))
    return base.select(
        "project_id", "path", F.explode(F.concat(by_declaration, by_list, by_default)).alias("e")
    ).select("project_id", "path", "e.*")

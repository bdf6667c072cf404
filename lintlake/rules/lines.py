"""Line rules: one pass over the lines of a file family, one generator for all of its rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lintlake.functions.bind import let
from lintlake.functions.paths import basename, daemon_context, dot_extension, is_cli_script, language_of, web_context
from lintlake.functions.text import trimmed
from lintlake.rules.matches import rule_literals
from lintlake.rules.needs import holds_any, needed
from lintlake.rules.registry import LINE_RULES
from lintlake.rules.spec import JS, LineRule

MAX_LINE_LENGTH = 120
LOOKAHEAD = 5

# Extension -> family, and the languages left to external tools.
FAMILY_EXTENSIONS = {
    "sql": ("sql",),
    "json": ("json", "jsonc"),
    "yaml": ("yaml", "yml"),
    "markdown": ("md", "markdown"),
    "shell": ("sh", "bash", "zsh"),
    "style": JS,
}
DELEGATED = (
    "py", "pyi", "pyw", "rb", "java", "go", "cs", "rs", "php", "swift", "kt", "scala", "lua", "r",
    "c", "cpp", "cc", "h", "hpp",
)
SCRIPT_WORDS = ("function ", "const ", "import ")
STRINGS = "|".join(rf"{q}[^{q}\\]*+(?:\\.[^{q}\\]*+)*+{q}" for q in ('"', "'", "`"))
CONSOLE = r"console\.(log|debug|info|warn|error|trace)\s*\("


def family_of(path: Column, content: Column) -> Column:
    """The rule family of a file; unknown extensions count as scripts when they look like one."""
    ext = dot_extension(path)
    out = F.when((F.lower(basename(path)) == "dockerfile") | (ext == ".dockerfile"), "docker")
    for family, exts in FAMILY_EXTENSIONS.items():
        out = out.when(ext.isin(*["." + e for e in exts]), family)
    looks_like_script = reduce(lambda a, b: a | b, [content.contains(w) for w in SCRIPT_WORDS])
    plain = ext.isin("", *["." + e for e in DELEGATED])
    return out.when(~plain & looks_like_script, "style")


def _guards() -> dict[str, Column]:
    line, trim = F.col("line"), F.col("trim")
    console = line.rlike(CONSOLE)
    production = F.col("context") == "production-web"
    excused = trim.rlike(r"^(?:import|export)[ {]") | line.rlike(r"(https?://|www\.)")
    over = F.length(line) > F.col("max_length")
    g1 = ~(over & excused)
    g2 = g1 & ~(console & F.col("is_script"))
    g3 = g2 & ~(console & line.rlike(r"console\.error") & ~production)
    g4 = g3 & ~(line.rlike(r"\bdebugger\b") & trim.rlike(r"^(?://|/\*|\*)"))
    in_string = F.exists(F.regexp_extract_all(line, F.lit(STRINGS), F.lit(0)), lambda s: s.contains("debugger"))
    return {
        "guard1": g1,
        "guard3": g3,
        "guard4": g4,
        "over_length": over,
        "shipped_context": F.col("context").isin("production-web", "test"),
        "tool_context": F.col("context").isin("daemon-service", "build-script"),
        "debugger_outside_strings": ~in_string,
        "no_quote_before_equality": ~F.right(F.substring_index(line, "==", 1), F.lit(5)).rlike("""['"`]"""),
        "web_production": F.col("web_context") == "production-web",
        "not_web_production": F.col("web_context") != "production-web",
        "web_async_context": ~F.col("web_context").isin("daemon-service", "build-script"),
        "first_line": F.col("line_no") == 0,
        "docker_code": (F.col("trim") != "") & ~F.col("trim").startswith("#"),
        "no_where_ahead": ~F.col("where_after"),
    }


def _inputs() -> dict[str, Column]:
    line = F.col("line")
    return {
        "line": line,
        "trim": F.col("trim"),
        "ahead": F.col("ahead"),
        "first_tag": F.regexp_extract(line, r"(?i)//\s*(TODO|FIXME|HACK|XXX)", 1),
        "first_console": F.regexp_extract(line, r"\bconsole\.(log|debug|info|warn|error)\s*\(", 1),
    }


def _condition(rule: LineRule, inputs: dict, guards: dict) -> Column:
    tests = [inputs[name].rlike(p) for name, p in rule.has]
    tests += [~inputs[name].rlike(p) for name, p in rule.lacks]
    tests += [guards[name] for name in rule.where]
    return reduce(and_, tests)


def _column(rule: LineRule) -> Column:
    kind, value = rule.column
    if kind == "regex":
        return F.length(F.get(F.split(F.col("line"), value, 2), F.lit(0)))
    if kind == "max_length":
        return F.col("max_length")
    return F.lit(value)


def _end(rule: LineRule) -> Column:
    if rule.end == "trim":
        return F.length("trim")
    if rule.end == "indent":
        return F.length(F.regexp_extract("line", r"^(\s*)", 1))
    return F.lit(0) if rule.end == "zero" else F.length("line")


WEB_FAMILIES = {
    "web-js": ("javascript", "typescript"),
    "web-js-py": ("javascript", "typescript", "python"),
}


def _web_family(family: str, web: Column | None) -> Column:
    named = F.col("language").isin(*WEB_FAMILIES[family])
    return named if web is None else named & web


def _may_hold(rule: LineRule) -> Column | None:
    """A short look at a ``line`` before the searches: False where the rule surely finds nothing, None where only they tell."""
    line, looks = F.col("line"), []
    for name, pattern in rule.has:
        # What these inputs hold, the line holds.
        if name in ("line", "trim", "first_tag") and (found := needed(pattern)) is not None:
            looks.append(holds_any(line, found))
        if name == "first_tag":
            looks.append(line.contains("//"))
    looks += [look for guard, look in (("over_length", F.length(line) > F.col("max_length")), ("first_line", F.col("line_no") == 0)) if guard in rule.where]
    return reduce(and_, looks) if looks else None


def worth_testing(rules: Sequence[LineRule], web: Column | None = None) -> Column:
    """Lines that some rule of their family may find something in."""
    wanted = []
    for family in dict.fromkeys(r.family for r in rules):
        looks = [_may_hold(r) for r in rules if r.family == family]
        here = _web_family(family, web) if family in WEB_FAMILIES else F.col("family") == family
        wanted.append(here & reduce(or_, looks) if all(look is not None for look in looks) else here)
    return reduce(or_, [F.coalesce(w, F.lit(False)) for w in wanted])


def file_lines(files: DataFrame, families: Sequence[str], max_length: int = MAX_LINE_LENGTH, web: Column | None = None,
               worth: Column | None = None) -> DataFrame:
    """The lines of all files that some family wants, in one pass, with the columns rules test; with ``worth`` those that hold this test.

    SQL lines also carry the lines ahead and whether a WHERE follows; both are computed inside
    the file row before it is exploded, so no window over the file is needed.
    """
    picked = files.select(
        "project_id",
        "path",
        "content",
        family_of(F.col("path"), F.col("content")).alias("family"),
        language_of(F.col("path")).alias("language"),
        daemon_context(F.col("path")).alias("context"),
        web_context(F.col("path")).alias("web_context"),
        is_cli_script(F.col("path")).alias("is_script"),
        F.lit(max_length).alias("max_length"),
    )
    wanted = F.col("family").isin(*[f for f in families if f not in WEB_FAMILIES])
    for family in families:
        if family in WEB_FAMILIES:
            wanted = wanted | _web_family(family, web)
    content, is_sql = F.col("content"), F.col("family") == "sql"
    lines = F.split(content, "\n", -1)

    def look(all_lines: Column, upper: Column) -> Column:
        ahead = lambda i: F.array_join(F.slice(all_lines, i + 1, F.lit(LOOKAHEAD)), "\n")
        rest = lambda x: F.substr(upper, F.instr(upper, F.upper(x)))
        return F.transform(
            all_lines,
            lambda x, i: F.struct(
                F.when(x.rlike(r"(?i)ORDER\s+BY"), ahead(i)).alias("ahead"),
                F.when(x.rlike(r"(?i)\b(UPDATE|DELETE)\b"), F.contains(rest(x), F.lit("WHERE")))
                .otherwise(False)
                .alias("where_after"),
            ),
        )

    named = picked.where(wanted)
    of_file = ["project_id", "path", "family", "language", "context", "web_context", "is_script", "max_length"]
    ahead, after = F.lit(None).cast("string"), F.lit(False)
    if "sql" in families:
        named = named.withColumn("looked", F.when(is_sql, let(lines, lambda ls: let(F.upper(content), lambda up: look(ls, up)))))
        of_file.append("looked")
        seen = F.get("looked", F.col("line_no"))
        ahead, after = F.when(is_sql, seen["ahead"]), F.when(is_sql, seen["where_after"]).otherwise(False)
    rows = named.select(*of_file, F.posexplode(lines).alias("line_no", "line")).withColumns({"ahead": ahead, "where_after": after}).drop("looked")
    return (rows if worth is None else rows.where(worth)).withColumn("trim", trimmed(F.col("line")))


LINE_HIT = T.StructType(
    [T.StructField("ord", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("end", T.IntegerType())]
)


def line_issues(
    files: DataFrame, rules: Sequence[LineRule] = LINE_RULES, max_length: int = MAX_LINE_LENGTH, web: Column | None = None
) -> DataFrame:
    """Issues of all line ``rules`` from one scan, one line generator and one hit generator.

    ``web``, a test of the ``path``, limits the files that the rules of the web profile look at.
    """
    rules = list(rules)
    families = list(dict.fromkeys(r.family for r in rules))
    inputs, guards = _inputs(), _guards()
    none = F.array().cast(T.ArrayType(LINE_HIT))

    def tests(family: str) -> Column:
        hits = [
            F.when(
                _condition(rule, inputs, guards),
                F.struct(F.lit(i).alias("ord"), _column(rule).alias("col"), _end(rule).alias("end")).cast(LINE_HIT),
            )
            for i, rule in enumerate(rules)
            if rule.family == family
        ]
        return F.array_compact(F.array(*hits))

    groups = []
    by_family = [f for f in families if f not in WEB_FAMILIES]
    if by_family:
        chain = reduce(
            lambda acc, f: acc.when(F.col("family") == f, tests(f)),
            by_family[1:],
            F.when(F.col("family") == by_family[0], tests(by_family[0])),
        )
        groups.append(chain.otherwise(none))
    for family in families:
        if family in WEB_FAMILIES:
            groups.append(F.when(_web_family(family, web), tests(family)).otherwise(none))
    hits = file_lines(files, families, max_length, web, worth_testing(rules, web)).select(
        "project_id", "path", "line_no", "trim",
        F.explode(F.concat(*groups) if len(groups) > 1 else groups[0]).alias("h"),
    )
    meta = F.get(rule_literals(rules), F.col("h.ord"))
    return hits.select(
        "project_id",
        F.col("path").alias("file_path"),
        meta["rule_id"].alias("rule_id"),
        F.col("h.ord").alias("ord"),
        F.col("line_no").alias("line_start"),
        F.col("h.col").alias("col_start"),
        F.col("line_no").alias("line_end"),
        F.col("h.end").alias("col_end"),
        meta["title"].alias("title"),
        meta["description"].alias("description"),
        meta["category"].alias("category"),
        meta["severity"].alias("severity"),
        meta["confidence"].alias("confidence"),
        meta["impact"].alias("impact"),
        F.col("trim").alias("code_snippet"),
        F.lit("static").alias("source"),
        meta["engine"].alias("engine"),
    )

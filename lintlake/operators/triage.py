"""From raw findings to reported issues: dedupe, suppress, merge, remap, override, prioritise."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from lintlake.functions.text import base_rule_id
from lintlake.schema import OLD_SEVERITY, PRIORITY_CATEGORY, PRIORITY_SEVERITY, SEVERITIES, lookup, severity_rank

# ------------------------------------------------------------------ first wins
SCAN_KEY = ("file_path", "line_start", "col_start", "category", "severity", "title")


def title_key(width: int) -> Column:
    return F.substring(F.lower("title"), 1, width)


def keep_first(df: DataFrame, keys: Sequence, order: Sequence) -> DataFrame:
    """The first row per key in a total order.

    ``row_number() = 1`` is pushed below the shuffle as a per-task limit, so a key that holds a large
    share of the rows sends one candidate per task and never gathers in one place.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedupe_scan(issues: DataFrame, order: Sequence, scope: Sequence[str] = ("project_id",)) -> DataFrame:
    return keep_first(issues, [*scope, *SCAN_KEY], order)


def dedupe_tools(issues: DataFrame, order: Sequence, scope: Sequence[str] = ("project_id", "file_path")) -> DataFrame:
    return keep_first(issues, [*scope, "line_start", "category", title_key(30)], order)


def merge_sources(first: DataFrame, second: DataFrame, order: Sequence,
                  scope: Sequence[str] = ("project_id", "file_path")) -> DataFrame:
    """All of ``first``, and of ``second`` whatever it adds by (line, category, title start).

    The keys of ``first`` are made distinct before the anti join.
    """
    key = [*scope, "line_start", "category", "_title"]
    seen = first.withColumn("_title", title_key(20)).select(*key).distinct()
    fresh = second.withColumn("_title", title_key(20)).join(seen, key, "left_anti")
    return first.unionByName(keep_first(fresh, key, order).drop("_title").select(*first.columns))


def select_sources(issues: DataFrame, mode: str = "both") -> DataFrame:
    """Analysis mode ``both``, ``external`` or ``internal`` (built-in rules)."""
    if mode == "both":
        return issues
    return issues.where((F.col("source") == "external") == F.lit(mode == "external"))


# ------------------------------------------------------------------ suppression
_LIST = r"([a-zA-Z0-9\-_,\s*]+)"


def directives(files: DataFrame, marker: str = "lint") -> DataFrame:
    """Suppression comments as ``(project_id, file_path, rule, line)``; line -1 covers the file.

    ``// <marker>-ignore: a, b`` acts on its own line, ``// <marker>-ignore-next-line: a`` on the next
    and ``/* <marker>-ignore-file: a */`` on the whole file; ``*`` stands for every rule.
    """
    forms = (
        (rf"//\s*{marker}-ignore:\s*{_LIST}", lambda i: i),
        (rf"//\s*{marker}-ignore-next-line:\s*{_LIST}", lambda i: i + 1),
        (rf"/\*\s*{marker}-ignore-file:\s*{_LIST}\s*\*/", lambda i: F.lit(-1)),
    )
    lines = files.where(F.col("content").contains(f"{marker}-ignore")).select(
        "project_id", F.col("path").alias("file_path"), F.posexplode(F.split("content", "\n", -1)).alias("no", "text")
    )
    found = F.array(
        *[F.struct(F.regexp_extract("text", p, 1).alias("rules"), line(F.col("no")).alias("line")) for p, line in forms]
    )
    each = lines.select("project_id", "file_path", F.explode(found).alias("d"))
    split = each.select(
        "project_id", "file_path", F.col("d.line").alias("line"), F.explode(F.split("d.rules", ",")).alias("rule")
    )
    clean = F.regexp_replace("rule", r"^\s+|[\s/*]+$", "")
    star = F.trim("rule").startswith("*")
    return split.withColumn("rule", F.when(star, "*").otherwise(clean)).where("rule <> ''").distinct()


def suppress(issues: DataFrame, rules: DataFrame) -> DataFrame:
    """Issues no directive covers.

    The directives of a file are gathered first (they are bounded by the file's lines), so the issues
    are joined once, by file; rule, wildcard, line and file level are tested inside the row.
    """
    per_file = rules.groupBy("project_id", "file_path").agg(F.collect_set(F.struct("rule", "line")).alias("_rules"))
    rule, line = base_rule_id(F.col("issue_id")), F.col("line_start")
    covered = F.exists(
        "_rules",
        lambda d: ((d["rule"] == "*") | (d["rule"] == rule)) & ((d["line"] == -1) | (d["line"] == line)),
    )
    joined = issues.join(per_file, ["project_id", "file_path"], "left")
    return joined.where(~F.coalesce(covered, F.lit(False))).drop("_rules")


# ------------------------------------------------------------------ remapping
# Ordered patterns on rule id or title and the severity each one sets.
REMAP_RULES = (
    ("sql-delete-no-where", "BLOCKER"),
    ("sql-update-no-where", "BLOCKER"),
    ("useExhaustiveDependencies", "CRITICAL"),
    ("noArrayIndexKey", "MAJOR"),
    ("noGlobalIsNan", "MAJOR"),
    ("noExplicitAny", "MAJOR"),
    ("noImplicitAnyLet", "MAJOR"),
    ("noNonNullAssertion", "MAJOR"),
    ("useNumberNamespace", "MINOR"),
    ("noInferrableTypes", "INFO"),
    ("useArrowFunction", "INFO"),
    ("noForEach", "INFO"),
    ("useTemplate", "INFO"),
    ("useImportType", "INFO"),
    ("lint/style", "INFO"),
    ("lint/suspicious/noDoubleEquals", "MINOR"),
    ("internalError/io", "CRITICAL"),
)
JUSTIFIABLE = "useExhaustiveDependencies"
CRITICAL_PATHS = ("/supabase/", "/migrations/", "/stores/", "/services/")
COMPLEXITY = r"(?i)complexity|cyclomatic|cognitive"


def _mapped() -> Column:
    """Severity set by the first matching pattern, before modifiers; null when none matches."""
    out = None
    for pattern, severity in REMAP_RULES:
        test = F.col("issue_id").rlike(f"(?i){pattern}") | F.col("title").rlike(f"(?i){pattern}")
        if pattern == JUSTIFIABLE:
            justified = F.col("code_snippet").contains("eslint-disable") | F.lower("description").contains("justified")
            test = test & ~justified
        out = F.when(test, severity) if out is None else out.when(test, severity)
    number = lambda column, pattern: F.regexp_extract(column, pattern, 1)
    stated, last = r"(?i)complexity[:\s]+(\d+)", r"(\d+)[^\d]*$"
    found = F.coalesce(
        *[
            F.when(number(c, p) != "", number(c, p))
            for p, c in ((stated, "description"), (stated, "title"), (last, "description"), (last, "title"))
        ],
        F.lit("0"),
    ).try_cast("long")
    graded = F.when(found >= 40, "CRITICAL").when(found >= 25, "MAJOR").otherwise("MINOR")
    is_complex = F.col("title").rlike(COMPLEXITY) | F.col("issue_id").rlike(COMPLEXITY)
    return out.when(is_complex, graded)


def remap(issues: DataFrame, mode: str = "observed") -> DataFrame:
    """Rule-based severities with the down- and upgrade modifiers.

    In the ``observed`` mode the upgrade lowers a severity by one step, as the reference does; the
    ``intended`` mode raises it, up to CRITICAL. Modifiers act only where a rule matched. Adds
    ``mapped_severity`` (before modifiers), ``old_severity`` and keeps ``original_severity``.
    """
    down = {s: SEVERITIES[min(i + 1, 4)] for i, s in enumerate(SEVERITIES)}
    if mode == "observed":
        up = {"CRITICAL": "MAJOR", "MAJOR": "MINOR", "MINOR": "INFO", "INFO": "INFO", "BLOCKER": "BLOCKER"}
    elif mode == "intended":
        up = {"CRITICAL": "CRITICAL", "MAJOR": "CRITICAL", "MINOR": "MAJOR", "INFO": "MINOR", "BLOCKER": "BLOCKER"}
    else:
        raise ValueError("mode is 'observed' or 'intended'")
    low = F.lower("file_path")
    critical = reduce(lambda a, b: a | b, [low.contains(p) for p in CRITICAL_PATHS])
    lowers = (F.col("confidence") < 85) & (F.col("impact") < 70) & (F.col("category") == "maintainability")
    raises = critical | ((F.col("confidence") >= 95) & (F.col("impact") >= 90))
    mapped = F.col("mapped_severity")
    changed = F.when(lowers, lookup(down, mapped)).when(raises, lookup(up, mapped)).otherwise(mapped)
    out = issues.withColumn("mapped_severity", _mapped()).withColumn("original_severity", F.col("severity"))
    out = out.withColumn("severity", F.coalesce(changed, F.col("severity")))
    return out.withColumn("old_severity", lookup(OLD_SEVERITY, F.col("severity")))


def remap_stats(remapped: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many issues were remapped, and how many the modifiers moved up or down."""
    before, after = severity_rank(F.col("mapped_severity")), severity_rank(F.col("severity"))
    hit = F.col("mapped_severity").isNotNull()
    return remapped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") != F.col("original_severity")).alias("remapped"),
        F.count_if(hit & (after < before)).alias("upgraded"),
        F.count_if(hit & (after > before)).alias("downgraded"),
    )


# ------------------------------------------------------------------ overrides and priority
def override_severity(setting: Column) -> Column:
    """``off``, ``warn`` or ``error`` as a severity (``OFF`` drops), or that of an object ``{"severity": ...}``.

    Any other text is null: the issue keeps its own severity.
    """
    up = F.upper(F.trim(setting))
    inner = F.when(setting.startswith("{"), F.upper(F.get_json_object(setting, "$.severity")))
    return F.when(up == "OFF", "OFF").when(up == "WARN", "MINOR").when(up == "ERROR", "MAJOR").when(inner.isin(*SEVERITIES), inner)


def apply_rule_overrides(issues: DataFrame, overrides: DataFrame) -> DataFrame:
    """Apply ``overrides(rule, setting)``; one row per rule, a registry-sized table."""
    keyed = issues.withColumn("_rule", base_rule_id(F.col("issue_id")))
    settings = overrides.select(F.col("rule").alias("_rule"), override_severity(F.col("setting")).alias("_set"))
    joined = keyed.join(settings, "_rule", "left")
    return joined.where(F.coalesce(F.col("_set"), F.lit("")) != "OFF").withColumn(
        "severity", F.coalesce("_set", "severity")
    ).drop("_rule", "_set")


def priority() -> Column:
    parts = (
        lookup(PRIORITY_SEVERITY, F.col("severity"), 0) * 0.4,
        lookup(PRIORITY_CATEGORY, F.col("category"), 0) * 0.2,
        F.col("confidence") * 0.2,
        F.col("impact") * 0.2,
    )
    return reduce(add, parts)

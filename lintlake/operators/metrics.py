"""Counts, scores, debt and size metrics. All are partial aggregates on their group keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.paths import file_category, language_of
from lintlake.functions.text import issue_source, meaningful_lines, raw_lines
from lintlake.schema import (
    CATEGORIES,
    DEBT_MINUTES,
    FLAT_SCORE_WEIGHT,
    SCORE_WEIGHT,
    SEVERITIES,
    category_counts,
    js_round,
    severity_counts,
)


def _weighted(weights: dict, count=lambda s: F.col(s.lower())) -> Column:
    return reduce(add, [count(s) * F.lit(w) for s, w in weights.items()])


def _clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def issues_by_severity(issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    return issues.groupBy(*keys).agg(*severity_counts())


def issues_by_category(issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    return issues.groupBy(*keys).agg(*category_counts())


def file_score() -> Column:
    """Health of one file from its severity counts."""
    return _clamp(js_round(F.lit(100.0) - _weighted(SCORE_WEIGHT)))


def totals_score(files: Column) -> Column:
    """Health from totals: each count is divided by the files and rounded up before it is weighted."""
    per_file = lambda s: F.ceil(F.col(s.lower()) / files)
    score = _clamp(js_round(F.lit(100.0) - _weighted(SCORE_WEIGHT, per_file)))
    return F.when(files == 0, F.lit(0)).otherwise(score).cast("long")


def flat_score() -> Column:
    return _clamp(F.lit(100) - _weighted(FLAT_SCORE_WEIGHT)).cast("long")


def debt_minutes() -> Column:
    return _weighted(DEBT_MINUTES).cast("long")


def file_health(issues: DataFrame, keys: Sequence[str] = ("project_id", "file_path")) -> DataFrame:
    return issues_by_severity(issues, keys).withColumn("file_score", file_score().cast("long"))


def project_metrics(issues: DataFrame, files: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """All counts, scores and the debt per key; ``files`` carries ``files_analyzed`` per key."""
    counts = issues.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_issues"), *severity_counts(), *category_counts()
    )
    joined = files.join(counts, list(keys), "left")
    zero = [c for c in counts.columns if c not in keys]
    return joined.na.fill(0, zero).withColumns(
        {"score_totals": totals_score(F.col("files_analyzed")), "tech_debt_minutes": debt_minutes()}
    )


def mean_score(issues: DataFrame, files: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Mean of file scores where clean files count 100; no files give 0.

    ``files`` has one row per key with ``files_analyzed``. Two partial aggregations: per file,
    then per key, so a hot project never gathers its issues in one task.
    """
    scored = file_health(issues, [*keys, "file_path"])
    per_key = scored.groupBy(*keys).agg(
        F.sum("file_score").alias("score_sum"), F.count(F.lit(1)).alias("files_with_issues")
    )
    joined = files.join(per_key, list(keys), "left").na.fill(0, ["score_sum", "files_with_issues"])
    total = F.greatest("files_analyzed", "files_with_issues")
    mean = js_round((F.col("score_sum") + (total - F.col("files_with_issues")) * 100) / total)
    return joined.select(
        *keys,
        F.when(F.col("files_analyzed") == 0, F.lit(0)).when(F.col("files_with_issues") == 0, F.lit(100))
        .otherwise(mean).cast("long").alias("score_mean"),
    )


def lines_of_code(files: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    return files.groupBy(*keys).agg(
        F.sum(raw_lines(F.col("content"))).alias("raw_lines"),
        F.sum(meaningful_lines(F.col("content"))).alias("code_lines"),
    )


def function_complexity(files: DataFrame, symbols: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Mean complexity as function symbols per file; projects without functions have 0."""
    functions = symbols.where(F.col("kind") == "function").groupBy(*keys).agg(F.count(F.lit(1)).alias("functions"))
    sizes = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"))
    joined = sizes.join(functions, [*keys], "left").na.fill(0, ["functions"])
    return joined.withColumn("avg_complexity", F.round(ratio(F.col("functions"), F.col("n_files")), 6))


def scan_issue_counts(issues: DataFrame) -> DataFrame:
    """Exact number of issues of each scan."""
    return issues.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))


def unique_files(issues: DataFrame) -> DataFrame:
    """Different files with findings, by the source of the finding."""
    return issues.groupBy(issue_source(F.col("issue_id")).alias("source")).agg(F.countDistinct("file_path").alias("n_files"))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def file_type_histogram(files: DataFrame, keep: int | None = None) -> DataFrame:
    """Files per type label with the share of the total; ``keep`` gives the largest ones."""
    counts = files.groupBy(file_category(F.col("path")).alias("file_type")).agg(F.count(F.lit(1)).alias("n_files"))
    counts = counts.withColumn("total_files", counts.agg(F.sum("n_files")).scalar())
    ordered = counts.orderBy(F.desc("n_files"), "file_type")
    return ordered.limit(keep) if keep else ordered


def language_stats(files: DataFrame, keep: int = 9) -> DataFrame:
    language = F.upper(language_of(F.col("path"))).alias("language")
    return files.groupBy(language).agg(F.count(F.lit(1)).alias("n_files")).orderBy(
        F.desc("n_files"), "language"
    ).limit(keep)


def severity_share(issues: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Per key and severity: count and per cent of the key's issues."""
    counts = issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *severity_counts())
    pairs = F.array(
        *[F.struct(F.lit(s).alias("severity"), F.col(s.lower()).alias("n")) for s in SEVERITIES]
    )
    return counts.select(*keys, "total", F.explode(pairs).alias("p")).select(
        *keys,
        "total",
        "p.severity",
        "p.n",
        F.round(F.least(F.lit(100.0), F.col("p.n") / F.greatest(F.lit(1), "total") * 100), 6).alias("share"),
    )


def category_ranking(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("category").isin(*CATEGORIES)).groupBy("category").agg(
        F.count(F.lit(1)).alias("n")
    ).orderBy(F.desc("n"), "category")


def issues_by_extension(issues: DataFrame) -> DataFrame:
    ext = F.lower(F.substring_index("file_path", ".", -1))
    return issues.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def top_files_for_rule(issues: DataFrame, title_prefix: str, keep: int = 10) -> DataFrame:
    return issues.where(F.col("title").startswith(title_prefix)).groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n")
    ).orderBy(F.desc("n"), "file_path").limit(keep)


# Share of findings taken for noise, by title.
NOISE = {"Line exceeds maximum length": 0.3, "Inline function in JSX prop": 0.4}


def accuracy_estimate(issues: DataFrame, temp_word: str, keys: Sequence[str] = ()) -> DataFrame:
    """True and false positives estimated from noise weights and a word that marks throw-away files."""
    temp = F.count_if(F.col("file_path").contains(temp_word))
    noise = [js_round(F.count_if(F.col("title").startswith(t)) * F.lit(w)) for t, w in NOISE.items()]
    out = issues.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), reduce(add, [temp, *noise]).alias("false_positives")
    )
    out = out.withColumn("true_positives", F.col("total") - F.col("false_positives"))
    return out.withColumn("accuracy", js_round(ratio(F.col("true_positives"), F.col("total")) * 100))


def snapshot_counts(issues: DataFrame, keys: Sequence[str] = ("project_id", "scan_id")) -> DataFrame:
    """Severity counts of a snapshot; unknown severities count as info."""
    low = F.lower("severity")
    known = [s.lower() for s in SEVERITIES[:-1]]
    return issues.groupBy(*keys).agg(
        *[F.count_if(low == s).alias(f"{s}_count") for s in known],
        F.count_if(~F.coalesce(low, F.lit("")).isin(*known)).alias("info_count"),
        F.count(F.lit(1)).alias("total_issues"),
    )


def user_stats(projects: DataFrame, scans: DataFrame) -> DataFrame:
    """Per user: projects, scans, issues found and the rounded mean score (zeros without scans).

    Scans are aggregated per project before the join, so a hot project is one row by then.
    """
    per_project = scans.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("scans"), F.sum("total_issues").alias("issues"), F.sum("overall_score").alias("score")
    )
    joined = projects.select("user_email", "project_id").join(per_project, "project_id", "left")
    out = joined.groupBy("user_email").agg(
        F.count(F.lit(1)).alias("total_projects"),
        F.coalesce(F.sum("scans"), F.lit(0)).alias("total_scans"),
        F.coalesce(F.sum("issues"), F.lit(0)).alias("total_issues_found"),
        F.coalesce(F.sum("score"), F.lit(0)).alias("score"),
    )
    mean = js_round(ratio(F.col("score"), F.col("total_scans")))
    return out.withColumn("avg_score", mean).drop("score")

"""Hotspots: merged line ranges that hold severe, repeated, complex or security findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.text import issue_source
from lintlake.operators.sequence import with_islands
from lintlake.schema import SEVERITIES, severity_rank

MERGE_GAP = 5


def _qualifies() -> Column:
    rule = F.col("issue_id")
    severe = F.col("severity").isin("BLOCKER", "CRITICAL", "MAJOR")
    complex_ = rule.rlike("cyclomatic|cognitive|nesting|complexity")
    security = (F.col("category") == "security") | rule.rlike("^(?:semgrep|checkov)-|security")
    return severe | complex_ | security


def _join_reasons(reasons: Column) -> Column:
    """Join texts in order, leaving out a text that the joined ones already contain."""
    return F.aggregate(
        reasons,
        F.lit(""),
        lambda acc, r: F.when(acc == "", r).when(acc.contains(r), acc).otherwise(F.concat_ws("; ", acc, r)),
    )


def hotspots(issues: DataFrame, scope: str = "file", order: str = "event_id") -> DataFrame:
    """Merge qualifying findings whose lines lie within five lines of each other.

    ``scope='file'`` keeps files apart; ``scope='project'`` merges line numbers across files. The
    findings are first reduced to one row per line and title, then per line, with partial aggregation; the islands are
    found in ranges of lines (:func:`~lintlake.operators.sequence.with_islands`), so no project is one task's work.
    """
    keys = ["project_id", "file_path"] if scope == "file" else ["project_id"]
    per_title = issues.groupBy(*keys, "line_start", "title").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("line_end").alias("line_end"),
        F.min(severity_rank(F.col("severity"))).alias("rank"),
        F.bool_or(_qualifies()).alias("qualifies"),
        F.min(F.struct(F.col(order).alias("ord"), issue_source(F.col("issue_id")).alias("source"))).alias("first"),
    )
    per_line = per_title.groupBy(*keys, "line_start").agg(
        F.sum("n").alias("n"),
        F.max("line_end").alias("line_end"),
        F.min("rank").alias("rank"),
        F.bool_or("qualifies").alias("qualifies"),
        F.min("first").alias("first"),
        F.array_sort(F.collect_list(F.struct(F.col("first.ord").alias("ord"), "title"))).alias("titles"),
    )
    spots = with_islands(per_line.where((F.col("n") >= 2) | F.col("qualifies")), keys, "line_start", "line_end", MERGE_GAP)
    merged = spots.groupBy(*keys, "island").agg(
        F.min("line_start").alias("start_line"),
        F.max("line_end").alias("end_line"),
        F.min("rank").alias("rank"),
        F.min(F.struct("line_start", "first")).alias("head"),
    )
    # Of a title only its first place counts, so an island gathers as many entries as it has different titles.
    titles = spots.select(*keys, "island", "line_start", F.explode("titles").alias("t")).groupBy(*keys, "island", F.col("t.title").alias("title")).agg(
        F.min(F.struct("line_start", "t.ord")).alias("place"))
    reasons = titles.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).alias("titles"))
    return merged.join(reasons, [*keys, "island"]).select(
        *keys,
        "start_line",
        "end_line",
        _join_reasons(F.transform("titles", lambda t: t["title"])).alias("reason"),
        F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("rank") + 1).alias("severity"),
        F.col("head.first.source").alias("source"),
    )


def at_least(spots: DataFrame, severity: str) -> DataFrame:
    return spots.where(severity_rank(F.col("severity")) <= SEVERITIES.index(severity))


def top_hotspots(spots: DataFrame, keep: int = 10, tie_break: Sequence[str] = ("project_id", "file_path", "start_line")):
    return spots.orderBy(severity_rank(F.col("severity")), *tie_break).limit(keep)

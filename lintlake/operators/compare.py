"""Comparison of two sets of issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def _keyed(issues: DataFrame) -> DataFrame:
    return issues.withColumns(
        {
            "_file": F.coalesce("file_path", F.lit("")),
            "_line": F.coalesce("line_start", F.lit(0)),
            "_title": F.coalesce("title", F.lit("")),
        }
    )


KEY = ("_file", "_line", "_title")


def missing_from(issues: DataFrame, other: DataFrame, scope: Sequence[str] = ("project_id",)) -> DataFrame:
    """Issues whose (file, line, title) does not occur in ``other``; repeats are kept.

    The keys of ``other`` are made distinct first, so a key repeated without bound crosses the
    shuffle once per task.
    """
    keys = [*scope, *KEY]
    seen = _keyed(other).select(*keys).distinct()
    return _keyed(issues).join(seen, keys, "left_anti").drop(*KEY)


def new_issues(base: DataFrame, head: DataFrame, scope: Sequence[str] = ("project_id",)) -> DataFrame:
    return missing_from(head, base, scope)


def fixed_issues(base: DataFrame, head: DataFrame, scope: Sequence[str] = ("project_id",)) -> DataFrame:
    return missing_from(base, head, scope)


def compare_summary(base: DataFrame, head: DataFrame, base_scores: DataFrame, head_scores: DataFrame) -> DataFrame:
    """Per project: both scores, their difference, new and fixed counts, and whether it got worse.

    The score tables have one row per project with ``health_score``; a missing score counts 0. Each side is read once: both
    are counted by key, where a key of one side only is new or fixed.
    """
    upper, one, none = F.upper("severity"), F.lit(1), F.lit(0)
    side = lambda issues, in_base, in_head: _keyed(issues).select(
        "project_id", *KEY, in_base.alias("b"), in_head.alias("h"),
        (in_head * (upper == "BLOCKER").cast("int")).alias("blockers"), (in_head * (upper == "CRITICAL").cast("int")).alias("criticals"))
    counts = side(base, one, none).unionByName(side(head, none, one)).groupBy("project_id", *KEY).agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("b", "h", "blockers", "criticals")])
    only = lambda other, c: F.sum(F.when(F.col(other) == 0, F.col(c)).otherwise(0))
    changed = counts.groupBy("project_id").agg(
        only("b", "h").alias("new_issues"), only("b", "blockers").alias("new_blockers"), only("b", "criticals").alias("new_criticals"),
        only("h", "b").alias("fixed_issues"))
    scores = base_scores.select("project_id", F.col("health_score").alias("base_score")).join(
        head_scores.select("project_id", F.col("health_score").alias("head_score")), "project_id", "full"
    )
    out = scores.join(changed, "project_id", "full").na.fill(0)
    return out.withColumns(
        {
            "score_delta": F.col("head_score") - F.col("base_score"),
            "regression": (F.col("new_blockers") > 0) | (F.col("new_criticals") > 0),
        }
    )


def tool_overlap(first: DataFrame, second: DataFrame, key: Sequence[str] = ("title", "path_key")) -> DataFrame:
    """Issues of the first export that the second one also has."""
    return first.join(second.select(*key).distinct(), list(key), "left_semi")

"""History of scans: trends, deltas, latest and recent scans, failure streaks, configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lintlake.schema import js_round
from lintlake.session import cut_lineage


def previous_in_ranges(df: DataFrame, key: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the previous value per key in an order, without sorting a whole key in one task.

    Rows are cut into ranges of (key, order), as many as their size asks for, and ranked within them; the last value of each range
    travels to the next one through a table of one row per key and range. The input is computed once.
    """
    rows = cut_lineage(df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    tails = rows.groupBy(key, "_range").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_tail"))
    carried = tails.withColumn("_carry", F.lag("_tail").over(Window.partitionBy(key).orderBy("_range"))).drop("_tail")
    within = F.lag(F.struct(value)).over(Window.partitionBy(key, "_range").orderBy(*order))
    joined = rows.withColumn("_within", within).join(carried, [key, "_range"])
    return joined.withColumn(name, F.coalesce("_within", "_carry")[value]).drop("_range", "_carry", "_within")


def _with_previous_score(snapshots: DataFrame) -> DataFrame:
    return previous_in_ranges(snapshots, "project_id", ["scanned_at", "scan_id"], "health_score", "previous")


def direction(diff: Column, margin: int) -> Column:
    return F.when(diff > margin, "improving").when(diff < -margin, "worsening").otherwise("stable")


def snapshot_trend(snapshots: DataFrame) -> DataFrame:
    """Each snapshot against the next older one; the oldest is stable."""
    diff = F.col("health_score") - F.col("previous")
    return _with_previous_score(snapshots).withColumn("trend", direction(diff, 2)).drop("previous")


def score_delta(snapshots: DataFrame) -> DataFrame:
    delta = F.coalesce(F.col("health_score") - F.col("previous"), F.lit(0))
    return _with_previous_score(snapshots).withColumn("delta", delta).drop("previous")


def last_n(df: DataFrame, n: int, keys: Sequence[str] = ("project_id",), order: Sequence[str] = ("scanned_at", "scan_id")):
    """The newest ``n`` rows per key with their ``position`` (1 is newest).

    The rank bound is pushed below the shuffle, so each task sends at most ``n`` rows per key.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def health_history(snapshots: DataFrame, limit: int = 30) -> DataFrame:
    """The newest ``limit`` snapshots per project."""
    return last_n(snapshots, limit)


def overall_trend(snapshots: DataFrame) -> DataFrame:
    """Mean of the newest three scores against the three before them."""
    recent = last_n(snapshots, 6)
    means = recent.groupBy("project_id").agg(
        F.avg(F.when(F.col("position") <= 3, F.col("health_score"))).alias("recent"),
        F.avg(F.when(F.col("position") > 3, F.col("health_score"))).alias("older"),
    )
    return means.select("project_id", direction(F.col("recent") - F.col("older"), 3).alias("trend"))


def latest_scan(scans: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """The newest scan per key, by a partial aggregate rather than a sort of each key."""
    rest = [c for c in scans.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("scanned_at", "scan_id")).alias("_s")
    return scans.groupBy(*keys).agg(newest).select(*keys, "_s.*")


def project_snapshots(projects: DataFrame, scans: DataFrame) -> DataFrame:
    """Projects with their latest scan, if any."""
    return projects.join(latest_scan(scans), "project_id", "left")


def recent_average(snapshots: DataFrame, days: int | Sequence[int], as_of: str) -> DataFrame:
    """Rounded mean scores since ``as_of - days``, one column per number of days; the newest score when nothing is that recent."""
    newest = F.max_by("health_score", F.struct("scanned_at", "scan_id"))

    def mean(n: int) -> Column:
        since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(n))
        recent = F.avg(F.when(F.col("scanned_at") >= since, F.col("health_score")))
        return F.coalesce(js_round(recent), newest, F.lit(0)).cast("long").alias(f"average_{n}")

    return snapshots.groupBy("project_id").agg(*[mean(n) for n in ([days] if isinstance(days, int) else days)])


def failure_streaks(calls: DataFrame, threshold: int = 3, open_seconds: int = 60, key: str = "provider",
                    order: Sequence[str] = ("created_at", "call_id")) -> DataFrame:
    """Consecutive failures up to each call and whether they open the provider's circuit.

    The log is cut into segments by ranges of (key, order), whose number follows the size of the log (AQE), so one
    busy provider spans many of them. A segment is summed up by three numbers per key: its calls, whether one
    succeeded, and the failures after the last success. These sums combine from left to right, which gives what every segment
    starts with; within a segment the running count is a window that no other one waits for.
    """
    ranged = calls.repartitionByRange(key, *order).withColumn("_segment", F.spark_partition_id())
    ranged = cut_lineage(ranged)  # both uses below must see the same segments
    failed = F.when(F.col("success"), 0).otherwise(1)
    within = Window.partitionBy(key, "_segment").orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumn("_place", F.row_number().over(within))
    rows = rows.withColumn("_ok", F.max(F.when(failed == 0, F.col("_place"))).over(so_far))
    segments = rows.groupBy(key, "_segment").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("_ok"), F.lit(0)).alias("ok"))
    # Failures that end a segment: those after its last success, or all of it and what it started with. Left to right that
    # is a sum since the last segment with a success.
    before = Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.withColumn("_end", F.sum("n").over(Window.partitionBy(key).orderBy("_segment")))
    last_ok = F.max(F.when(F.col("ok") > 0, F.col("_end") - F.col("n") + F.col("ok"))).over(before)
    carried = F.col("_end") - F.col("n") - F.coalesce(last_ok, F.lit(0))
    starts = segments.select(key, "_segment", carried.alias("_carry"))
    streak = F.when(failed == 0, 0).when(F.col("_ok").isNull(), F.col("_carry") + F.col("_place")).otherwise(F.col("_place") - F.col("_ok"))
    opened = F.col("streak") >= threshold
    until = F.when(opened, F.col(order[0]) + F.make_dt_interval(secs=F.lit(open_seconds)))
    joined = rows.join(starts, [key, "_segment"]).withColumn("streak", streak.cast("long"))
    return joined.withColumns({"circuit_open": opened, "open_until": until}).drop("_segment", "_place", "_ok", "_carry")


CONFIG_NAMES = (".lintrc.json", ".lintrc", "lintrc.json")
MANIFEST, MANIFEST_SECTION = "package.json", "lint"
# Thresholds used where no configuration sets them.
CONFIG_DEFAULTS = {"maxComplexity": 10, "maxFunctionLength": 50, "maxParameters": 5, "maxLineLength": 120}
CONFIG_AI = "struct<enabled:boolean,provider:string,customInstructions:string>"


def config_precedence(files: DataFrame, names: Sequence[str] = CONFIG_NAMES, manifest: str = MANIFEST,
                      section: str = MANIFEST_SECTION) -> DataFrame:
    """The effective configuration of each project: first parsable config file, manifest section, defaults."""
    base = F.substring_index("path", "/", -1)
    ranked = F.when(base == manifest, F.lit(len(names)))
    for i, name in enumerate(names):
        ranked = F.when(base == name, F.lit(i)).otherwise(ranked)
    shape = f"version string, extends string, rules map<string,string>, ignore array<string>, ai {CONFIG_AI}, " + ", ".join(f"{k} int" for k in CONFIG_DEFAULTS)
    text = F.when(base == manifest, F.get_json_object("content", f"$.{section}")).otherwise(F.col("content"))
    candidates = files.withColumn("_rank", ranked).where("_rank IS NOT NULL").withColumn("_text", text)
    candidates = candidates.where(F.get_json_object("_text", "$").isNotNull())
    chosen = candidates.groupBy("project_id").agg(F.min_by(F.struct("path", "_text"), "_rank").alias("c"))
    parsed = chosen.select("project_id", "c.path", F.from_json("c._text", shape).alias("cfg"))
    everyone = files.select("project_id").distinct()
    out = everyone.join(parsed, "project_id", "left")
    return out.select(
        "project_id",
        F.coalesce("path", F.lit("")).alias("config_path"),
        F.coalesce("cfg.version", F.lit("1")).alias("version"),
        "cfg.extends",
        F.coalesce("cfg.rules", F.create_map().cast("map<string,string>")).alias("rules"),
        F.coalesce("cfg.ignore", F.lit(None).cast("array<string>")).alias("ignore"),
        *[F.coalesce(F.col(f"cfg.{k}"), F.lit(v)).alias(k) for k, v in CONFIG_DEFAULTS.items()],
        F.coalesce("cfg.ai.enabled", F.lit(False)).alias("ai_enabled"),
        F.col("cfg.ai.provider").alias("ai_provider"),
        F.col("cfg.ai.customInstructions").alias("ai_instructions"),
    )

"""Order-based operators on lines and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lintlake.functions.bind import let
from lintlake.session import cut_lineage


def lookahead_until(files: DataFrame, width: int, target: str, stop: str) -> DataFrame:
    """Per line: does ``target`` occur on it or the next ``width - 1`` lines, before a line with ``stop`` ends it?

    A line is searched before its own stop counts. Windows are slices of the file's own line array.
    """
    state = lambda found, done: F.struct(found.alias("found"), done.alias("done"))

    def search(ahead):
        folded = F.aggregate(
            ahead,
            state(F.lit(False), F.lit(False)),
            lambda acc, x: F.when(acc["done"], acc).otherwise(
                state(x.rlike(target), x.rlike(target) | F.contains(x, F.lit(stop)))
            ),
        )
        return folded["found"]

    rows = let(
        F.split("content", "\n", -1),
        lambda lines: F.transform(lines, lambda x, i: search(F.slice(lines, i + 1, F.lit(width)))),
    )
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, F.posexplode(rows).alias("line_no", "found"))


def nth_occurrence(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The n-th row per key; ranks above ``n`` are dropped below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return ranked.where(F.col("_rn") == n).drop("_rn")


def with_islands(spans: DataFrame, keys: Sequence[str], start: str, end: str, gap: int, name: str = "island") -> DataFrame:
    """Spans with the first ``start`` of the island they belong to: spans of a key that lie within ``gap`` of each other.

    Two levels, so that a long key is no one task's work: the spans are cut into ranges of (key, start), each of which
    finds how far its own spans reach and where islands begin; what crosses a border comes from two small tables of one row a
    key and range, the farthest end and the last beginning before it. ``start`` is unique within a key.
    """
    rows = cut_lineage(spans.repartitionByRange(*keys, start).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy(*keys, "_range").orderBy(start)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    ranges_before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)

    def carried(df: DataFrame, value: Column, out: str) -> DataFrame:
        per_range = df.groupBy(*keys, "_range").agg(F.max(value).alias("_v"))
        return df.join(per_range.select(*keys, "_range", F.max("_v").over(ranges_before).alias(out)), [*keys, "_range"])

    reaching = carried(rows, F.col(end), "_carried").withColumn("_reach", F.greatest(F.max(end).over(earlier), "_carried"))
    first = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap), F.col(start))
    begun = carried(reaching.withColumn("_begin", first), F.col("_begin"), "_before")
    own = F.max("_begin").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return begun.withColumn(name, F.coalesce(own, "_before")).drop("_range", "_carried", "_reach", "_begin", "_before")

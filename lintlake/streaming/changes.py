"""Incremental analysis of changing files on Structured Streaming.

The source of changes is a folder that files or change records are dropped into. Late events
behind the watermark are dropped here; a periodic batch run over the same folder picks them up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from lintlake.functions.text import content_hash16
from lintlake.operators.ingest import DEFAULT_GLOBS, is_watched
from lintlake.sources.store import read_table

DEBOUNCE = "2 seconds"
LATENESS = "10 seconds"
CACHE_TTL = "1 hour"


def change_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet",
                  files_per_trigger: int = 1000) -> DataFrame:
    """Change records dropped as parquet; the trigger size bounds each micro batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def file_stream(spark: SparkSession, folder: str, since: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """Files saved below ``folder`` as ``(path, content, ts)``; ``since`` skips what was there before."""
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).load(folder)
    if since:
        raw = raw.where(F.col("modificationTime") >= F.lit(since).cast("timestamp"))
    if max_bytes is not None:
        raw = raw.where(F.col("length") <= max_bytes)
    return raw.select(
        "path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("modificationTime").alias("ts")
    )


def watched(changes: DataFrame, globs: Sequence[str] = DEFAULT_GLOBS, large_kilobytes: int = 500) -> DataFrame:
    """Changes of files worth analysing: known names, no excluded folder; those above the size limit are marked ``too_large``."""
    large = F.octet_length("content") > large_kilobytes * 1024
    return changes.where(is_watched(F.col("path"), globs, streaming=True)).withColumn("too_large", large)


def debounce(changes: DataFrame, quiet: str = DEBOUNCE, lateness: str = LATENESS) -> DataFrame:
    """Per path, the last content of each burst, once the path was quiet for ``quiet``."""
    session = F.session_window("ts", quiet)
    return _timed(changes).withWatermark("ts", lateness).groupBy("path", session.alias("burst")).agg(
        F.max_by("content", "ts").alias("content"),
        F.max("ts").alias("ts"),
        F.count(F.lit(1)).alias("changes"),
    ).drop("burst")


def skip_seen(changes: DataFrame, ttl: str = CACHE_TTL) -> DataFrame:
    """Drop content already analysed under the same path within ``ttl``."""
    hashed = _timed(changes).withColumn("hash", content_hash16(F.col("content")))
    return hashed.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["path", "hash"])


def unseen(changes: DataFrame, seen: DataFrame, rules_version: str) -> DataFrame:
    """Batch form of ``skip_seen`` against a table ``seen(path, hash, rules_version)``."""
    known = seen.where(F.col("rules_version") == rules_version).select("path", "hash").distinct()
    hashed = changes.withColumn("hash", content_hash16(F.col("content")))
    return hashed.join(known, ["path", "hash"], "left_anti")


# ------------------------------------------------------------------ tables that streams write
def read_or(spark: SparkSession, path: str, schema: T.StructType | str, layout: Sequence[str] = ()) -> DataFrame:
    """The table at ``path``, or an empty one where nothing was written yet; ``layout`` names its folder columns, read as strings."""
    shape = spark.createDataFrame([], schema).schema
    for name in layout:
        shape = shape.add(name, "string")
    return read_table(spark, path, shape)


def _timed(df: DataFrame) -> DataFrame:
    """Event times as instants; zone-less ones are read in the session's zone."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


# ------------------------------------------------------------------ rates
def rate_windows(requests: DataFrame, key: str, limit: int, width: str = "60 seconds",
                 lateness: str | None = None) -> DataFrame:
    """Requests per key and tumbling window, flagged above ``limit``; batch or stream."""
    source = _timed(requests).withWatermark("ts", lateness) if lateness else _timed(requests)
    counts = source.groupBy(key, F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counts.select(key, F.col("w.start").alias("start"), "requests", (F.col("requests") > limit).alias("over"))


def sliding_rate(calls: DataFrame, key: str, limit: int = 10, seconds: int = 60) -> DataFrame:
    """Calls of the key in the ``seconds`` up to and including each call.

    A trailing window reaches at most into the previous slot of its own width, so each call counts in
    its slot and is lent to the next; a busy key is spread over its slots instead of one sort.
    """
    slot = F.floor(F.unix_micros("ts") / (seconds * 1000000))
    lent = _timed(calls).withColumn("_slot", F.explode(F.array(slot, slot + 1))).withColumn("_own", F.col("_slot") == slot)
    w = Window.partitionBy(key, "_slot").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1000000, 0)
    counted = lent.withColumn("calls", F.count(F.lit(1)).over(w)).where("_own")
    return counted.withColumn("over", F.col("calls") >= limit).drop("_slot", "_own")


def sliding_windows(calls: DataFrame, key: str, width: str = "60 seconds", step: str = "10 seconds",
                    lateness: str = LATENESS) -> DataFrame:
    """Stream form of ``sliding_rate``: counts per overlapping window."""
    counts = _timed(calls).withWatermark("ts", lateness).groupBy(key, F.window("ts", width, step).alias("w")).agg(
        F.count(F.lit(1)).alias("calls")
    )
    return counts.select(key, F.col("w.start").alias("start"), "calls")


# ------------------------------------------------------------------ running
def _start(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into parquet below ``folder`` and read the result."""
    query = _start(stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out"), f"{folder}/cp")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")

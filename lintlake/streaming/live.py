"""The live issues of a project that changes: an append-only table, newest version by path.

Every batch appends the issues of the files it analysed under its own version; nothing is read or rewritten for that. A
reader takes of each path the rows of its newest version. :func:`compact` writes what readers would see as a base, which
stands for all versions up to then; older versions are not read any more and may be removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lintlake.streaming.changes import _start, read_or


def append_by_path(root: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer: the batch's issues (``file_path``, ``issue_id``, ...) are the newest of their files.

    A row with a null ``issue_id`` says that its file was analysed and is clean. A batch that is run again overwrites its own
    version.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/version={epoch}")

    return write


def live_issues(issues: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """:func:`append_by_path` over a stream of issues, until what is there now is written; versions go on at ``checkpoint``."""
    return _start(issues.writeStream.foreachBatch(append_by_path(root)), checkpoint)


def _base(spark: SparkSession, root: str) -> int:
    """The newest version that was compacted; a base counts once its version is listed, which is done last."""
    newest = read_or(spark, f"{root}/compacted", "version long").agg(F.max("version")).first()[0]
    return -1 if newest is None else newest


def _versions(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    base = _base(spark, root)
    version = F.col("version").cast("long")
    changes = read_or(spark, f"{root}/changes", schema, ("version",)).withColumn("version", version).where(version > base)
    if base < 0:
        return changes
    return changes.unionByName(read_or(spark, f"{root}/base/{base}", schema).withColumn("version", F.lit(base).cast("long")))


def _newest(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """The rows of each path's newest version; what moves is one row a path and task, and then the rows themselves."""
    rows = _versions(spark, root, schema)
    newest = rows.groupBy("file_path").agg(F.max("version").alias("version"))
    return rows.join(newest, ["file_path", "version"])


def live_table(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """The issues of every file as last analysed."""
    columns = spark.createDataFrame([], schema).columns
    return _newest(spark, root, schema).where("issue_id IS NOT NULL").select(*columns)


def compact(spark: SparkSession, root: str, schema: T.StructType | str) -> int:
    """Write the live issues as the base of the newest version, which is returned. Run by one writer at a time."""
    newest = _versions(spark, root, schema).agg(F.max("version")).first()[0]
    base = _base(spark, root)
    if newest is None or newest == base:
        return base
    live = live_table(spark, root, schema)
    live.write.mode("overwrite").parquet(f"{root}/base/{newest}")
    spark.createDataFrame([(newest,)], "version long").coalesce(1).write.mode("append").parquet(f"{root}/compacted")
    return newest

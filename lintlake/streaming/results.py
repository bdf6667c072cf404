"""Incremental analysis: a store of results addressed by path, content and rules version.

The store is two tables below one root, both in folders of a rules version and a batch: ``seen`` holds a row for every
content that was analysed (with findings or without), ``issues`` what was found. A batch analyses only contents that no
other batch of its rules version has, however often and in however many batches they come; of all others the stored rows
are given. ``seen`` is written last, so a batch that was cut off counts as not done, and a batch that is run again
overwrites its own folders and reads those of the others: the result is the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lintlake.functions.text import content_hash16
from lintlake.session import cut_lineage
from lintlake.streaming.changes import _start, read_or

ADDRESS = ("project_id", "path", "hash")
HASH_LENGTH = 16
#: Folders of both tables. What one batch adds is never rewritten by a later one.
LAYOUT = ("rules_version", "batch")
_BETWEEN = " "


def addressed(files: DataFrame) -> DataFrame:
    """``project_id``, ``path``, ``content`` and its ``hash``; a null content or project counts as empty."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return files.select(filled("project_id"), "path", filled("content")).withColumn("hash", content_hash16(F.col("content")))


def seen(spark: SparkSession, root: str, rules_version: str) -> DataFrame:
    """What was analysed under ``rules_version``, with the ``batch``; only that version's folder is read."""
    return read_or(spark, f"{root}/seen", "project_id string, path string, hash string", LAYOUT).where(F.col("rules_version") == rules_version)


def _replace(rows: DataFrame, root: str, rules_version: str, batch: int) -> None:
    """Write one batch's folder. It is there even without rows, so that what a repeated batch left before is gone."""
    rows.write.mode("overwrite").parquet(f"{root}/rules_version={rules_version}/batch={batch}")


def analyse_new(root: str, rules_version: str, analyse: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that runs ``analyse`` on the contents of a batch that are not in the store.

    ``analyse`` takes ``files(project_id, path, content)`` and returns issues (``project_id``, ``file_path``, further
    columns) of each file by itself. A content that stands twice in a batch is analysed once. Two contents of one path are
    two files: while they are analysed, project and content hash together stand for the project. The version names a folder.
    """
    if not re.fullmatch(r"[\w.-]+", rules_version):
        raise ValueError("a rules version consists of letters, digits, dots and dashes")

    def write(batch: DataFrame, epoch: int) -> None:
        known = seen(batch.sparkSession, root, rules_version).where(F.col("batch") != epoch).select(*ADDRESS)
        fresh = addressed(batch)
        fresh = cut_lineage(fresh.dropDuplicates(list(ADDRESS)).join(known, list(ADDRESS), "left_anti"))
        owner = F.concat_ws(_BETWEEN, "hash", "project_id").alias("project_id")
        found = analyse(fresh.select(owner, "path", "content"))
        found = found.withColumn("hash", F.substring_index("project_id", _BETWEEN, 1)).withColumn(
            "project_id", F.expr(f"substring(project_id, {HASH_LENGTH + 2})"))
        _replace(found, f"{root}/issues", rules_version, epoch)
        _replace(fresh.select(*ADDRESS), f"{root}/seen", rules_version, epoch)

    return write


def stored_issues(changes: DataFrame, root: str, rules_version: str, schema: T.StructType | str) -> DataFrame:
    """The stored issues (``schema``, with ``hash``) of ``changes(project_id, path, content)``, once for every row that has the content."""
    table = read_or(changes.sparkSession, f"{root}/issues", schema, LAYOUT)
    table = table.where(F.col("rules_version") == rules_version).drop(*LAYOUT)
    asked = addressed(changes).select("project_id", F.col("path").alias("file_path"), "hash")
    return table.join(asked, ["project_id", "file_path", "hash"])


def incremental(changes: DataFrame, root: str, checkpoint: str, rules_version: str, analyse: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """:func:`analyse_new` over a stream of changes, until what is there now is done."""
    return _start(changes.writeStream.foreachBatch(analyse_new(root, rules_version, analyse)), checkpoint)

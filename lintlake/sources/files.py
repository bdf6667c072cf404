"""Reading files from folders and archives into the ``files`` table."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lintlake.functions.paths import ingest_extension
from lintlake.schema import FILES


def mounted(spark: SparkSession, root: str) -> str | None:
    """The plain path of a folder that the tasks can open themselves; None where only Spark's file systems reach it."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if root.startswith("file:/") or root.startswith("/") and default.startswith("file:"):
        return re.sub("^(file:)?/+", "/", root).rstrip("/") or "/"
    return None


#: Bytes of content and number of files that a batch of rows gathers before it is handed on.
BATCH_BYTES, BATCH_FILES = 4 << 20, 10_000
_LISTED = "path string, length long, folder boolean"


def _list_in_tasks(spark: SparkSession, base: str, glob: str | None, max_bytes: int | None) -> DataFrame:
    """``(path, length, content)`` of the files below a mounted folder: a task lists the root, others a folder of it each, others read.

    What Spark's reader leaves out (hidden names, empty files, names off the glob) is left out; nothing of the listing goes to the driver.
    """
    # The pattern of the same class that ``pathGlobFilter`` asks.
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern() if glob else None
    listed = pa.schema([("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_())])
    filled = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
    cores = spark.sparkContext.defaultParallelism

    # Inner functions travel by value: the tasks need no module of this package.
    def hidden(name: str) -> bool:
        """Names that Spark's readers pass over."""
        return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")

    def batched(rows: Iterator[tuple], schema: pa.Schema, weight: int | None = None) -> Iterator[pa.RecordBatch]:
        """Rows as batches of a bounded number of files and bytes; ``weight`` is the column of the contents."""
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[weight]) if weight is not None else 0
            if len(held) >= BATCH_FILES or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    def entries(folder: str, name: re.Pattern | None) -> Iterator[tuple[str, int, bool]]:
        """The folders and wanted files of a folder, paths relative to the root."""
        with os.scandir(f"{base}/{folder}") as found:
            for entry in found:
                if hidden(entry.name):
                    continue
                path = f"{folder}/{entry.name}" if folder else entry.name
                try:
                    if entry.is_dir():
                        yield path, 0, True
                    elif name is None or name.fullmatch(entry.name):
                        length = entry.stat().st_size
                        if length and (max_bytes is None or length <= max_bytes):
                            yield path, length, False
                except FileNotFoundError:  # a link that leads nowhere
                    continue

    def below(path: str, length: int, folder: bool, name: re.Pattern | None) -> Iterator[tuple[str, int, bool]]:
        if not folder:
            yield path, length, folder
            return
        open_folders = [path]
        while open_folders:
            for entry in entries(open_folders.pop(), name):
                if entry[2]:
                    open_folders.append(entry[0])
                else:
                    yield entry

    def compiled() -> re.Pattern | None:
        return re.compile(named, re.DOTALL) if named is not None else None

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                yield from batched(entries("", compiled()), listed)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = compiled()
        rows = (row for batch in batches for given in zip(*(c.to_pylist() for c in batch.columns)) for row in below(*given, name))
        yield from batched(rows, listed)

    def content(path: str) -> bytes:
        with open(f"{base}/{path}", "rb") as file:
            return file.read()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((path, length, content(path)) for batch in batches
                for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()))
        yield from batched(rows, filled, weight=2)

    tops = spark.range(1, numPartitions=1).mapInArrow(top, _LISTED).repartition(4 * cores)
    every = tops.mapInArrow(walk, _LISTED).repartition(8 * cores)
    return every.mapInArrow(read, "path string, length long, content binary")


def read_files(spark: SparkSession, root: str, project_id: str = "project", glob: str | None = None,
               max_bytes: int | None = None) -> DataFrame:
    """Every file below ``root`` as one row, paths relative to it.

    Name and size limits apply to the listing (``pathGlobFilter`` and the file's length), before any
    content is read. Bytes that are not UTF-8 become replacement characters, never a failed job.

    A mounted folder is listed in tasks. Elsewhere Spark's reader lists all files in the driver, whose memory then bounds their number.
    """
    base = mounted(spark, root)
    if base is not None and os.path.isdir(base):
        raw, relative = _list_in_tasks(spark, base, glob, max_bytes), F.col("path")
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        raw = reader.load(root)
        if max_bytes is not None:
            raw = raw.where(F.col("length") <= max_bytes)
        base = root.rstrip("/").split("://", 1)[-1].removeprefix("file:")
        plain = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
        relative = F.substr(plain, F.lit(len(base) + 2))
    rows = raw.select(
        F.lit(project_id).alias("project_id"),
        relative.alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.col("length").alias("size"),
    )
    return rows.withColumn("language", ingest_extension(F.col("path"))).select(*FILES.names)


#: Files of a folder that :func:`write_files` makes.
FOLDER_FILES = 1000


def write_files(files: DataFrame, root: str) -> None:
    """Each row of ``files(file_id, content)`` as a file of its own below ``root``, its text closed by a line break; see :func:`file_id_of`.

    On a mounted folder the tasks write their rows' files themselves, into folders by ranges of the id: Spark's writer changes the
    mode of every file, folder and checksum in a process of its own there. A repeated task writes the same files again.
    """
    base = mounted(files.sparkSession, root)
    if base is None:
        files.select("file_id", "content").write.partitionBy("file_id").text(root)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, made, n = fs.LocalFileSystem(), set(), 0
        for batch in batches:
            for key, text in zip(batch.column("file_id").to_pylist(), batch.column("content").to_pylist()):
                folder = f"{base}/{key // FOLDER_FILES}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{folder}/part-{key}") as out:
                    out.write(((text or "") + "\n").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    files.select("file_id", "content").mapInArrow(write, "n long").groupBy().sum("n").collect()


def file_id_of(path: Column) -> Column:
    """The id in the path of a file of :func:`write_files`."""
    return F.regexp_extract(path, r"(?:file_id=|/part-)(\d+)(?:/part-[^/]*)?$", 1).cast("long")


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for project_id, content in zip(batch["project_id"], batch["content"]):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
            except zipfile.BadZipFile:
                continue
            # One frame per entry: an archive never has to fit in memory unpacked.
            for entry in archive.infolist():
                if entry.is_dir():
                    continue
                try:
                    data = archive.read(entry)
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
                    continue
                yield pd.DataFrame(
                    {
                        "project_id": [project_id],
                        "path": [entry.filename],
                        "content": [data.decode("utf-8", "replace")],
                        "language": [""],
                        "size": [len(data)],
                    }
                )


def expand_archives(archives: DataFrame) -> DataFrame:
    """Rows of ``archives(project_id, content)`` (zip bytes) as files; broken entries are skipped."""
    packed = archives.select("project_id", "content")
    files = packed.mapInPandas(_unpack, FILES)
    return files.withColumn("language", ingest_extension(F.col("path")))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All zip files of a folder, one project per archive."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.zip$", "")
    return expand_archives(raw.select(name.alias("project_id"), "content"))

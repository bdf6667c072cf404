"""What the operators of this subpackage share: tables, written intermediate results, blocks of texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.session import checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a table in the shared folder, in folders ``by`` columns: a lost executor costs no replay of what made it."""
    folder = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def one_per_id(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first row (by text) of each id, for stages that must return a document once."""
    from pyspark.sql import Window

    place = "__place"
    order = Window.partitionBy(key).orderBy(F.col("text").asc_nulls_last())
    return docs.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column in one array, and the n + 1 offsets (a null is empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    filled = column.fill_null("") if column.null_count else column
    filled = filled.cast(pa.large_binary())
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds at most ``most_bytes`` each (a longer single row stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of a common public hash)."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))

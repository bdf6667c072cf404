"""Conflict-constrained best-fit packing of documents into sequences of a fixed capacity.

A bin may hold one document of a source and one of a group of duplicates; it carries both as bitmaps. Pieces are placed
by falling length; bins stand in the order of their residual, and the search goes from the first that is large enough to
the next larger until a compatible one is found: the tightest. Blocks of rows are packed on their own, each in one task.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import written
from lintlake.llm.minhash_dedup import near_texts

#: Bytes of a sequence: the tokens of a byte-level model.
CAPACITY = 8192
#: Pieces that one task packs at a time; what a larger block would save in open bins is below one per cent.
BLOCK_ROWS = 4096
_BIN_SHIFT = 1 << 24


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin of each piece, pieces given by falling length. A None source or cluster conflicts with nothing."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    often: dict = {}
    for c in clusters:
        often[c] = often.get(c, 0) + 1
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in often.items() if c is not None and n > 1)}
    residuals: list[tuple[int, int]] = []
    source_map: list[int] = []
    cluster_map: list[int] = []
    placed = []
    for length, source, cluster in zip(lengths, sources, clusters):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        at = bisect_left(residuals, (length, -1))
        while at < len(residuals):
            b = residuals[at][1]
            if not (source_map[b] & s or cluster_map[b] & c):
                break
            at += 1
        if at < len(residuals):
            left, b = residuals.pop(at)
            left -= length
            source_map[b] |= s
            cluster_map[b] |= c
        else:
            b, left = len(source_map), capacity - length
            source_map.append(s)
            cluster_map.append(c)
        if left:
            insort(residuals, (left, b))
        placed.append(b)
    return placed


def _packed(rows: pa.Table, capacity: int) -> pa.Table:
    ids, pieces, lengths = (rows.column(c).fill_null(-1 << 63).to_numpy() for c in ("doc_id", "piece", "n_bytes"))
    sources, clusters = rows.column("source").to_pylist(), rows.column("cluster").to_pylist()
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], ids[k], pieces[k], clusters[k] or 0, str(sources[k])))
    bins = np.array(best_fit([int(lengths[k]) for k in order], [sources[k] for k in order], [clusters[k] for k in order], capacity))
    offset, used = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    for k, b in enumerate(bins):
        offset[k] = used[b]
        used[b] += lengths[order[k]]
    block = int(rows.column("block")[0].as_py())
    taken = rows.select(["doc_id", "piece", "start", "n_bytes"]).take(pa.array(order))
    return taken.append_column("bin_id", pa.array(block * _BIN_SHIFT + bins)).append_column("bin_start", pa.array(offset))


def exact_cluster(text: Column) -> Column:
    """Documents that differ in case of A-Z and white space only have the same cluster."""
    return F.xxhash64(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def with_near_clusters(docs: DataFrame) -> DataFrame:
    """``docs`` without its text but with its ``size`` in bytes and a ``cluster``: the group of near-duplicates of its id, or the
    exact one for rows without id or words.

    An id should stand for one text; of several the smallest group counts. No text is moved for the join.
    """
    groups = written(near_texts(docs.select("doc_id", "text")).where("doc_id IS NOT NULL AND n_shingles > 0"), "packing-groups")
    groups = groups.groupBy("doc_id").agg(F.min("component_id").alias("near"))
    # Only a row without an id or a word can be without a group.
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    sized = docs.withColumns({"size": _bytes_of(F.col("text")), "cluster": F.when(alone, exact_cluster(F.col("text")))}).drop("text")
    named = sized.where("doc_id IS NOT NULL").join(groups, "doc_id", "left").withColumn("cluster", F.coalesce("near", "cluster"))
    return named.select(sized.columns).unionByName(sized.where("doc_id IS NULL"))


def _bytes_of(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def pack(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, size: Column | None = None) -> DataFrame:
    """(``doc_id``, ``piece``, ``start``, ``n_bytes``, ``bin_id``, ``bin_start``) of every piece of every row.

    A document longer than the capacity is cut in full pieces, each a bin of its own, and a rest. A null or empty text comes
    back as piece 0 of length 0 without a bin. A null ``source`` conflicts with nothing; a repeated row is packed again, its
    copies apart, being duplicates of each other. ``cluster`` names groups of duplicates (by default equal texts up to case and
    white space), ``size`` the bytes of a row (by default those of its ``text``). Only lengths and group names are moved, to blocks of about ``block_rows`` pieces; a hot source or a large
    group of copies is spread over the blocks like all rows.
    """
    if not 0 < capacity < 1 << 31:
        raise ValueError("capacity must be a positive int")
    size = _bytes_of(F.col("text")) if size is None else size
    group = exact_cluster(F.col("text")) if cluster is None else cluster
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), group.cast("long").alias("cluster"), size.alias("size"))
    pieces = rows.select(
        "doc_id", "source", "cluster", "size",
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(size - 1) div {capacity}")))).alias("piece"),
    ).withColumn("start", F.col("piece") * capacity).withColumn("n_bytes", F.least(F.col("size") - F.col("start"), F.lit(capacity).cast("long")))
    blocks = max(1, math.ceil(docs.count() / block_rows))
    dealt = pieces.where("size > 0").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "source", "cluster"), F.lit(blocks)))
    packed = dealt.groupBy("block").applyInArrow(
        lambda rows: _packed(rows, capacity), "doc_id long, piece long, start long, n_bytes long, bin_id long, bin_start long")
    none = F.lit(None).cast("long")
    empty = pieces.where("size = 0").select("doc_id", "piece", "start", "n_bytes", none.alias("bin_id"), none.alias("bin_start"))
    return packed.unionByName(empty)


def sequences(docs: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(``bin_id``, ``content``): the bytes of each bin, pieces in their order. ``doc_id`` must be unique in ``docs``."""
    body = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    cut = packed.where("bin_id IS NOT NULL").join(body, "doc_id").select(
        "bin_id", "bin_start", F.expr("substring(body, cast(start + 1 AS int), cast(n_bytes AS int))").alias("part"))
    parts = cut.groupBy("bin_id").agg(F.sort_array(F.collect_list(F.struct("bin_start", "part"))).alias("parts"))
    return parts.select("bin_id", F.expr("aggregate(parts, cast('' AS binary), (a, p) -> concat(a, p.part))").alias("content"))

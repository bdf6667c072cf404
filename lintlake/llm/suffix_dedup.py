"""Repeated strings: every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else is removed.

1. A sieve finds what can repeat at all. Of each window of ``LENGTH`` bytes the smallest of its 40-byte grams (by a hash) names
   the window; windows in a row with the same gram are a segment. Equal windows have equal grams at the same place, so only
   segments whose gram occurs twice can hold a repeated window, and equal segments are repeated as a whole.
2. The segments left - a gram shared by different segments - are cut into shards by gram. Each shard is suffix-sorted; common
   prefixes of neighbours tell which windows repeat. A gram with very many different segments is dealt over several shards,
   whose arrays are merged pair by pair by binary search.
3. The runs found are joined with the texts, which are shuffled once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import mixed, slices, text_bytes, written
from lintlake.llm.suffix_array import common_prefixes, places_in, suffix_array

LENGTH = 200
GRAM = 40
#: Window starts that one step of the sieve looks at; longer texts are taken in such steps, overlapping by a window.
CHUNK = 1 << 18
#: Bytes of segments in a shard, and different segments of one gram that stand in one shard.
SHARD_BYTES = 2 << 20
BLOCK = 8192
SEED = 200_040
_LOW = np.uint64((1 << 24) - 1)
_WINDOWS = LENGTH - GRAM + 1


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _constants(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    out = []
    for factor in (base, _inverse(base)):
        powers = np.ones(n, np.uint64)
        powers[1:] = factor
        out.append(np.multiply.accumulate(powers))
    return *out, mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(SEED))


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all strings of ``GRAM`` bytes."""
    count = len(data) - GRAM + 1
    view = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    words = np.ascontiguousarray(view).view(np.uint64).ravel()
    total = np.full(count, np.uint64(GRAM))
    for at in range(0, GRAM, 8):
        total = (total ^ words[at : at + count]) * np.uint64(0xC2B2AE3D27D4EB4F)
        total ^= total >> np.uint64(29)
    return mixed(total)


def _segments(flat: np.ndarray, ends: np.ndarray, constants) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window within it, windows, gram, content hash) of all segments of a block of texts."""
    powers, inverses, values = constants
    sizes = np.diff(ends)
    if len(flat) < LENGTH:
        return
    for low in range(0, len(flat) - LENGTH + 1, CHUNK):
        high = min(low + CHUNK, len(flat) - LENGTH + 1)
        data = flat[low : high + LENGTH - 1]
        owner = np.searchsorted(ends, np.arange(low, high), side="right") - 1
        valid = np.arange(low, high) + LENGTH <= ends[owner] + sizes[owner]
        if not valid.any():
            continue
        grams = _grams(data)
        code = (grams & ~_LOW) | (np.arange(len(grams), dtype=np.uint64) & _LOW)
        fill = -len(code) % _WINDOWS
        table = np.concatenate([code, np.full(fill, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, _WINDOWS)
        upto = np.minimum.accumulate(table, axis=1).ravel()
        after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        count = high - low
        least = (np.minimum(after[:count], upto[_WINDOWS - 1 : _WINDOWS - 1 + count]) & _LOW).astype(np.int64)
        change = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])])
        first = np.flatnonzero(change)
        stop = np.append(first[1:], count)
        kept = valid[first]
        first, stop = first[kept], stop[kept]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values[data] * powers[: len(data)], dtype=np.uint64)])
        content = mixed((sums[stop + LENGTH - 1] - sums[first]) * inverses[first] + (stop - first).astype(np.uint64))
        text = owner[first]
        yield text, low + first - ends[text], stop - first, (grams[least[first]] >> np.uint64(24)).view(np.int64), content.view(np.int64)


_ASKED = ("start", "windows", "gram", "whole", "blocks", "block")
_SIEVE = "id long, start long, windows int, gram long, content long"


def _sieved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    constants = _constants(CHUNK + LENGTH)
    for batch in slices(batches, "text", CHUNK):
        flat, ends = text_bytes(batch.column("text"))
        for text, start, windows, gram, content in _segments(flat, ends, constants):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(text)), pa.array(start), pa.array(windows.astype(np.int32)), pa.array(gram), pa.array(content)],
                names=["id", "start", "windows", "gram", "content"])


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments asked for: a row is a text with the list of its segments."""
    for whole in batches:
        for batch in slices(iter([whole]), "text", 1 << 20):
            flat, ends = text_bytes(batch.column("text"))
            lists = batch.column("segments")
            own, segments = pa.compute.list_parent_indices(lists), lists.flatten()
            starts, windows = (segments.field(c).to_numpy() for c in ("start", "windows"))
            parts = [flat[a : a + w + LENGTH - 1].tobytes() for a, w in zip(ends[own.to_numpy()] + starts, windows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(own), *[segments.field(c) for c in _ASKED], pa.array(parts, pa.binary())], names=["id", *_ASKED, "body"])


def _repeated(rows: pa.Table, length: int = LENGTH) -> pa.Table:
    """Runs of repeated windows of one shard: (id, start, stop in bytes)."""
    i, j, block = (rows.column(c).to_numpy() for c in ("i", "j", "block"))
    gram = rows.column("gram").to_numpy()
    ids, starts, windows, whole = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "start", "windows", "whole"))
    bodies = rows.column("body").to_pylist()
    out: list[tuple[np.ndarray, ...]] = []

    def laid(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text of the chosen segments, their starts in it, and its suffix array."""
        text = np.frombuffer(b"".join(bodies[k] for k in chosen), np.uint8)
        sizes = np.array([len(bodies[k]) for k in chosen], np.int64)
        return text, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), suffix_array(text)

    def owned(chosen: np.ndarray, lanes: np.ndarray, total: int) -> np.ndarray:
        """Whether a window of a chosen segment starts at a position."""
        edge = np.zeros(total + 1, np.int32)
        np.add.at(edge, lanes, 1)
        np.add.at(edge, lanes + windows[chosen], -1)
        return np.cumsum(edge[:-1]) > 0

    def report(chosen: np.ndarray, lanes: np.ndarray, hit: np.ndarray) -> None:
        places = np.flatnonzero(hit)
        if not len(places):
            return
        lane = np.searchsorted(lanes, places, side="right") - 1
        head = np.concatenate([[True], (places[1:] != places[:-1] + 1) | (lane[1:] != lane[:-1])])
        first, last = places[head], places[np.concatenate([np.flatnonzero(head)[1:] - 1, [len(places) - 1]])]
        at = lane[head]
        k = chosen[at]
        keep = ~whole[k]
        low = starts[k] + first - lanes[at]
        out.append((ids[k][keep], low[keep], (low + last - first + length)[keep]))

    inner = np.flatnonzero(i == j)
    if len(inner):
        text, lanes, order = laid(inner)
        mine = owned(inner, lanes, len(text))
        prefix = common_prefixes(text, order, lanes, length)
        places = np.flatnonzero(mine[order])
        if len(places) > 1:
            # A pair of neighbours among the windows shares the least prefix of all suffixes between them.
            between = np.minimum.reduceat(prefix, places[:-1] + 1)
            stretch = np.diff(places)
            between = np.where(stretch == 1, prefix[places[1:]], between) >= length
            hit = np.zeros(len(text), bool)
            hit[order[places[:-1]][between]] = True
            hit[order[places[1:]][between]] = True
            report(inner, lanes, hit)
    outer = np.flatnonzero(i != j)
    if len(outer):
        cells = np.stack([gram[outer], i[outer], j[outer]], axis=1)
        by = np.lexsort(cells.T)
        cells, outer = cells[by], outer[by]
        cuts = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(axis=1)]))
        for a, b in zip(cuts, [*cuts[1:], len(outer)]):
            members = outer[a:b]
            sides = [members[block[members] == x] for x in cells[a][1:]]
            if not len(sides[0]) or not len(sides[1]):
                continue
            parts = []
            for side in sides:
                text, lanes, order = laid(side)
                mine = owned(side, lanes, len(text))
                parts.append((text, lanes, order[mine[order]], np.flatnonzero(mine)))
            for (text, _, order, _), (other, lanes, _, where), side in ((parts[0], parts[1], sides[1]), (parts[1], parts[0], sides[0])):
                hit = np.zeros(len(other), bool)
                hit[where[places_in(text, order, other, where, length)]] = True
                report(side, lanes, hit)
    columns = [np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3)]
    return pa.table(dict(zip(("id", "start", "stop"), columns)))


def merged(starts, stops, n: int) -> list[tuple[int, int]]:
    """Disjoint, non-touching runs that cover the given ones, inside of n bytes."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, stops)):
        b = min(b, n)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
        for text, starts, stops in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "stops"))):
            body = (text or "").encode()
            runs = merged(starts or [], stops or [], len(body))
            digest, at = hashlib.sha256(), 0
            for a, b in runs:
                digest.update(body[at:a])
                at = b
            digest.update(body[at:])
            rows["n_bytes"].append(len(body))
            rows["n_removed"].append(sum(b - a for a, b in runs))
            rows["n_spans"].append(len(runs))
            rows["kept_sha256"].append(digest.hexdigest())
            rows["spans"].append([{"start": a, "stop": b} for a, b in runs])
        kinds = {"kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))}
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()]], names=["doc_id", *rows])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a task's rows joined where they touch: fewer rows to move."""
    for batch in batches:
        ids, starts, stops = (batch.column(c).to_numpy() for c in ("id", "start", "stop"))
        by = np.lexsort((starts, ids))
        ids, starts, stops = ids[by], starts[by], stops[by]
        if not len(ids):
            continue
        _, group = np.unique(ids, return_inverse=True)
        lift = group * (int(stops.max()) + 1)  # one axis for all texts
        reach = np.maximum.accumulate(stops + lift)
        head = np.concatenate([[True], (starts + lift)[1:] > reach[:-1]])
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(ids)) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[first]), pa.array(starts[first]), pa.array(reach[last] - lift[last])], names=["id", "start", "stop"])


def repeated_strings(docs: DataFrame, shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans`` (byte runs).

    Texts are UTF-8 bytes, a null is empty; strings never cross documents and are judged on the input. A repeated row is a copy like
    any other. Rows are told apart by ``doc_id`` (those without one by their text): rows that share an id but not the text lose
    the runs found in any of them, as far as they reach. Very long texts are sieved in steps that overlap by a window; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    texts = docs.select("doc_id", own.alias("id"), "text")
    sieve = texts.select("id", "text").where(F.octet_length("text") >= LENGTH).mapInArrow(_sieved, _SIEVE)
    grams = sieve.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high")).where("n > 1")
    grams = written(grams, "repeats-grams")  # a table, not an aggregate: the join can then split a gram with very many segments
    shared = written(sieve.join(grams, "gram").withColumn("equal", F.col("low") == F.col("high")).drop("n", "low", "high"), "repeats-sieve")
    run = [F.col("id"), F.col("start"), (F.col("start") + F.col("windows") + LENGTH - 1).alias("stop")]
    runs = "id long, start long, stop long"
    plain = shared.where("equal").select(*run)
    mixed_rows = shared.where("NOT equal")
    groups = written(
        mixed_rows.groupBy("gram", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "start", "windows")).alias("first")),
        "repeats-groups")
    copied = mixed_rows.join(groups.where("n > 1").select("gram", "content"), ["gram", "content"]).select(*run)
    sizes = groups.groupBy("gram").agg(F.count(F.lit(1)).alias("different"))
    asked = (
        groups.join(sizes, "gram").select("gram", "first.*", (F.col("n") > 1).alias("whole"), F.ceil(F.col("different") / block).cast("long").alias("blocks"))
        .withColumn("block", F.pmod(F.xxhash64("id", "start"), F.col("blocks")))
    )
    asked = written(asked, "repeats-asked")
    total = asked.agg(F.sum((F.col("windows") + LENGTH) * F.col("blocks"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, math.ceil(total / shard_bytes))
    bodies = texts.where("id IS NOT NULL")  # the same columns in both joins: one exchange of the texts serves both
    by_text = asked.groupBy("id").agg(F.collect_list(F.struct(*_ASKED)).alias("segments"))
    sent = bodies.join(by_text, "id").select("doc_id", "id", "text", "segments").mapInArrow(
        _sent, "id long, start long, windows int, gram long, whole boolean, blocks long, block long, body binary")
    dealt = (
        sent.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        .withColumn("shard", F.pmod(F.xxhash64("gram", "i", "j"), F.lit(shards))).drop("blocks", "other")
    )
    found = dealt.groupBy("shard").applyInArrow(lambda rows: _repeated(rows), runs)
    cuts = plain.unionByName(copied).unionByName(found).mapInArrow(_joined, runs)
    by_runs = cuts.groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    none = F.lit(None).cast("array<long>")
    with_id = bodies.join(by_runs, "id", "left").select("doc_id", "text", "starts", "stops")
    without = texts.where("id IS NULL").select("doc_id", "text", none.alias("starts"), none.alias("stops"))
    return with_id.unionByName(without).mapInArrow(
        _cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>")

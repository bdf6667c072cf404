"""Near-duplicate texts: MinHash over word shingles, banding, signature verification, components by stars.

1. One pass over the texts gives each document its number of shingles, a 128-bit address of its shingle set, the band
   hashes of its minima and a one-byte-a-minimum signature. Documents with equal sets become one node.
2. In every bucket of a band each node is paired with the bucket's smallest: a star, never all pairs. Pairs that pass the
   signatures are confirmed on the full sets, and links give components.
3. Buckets that still hold several components are compared on signatures block by block inside of tasks; only pairs between
   different components are looked at. First each node's best partner is confirmed on the full sets, which joins most of
   what belongs together; then all pairs that are left are confirmed inside of the tasks, and only links leave them. So every
   candidate pair is either inside of one component or was checked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import mixed, slices, text_bytes, written
from lintlake.llm.components import connected_components

WORDS = 5
MIN_PERCENT = 75
#: 32 bands of 4 minima: a pair at the threshold shares no band with a chance of 5 in a million.
BANDS, ROWS = 32, 4
#: Minima of the signature (the bands' and as many more), a byte each, and the equal ones that a pair needs: five standard
#: deviations below what a pair at the threshold has.
MINIMA, LEAST_EQUAL = 2 * BANDS * ROWS, 158
#: Rows of a bucket that a task compares at once, and the weight of a shard: with signatures only (a row weighs 1), and with
#: texts (a row weighs as many as it has shingles, and 100).
BLOCK, SHARD_ROWS = 2048, 32_768
SET_BLOCK, SET_SHARD_WEIGHT = 512, 2_000_000
SEED = 75_005
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def word_hashes(flat: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a block of texts, and the n + 1 offsets of each text's words.

    Words are the runs of bytes that ``between`` does not mark.
    """
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = between[flat]
    first = ~space
    first[1:] &= space[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = ~space[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.arange(len(flat), dtype=np.int64)
    within = at - np.maximum.accumulate(np.where(first, at, 0))
    values = (_LOWER[flat].astype(np.uint64) + np.uint64(1)) * _powers(int(within.max()) + 1)[within]
    values[space] = 0
    return mixed(np.add.reduceat(values, starts)), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's shingles in order, repeats included, and their n + 1 offsets."""
    odd = mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
    counts = np.diff(offsets)
    sizes = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    if not ends[-1]:
        return np.zeros(0, np.uint64), ends
    padded = np.r_[words, np.zeros(WORDS, np.uint64)]
    length = np.repeat(np.minimum(counts, WORDS), sizes)
    at = np.repeat(offsets[:-1], sizes) + np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
    total = length.astype(np.uint64)
    for j in range(WORDS):
        total = total + np.where(j < length, padded[at + j] * odd[j], np.uint64(0))
    return mixed(total), ends


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The row of each document: size and address of its set, band hashes, signature."""
    rng = np.random.default_rng(SEED)
    times = rng.integers(1, 2**63, MINIMA, dtype=np.uint64) | np.uint64(1)
    plus = rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
    fold = mixed(rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64)) | np.uint64(1)
    for batch in slices(batches, "text", 512 << 10):
        hashes, ends = shingles(*word_hashes(*text_bytes(batch.column("text"))))
        n = batch.num_rows
        some = np.flatnonzero(np.diff(ends) > 0)
        size, one, two = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for d in some:
            own = np.unique(hashes[ends[d] : ends[d + 1]])
            size[d], one[d], two[d] = len(own), mixed(own).sum(dtype=np.uint64), mixed(own ^ np.uint64(SEED)).sum(dtype=np.uint64)
        minima = np.zeros((n, MINIMA), dtype=np.uint64)
        if len(some):
            value = np.empty_like(hashes)
            for k in range(MINIMA):
                np.multiply(hashes, times[k], out=value)
                value += plus[k]
                minima[some, k] = np.minimum.reduceat(value, ends[some])
        bands = mixed((mixed(minima[:, : BANDS * ROWS]).reshape(n, BANDS, ROWS) * fold).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
        lists = pa.ListArray.from_arrays(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32), pa.array(bands.view(np.int64).ravel()))
        marks = (mixed(minima) >> np.uint64(56)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists,
             pa.array([row.tobytes() for row in marks], pa.binary())],
            names=["doc_id", "n_shingles", "set1", "set2", "bands", "sig"],
        )


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures and sizes allow a link."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, MINIMA) for c in ("sig_a", "sig_b"))
            p, q = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            keep = ((x == y).sum(axis=1) >= LEAST_EQUAL) & (100 * np.minimum(p, q) >= MIN_PERCENT * np.maximum(p, q))
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that are linked on their full sets; a text that comes with many partners is read once."""
    for whole in batches:
        for batch in slices(slices(iter([whole]), "text_a", 16 << 20), "text_b", 16 << 20):
            sets: dict[int, np.ndarray] = {}
            for key, text in (("a", "text_a"), ("b", "text_b")):
                ids = batch.column(key).to_numpy()
                _, firsts = np.unique(ids, return_index=True)
                firsts = np.array([f for f in firsts if ids[f] not in sets], dtype=np.int64)
                if len(firsts):
                    hashes, ends = shingles(*word_hashes(*text_bytes(batch.column(text).take(pa.array(firsts)))))
                    sets.update({ids[f]: np.unique(hashes[ends[i] : ends[i + 1]]) for i, f in enumerate(firsts)})
            keep = []
            for a, b in zip(batch.column("a").to_numpy(), batch.column("b").to_numpy()):
                x, y = sets[a], sets[b]
                both = np.sort(np.r_[x, y])
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= MIN_PERCENT * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _groups(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) row numbers of each bucket and pair of blocks of a shard; equal for a block with itself."""
    group = np.stack([rows.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
    own = rows.column("block").to_numpy()
    order = np.lexsort(group.T)
    group = group[order]
    starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
    for start, stop in zip(starts, [*starts[1:], len(order)]):
        _, i, j = group[start]
        members = order[start:stop]
        left = members[own[members] == i]
        yield left, left if i == j else members[own[members] == j]


def _fits(size: np.ndarray, p: int, q: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(size[q], size[p]) >= MIN_PERCENT * np.maximum(size[q], size[p])


def _best_partners(rows: pa.Table) -> pa.Table:
    """For each node of a shard its most similar one, by signature, in another component."""
    node, part, size = (rows.column(c).to_numpy() for c in ("node", "part", "n_shingles"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(node), -1)
    most, partner = np.full(len(node), LEAST_EQUAL - 1), np.full(len(node), -1)
    for left, right in _groups(rows):
        for p in left:
            q = right[part[right] != part[p]]
            q = q[_fits(size, p, q)]
            if len(q):
                equal = (sig[q] == sig[p]).sum(axis=1)
                better = equal > most[q]
                most[q[better]], partner[q[better]] = equal[better], p
                top = equal.argmax()
                if equal[top] > most[p]:
                    most[p], partner[p] = equal[top], q[top]
    p = np.flatnonzero(partner >= 0)
    pairs = np.stack([np.minimum(node[p], node[partner[p]]), np.maximum(node[p], node[partner[p]])])
    pairs = np.unique(pairs, axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1]})


def _links_inside(rows: pa.Table) -> pa.Table:
    """Links between different components in a shard's buckets, confirmed on the full sets here: only links leave the task.

    A pair belongs to the first band that it shares. What a link joins counts as one component from then on, so a
    large group of copies costs a few sets a node.
    """
    node, size, place = (rows.column(c).to_numpy() for c in ("node", "n_shingles", "place"))
    parts = rows.column("part").to_numpy()
    names, part = np.unique(parts, return_inverse=True)
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(node), -1)
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), BANDS)
    texts, sets, out = rows.column("text").combine_chunks(), {}, []
    label = np.arange(len(names))

    def elements(k: int) -> np.ndarray:
        if node[k] not in sets:
            sets[node[k]] = np.unique(shingles(*word_hashes(*text_bytes(texts.slice(k, 1))))[0])
        return sets[node[k]]

    for left, right in _groups(rows):
        band = int(place[left[0]]) if len(left) else 0
        for p in left:
            q = right[label[part[right]] != label[part[p]]]
            if left is right:
                q = q[q > p]
            q = q[_fits(size, p, q)]
            if not len(q):
                continue
            equal = (sig[q] == sig[p]).sum(axis=1)
            q, equal = q[equal >= LEAST_EQUAL], equal[equal >= LEAST_EQUAL]
            q = q[np.argsort(-equal, kind="stable")]
            if band:
                q = q[~(bands[q, :band] == bands[p, :band]).any(axis=1)]
            for k in q:
                if label[part[k]] == label[part[p]]:
                    continue
                x, y = elements(p), elements(k)
                both = np.sort(np.r_[x, y])
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= MIN_PERCENT * (len(both) - common):
                    out.append((min(node[p], node[k]), max(node[p], node[k])))
                    label[label == label[part[k]]] = label[part[p]]
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _with_both(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    for side in "ab":
        own = nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c.removesuffix('_shingles')}_{side}") for c in columns])
        pairs = pairs.join(own, side)
    return pairs


def _open_buckets(met: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """The members of all buckets that hold several components, dealt to pairs of blocks of their bucket."""
    labelled = met.join(parts, "node", "left").select("bucket", "place", "node", "size", F.coalesce("component", "node").alias("part"))
    several = labelled.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    return (
        labelled.join(several.select("bucket"), "bucket").withColumn("blocks", F.ceil(F.col("size") / block).cast("long"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("bucket", "place", "node", "part", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )


def _in_shards(dealt: DataFrame, held: DataFrame, weight: Column, most: int, work) -> DataFrame:
    """``work`` on shards of the dealt rows with what is ``held`` of their nodes, each of about ``most`` weight."""
    dealt = written(dealt.join(held.select("node", "n_shingles"), "node").withColumn("weight", weight).drop("n_shingles"), "minhash-open")
    total = dealt.agg(F.sum("weight")).first()[0] or 0
    shards = max(dealt.sparkSession.sparkContext.defaultParallelism, math.ceil(total / most))
    shard = F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(shards))
    return dealt.join(held, "node").withColumn("shard", shard).groupBy("shard").applyInArrow(lambda rows: work(rows), "a long, b long")


def near_texts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Words are what lies between ASCII white space after A-Z are lower-cased; a document with fewer than five has its whole
    sequence as its only shingle; a null, empty or blank text has none and links with nothing. Documents link when
    100 * |intersection| >= 75 * |union| of their shingle sets. A row without ``doc_id`` has a null component and is not kept;
    repeated rows come back as often as given, an empty table gives an empty result.
    """
    texts = docs.select("doc_id", "text")
    signed = written(texts.mapInArrow(
        _signed, "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>, sig binary"), "minhash")
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = filled.groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("node"))
    nodes = (
        filled.dropDuplicates(["doc_id"]).alias("d").join(same.alias("s"), F.expr("d.doc_id = s.node"), "left_semi")
        .select(F.col("doc_id").alias("node"), "n_shingles", "sig", "bands")
    )
    nodes = written(nodes, "minhash-nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("place", "bucket"))
    heads = banded.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    heads = written(heads, "minhash-heads")  # a table, not an aggregate: the join can then split a large bucket
    met = written(banded.join(heads, "bucket"), "minhash-buckets")
    stars = met.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    alike = _with_both(stars, nodes, "sig", "n_shingles").mapInArrow(_alike, "a long, b long")
    bodies = written(
        texts.withColumnRenamed("doc_id", "node").join(met.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]),
        "minhash-texts")
    confirm = lambda pairs: _with_both(pairs, bodies, "text").mapInArrow(_confirmed, "a long, b long")
    links = written(confirm(alike), "minhash-links")
    parts = connected_components(links)
    marks = nodes.select("node", "n_shingles", "sig")
    best = _in_shards(_open_buckets(met, parts, BLOCK), marks, F.lit(1), SHARD_ROWS, _best_partners).distinct()
    links = links.unionByName(written(confirm(best.join(stars, ["a", "b"], "left_anti")), "minhash-links"))
    parts = connected_components(links)
    full = nodes.join(bodies, "node")
    rest = _in_shards(_open_buckets(met, parts, SET_BLOCK), full, F.col("n_shingles") + 100, SET_SHARD_WEIGHT, _links_inside)
    parts = connected_components(links.unionByName(written(rest, "minhash-links")))
    groups = same.join(parts, "node", "left").select(
        F.col("set1").alias("s1"), F.col("set2").alias("s2"), F.col("n_shingles").alias("size"), F.coalesce("component", "node").alias("part"))
    out = signed.select("doc_id", "n_shingles", "set1", "set2").join(
        groups, F.expr("set1 = s1 AND set2 = s2 AND n_shingles = size AND doc_id IS NOT NULL"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("part", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))

"""Near-duplicate vectors: p-stable Euclidean hashing into several tables, then exact cosines.

For unit vectors, cosine >= c is Euclidean distance <= sqrt(2 - 2c). Each table hashes a vector with k quantised random
projections; vectors that share a bucket of some table are compared exactly. k grows with the logarithm of the number of
vectors, so that unrelated vectors seldom meet, and the number of tables follows from the miss probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import mixed, written
from lintlake.llm.components import connected_components

MIN_COSINE = 0.98
#: Chance that a pair exactly at the threshold shares no bucket (closer pairs: less).
MISS = 1e-6
#: Width of a projection's cells, in units of the threshold distance.
CELLS = 10.0
#: Vectors of one bucket that a task compares at once; a larger bucket is dealt out as pairs of blocks.
BLOCK = 2048
SHARD_ROWS = 16_384
SEED = 20_011


def _collides(width_by_distance: float) -> float:
    """Chance that two points at a distance fall into one cell of a Gaussian projection."""
    r = width_by_distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, cosine: float) -> tuple[int, int, float]:
    """(projections of a table, tables, cell width) for ``n`` vectors."""
    distance = math.sqrt(max(2 - 2 * cosine, 1e-6))
    near, far = _collides(CELLS), _collides(CELLS * distance / math.sqrt(2))
    k = max(1, math.ceil(math.log(20 * max(n, 2)) / math.log(1 / far)))
    return k, max(1, math.ceil(math.log(MISS) / math.log1p(-(near**k)))), CELLS * distance


def _hashed(batches: Iterator[pa.RecordBatch], k: int, tables: int, width: float) -> Iterator[pa.RecordBatch]:
    """Unit vectors with their bucket in every table; vectors of another length have other projections."""
    made: dict[int, tuple] = {}
    for batch in batches:
        ids, labels = batch.column("rep").to_numpy(), batch.column("label")
        kinds = np.array([xxhash.xxh64_intdigest(str(x)) for x in labels.to_pylist()], dtype=np.uint64)
        vectors = [np.asarray(v, dtype=np.float64) for v in batch.column("vector").to_pylist()]
        units, buckets = [], []
        for v, kind in zip(vectors, kinds):
            if len(v) not in made:
                rng = np.random.default_rng(SEED + len(v))
                made[len(v)] = rng.standard_normal((len(v), tables * k)), rng.random(tables * k) * width, mixed(
                    rng.integers(1, 2**63, k, dtype=np.uint64)) | np.uint64(1)
            planes, shifts, odd = made[len(v)]
            scaled = v / np.abs(v).max()
            unit = scaled / np.linalg.norm(scaled)
            cells = np.floor((unit @ planes + shifts) / width).astype(np.int64).view(np.uint64).reshape(tables, k)
            folded = mixed((mixed(cells + odd) * odd).sum(axis=1, dtype=np.uint64) ^ kind)
            units.append(unit.tobytes())
            buckets.append(mixed(folded + np.arange(tables, dtype=np.uint64) * np.uint64(len(v))).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), batch.column("copies"), pa.array(units, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
            names=["rep", "copies", "unit", "buckets"],
        )


def _labels(linked: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Smallest node that each row and column of a link matrix reaches inside of it."""
    most = np.iinfo(np.int64).max
    one, two = left.copy(), (left if right is None else right).copy()
    while True:
        new_one = np.minimum(one, np.where(linked, two[None, :], most).min(axis=1))
        new_two = np.minimum(two, np.where(linked, new_one[:, None], most).min(axis=0))
        if right is None:
            new_one = new_two = np.minimum(new_one, new_two)
        if (new_one == one).all() and (new_two == two).all():
            return one, two
        one, two = new_one, new_two


def _compared(rows: pa.Table, cosine: float) -> pa.Table:
    """Links inside of one shard: per vector the rows linked with it (n > 0), and edges that span what is linked (n = 0).

    A pair is counted in the first table in which it shares a bucket, so no list of pairs is kept to remove repeats.
    """
    group = np.stack([rows.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
    order = np.lexsort(group.T)
    group = group[order]
    starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
    rep, copies, own, place = (rows.column(c).to_numpy()[order] for c in ("rep", "copies", "block", "place"))
    units, buckets = rows.column("unit"), rows.column("buckets")
    units, buckets = units.take(order).to_pylist(), buckets.take(order).combine_chunks().flatten().to_numpy()
    buckets = buckets.reshape(len(rep), -1)
    out: list[tuple] = []
    for start, stop in zip(starts, [*starts[1:], len(rep)]):
        _, i, j = group[start]
        left = np.flatnonzero(own[start:stop] == i) + start
        right = left if i == j else np.flatnonzero(own[start:stop] == j) + start
        if len(left) == 0 or len(right) == 0 or i == j and len(left) == 1:
            continue
        x = np.frombuffer(b"".join(units[r] for r in left), dtype=np.float64).reshape(len(left), -1)
        y = x if i == j else np.frombuffer(b"".join(units[r] for r in right), dtype=np.float64).reshape(len(right), -1)
        linked = x @ y.T >= cosine
        if i == j:
            np.fill_diagonal(linked, False)
        if table := int(place[start]):
            p, q = np.nonzero(linked)
            for cut in range(0, len(p), 1 << 15):
                a, b = p[cut : cut + (1 << 15)], q[cut : cut + (1 << 15)]
                seen = (buckets[left[a], :table] == buckets[right[b], :table]).any(axis=1)
                linked[a[seen], b[seen]] = False
        if not linked.any():
            continue
        for mask, these, others in ((linked, left, right), (linked.T, right, left))[: 1 if i == j else 2]:
            out.append((rep[these], rep[these], mask @ copies[others]))
        for ids, found in zip((rep[left], rep[right]), _labels(linked, rep[left], None if i == j else rep[right])):
            out.append((ids, found, np.zeros(len(ids), np.int64)))
    a, b, n = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))
    keep = (n > 0) | (a != b)
    return pa.table({"a": a[keep], "b": b[keep], "n": n[keep]})


def near_vectors(vectors: DataFrame, cosine: float = MIN_COSINE) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id``, ``embedding``, ``label``): ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors are compared when their labels are equal and not null. A null, empty or zero vector, one that holds a null or
    non-finite component, and a row without ``vec_id`` link with nothing (the last has a null component and is not kept).
    Exactly equal vectors of a label are one node with a weight, so a large group of copies costs one comparison; a
    repeated row counts as one more copy. Vectors of different lengths do not compare.
    """
    spark = vectors.sparkSession
    values = F.transform("embedding", lambda v: v.cast("double"))
    fit = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(values, lambda v: v != 0)
    )
    rows = vectors.select("vec_id", "embedding", "label", F.coalesce(fit, F.lit(False)).alias("fit"))
    good = rows.where("fit").select("vec_id", F.transform("embedding", lambda v: v.cast("double") + 0.0).alias("vector"), "label")
    reps = good.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = written(reps, "vectors")
    n = reps.count()
    k, tables, width = shape(n, cosine)
    hashed = written(reps.mapInArrow(
        lambda batches: _hashed(batches, k, tables, width), "rep long, copies long, unit binary, buckets array<long>"), "vector-buckets")
    places = hashed.select("rep", F.posexplode("buckets").alias("place", "bucket"))
    full = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = written(places.join(full, "bucket"), "vector-meetings")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    dealt = (
        met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("bucket", "place", "rep", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    shards = max(1, math.ceil(met.agg(F.sum(blocks)).first()[0] / SHARD_ROWS)) if met.head(1) else 1
    shards = max(shards, spark.sparkContext.defaultParallelism)
    links = written(
        dealt.join(hashed, "rep").withColumn("shard", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(shards)))
        .groupBy("shard").applyInArrow(lambda rows: _compared(rows, cosine), "a long, b long, n long"),
        "vector-links",
    )
    parts = connected_components(links.where("n = 0").select("a", "b"))
    counts = links.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    groups = (
        reps.join(counts, reps["rep"] == counts["a"], "left").join(parts, reps["rep"] == parts["node"], "left")
        .select("label", "vector", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    )
    linked = good.join(groups, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("fit")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

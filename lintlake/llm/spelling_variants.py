"""Groups of spelling variants over a dictionary of trie-node pairs.

Every word stands as a path in two tries, one of the words and one of the reversed words, whose nodes are numbered. Two
words differ by one replaced code point if a position can be skipped in both so that the node before it and the node
after it are the same; by one inserted code point if such a pair of the longer word equals a pair of the shorter one
with nothing skipped. Equal node numbers mean equal strings, so the joins on integer pairs are exact and confirm nothing.

The tries are numbered by scans over sorted words: ranges of words are numbered apart, each in one task, and the few nodes
that a border of two ranges cuts are named alike afterwards. A node that only one word passes through can be in no common
pair, so a word keeps the upper part of both paths only, and few of its pairs are moved.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import slices, written

#: Code points that a word must have, and occurrences over all documents.
MIN_LENGTH, MIN_COUNT = 7, 2
#: A form is at least so many times as frequent as its variant.
RATIO = 10
#: Every so many pairs of document and run lose a code point.
TYPO_RATE = 31
_RUN = re.compile("[a-zÀ-ÿ]+")
#: Node numbers of a range of words: its partition above these bits, a running number below; 0 is the root of all.
_PART_SHIFT = 40
_SKIP, _SKIP_FIRST, _GAP = 0, 1, 2


def runs_of(doc_id, text: str, min_length: int = MIN_LENGTH) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of the letter runs of one text, each after its possible loss of a code point."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
        if len(run) >= min_length:
            h = zlib.crc32(run.encode(), start)
            if not h % TYPO_RATE:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < min_length:
                    continue
            yield run, n


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(``word``, ``n``) over all documents; counted within blocks of texts before anything is moved."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            total: Counter = Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in runs_of(doc_id, text, min_length) if text else ():
                    total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def shared_prefix(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    step = 0
    while a[step] == b[step]:
        step += 1
    return step


def paths(words: Iterator[str], part: int) -> Iterator[np.ndarray]:
    """For ascending distinct words of one range: the numbers of the nodes on each word's path, from the root down.

    A path ends with the last node that another word of the range passes too. The first and the last word keep their whole
    paths, as words of the neighbouring ranges may share them.
    """
    last, path, used, upper = None, [0], part << _PART_SHIFT, 0
    for word in words:
        keep = 0
        if last is not None:
            keep = shared_prefix(last, word)
            yield np.array(path[: max(upper, keep) + 1], np.int64)
        used += 1
        path = [*path[: keep + 1], *range(used, used + len(word) - keep)]
        used += len(word) - keep
        upper = len(word) if last is None else keep
        last = word
    if last is not None:
        yield np.array(path, np.int64)


def _numbered(rows: DataFrame, key: str, out: str, name: str) -> DataFrame:
    """``rows`` in ranges of ``key`` with ``part`` (the range), ``id`` (ascending with ``key``) and ``out``, the path of ``key``."""
    kept = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []

        def words() -> Iterator[str]:
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    yield from batch.column(key).to_pylist()

        found, at, place = [], 0, part << _PART_SHIFT
        for path in paths(words(), part):
            found.append(path)
            if len(found) == held[at].num_rows:
                yield _with_paths(held[at], part, place, found)
                place += len(found)
                held[at], found, at = None, [], at + 1

    def _with_paths(batch: pa.RecordBatch, part: int, place: int, found: list) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in found])])
        path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found)))
        n = len(found)
        columns = [*batch.columns, pa.array(np.full(n, part)), pa.array(place + np.arange(n)), path]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", f"{out}_id", out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    ranged = rows.repartitionByRange(key).sortWithinPartitions(key)
    return written(ranged.mapInArrow(run, f"{schema}, part long, {out}_id long, {out} array<long>"), name)


def _same_nodes(numbered: DataFrame, key: str, out: str) -> dict[int, int]:
    """Numbers of nodes that an earlier range has already, with the number there.

    Only the first and the last word of each range are collected: what a border cuts lies on both their paths.
    """
    place = f"{out}_id"
    ends = numbered.groupBy("part").agg(
        F.min_by(F.struct(key, out), place).alias("first"), F.max_by(F.struct(key, out), place).alias("last")).orderBy("part").collect()
    same: dict[int, int] = {}
    for left, right in zip(ends, ends[1:]):
        common = shared_prefix(left["last"][key], right["first"][key])
        for depth in range(1, common + 1):
            there = left["last"][out][depth]
            same[right["first"][out][depth]] = same.get(there, there)
    return same


def word_pairs(word: str, prefix: list[int], suffix: list[int]) -> Iterator[tuple[int, int, int]]:
    """(prefix node, suffix node, kind) of every position whose two nodes are shared with other words.

    A deletion inside of a run of equal code points gives the same string at each of its places; only the first is
    marked, so that an insertion is found once.
    """
    n, a, b = len(word), len(prefix) - 1, len(suffix) - 1
    for i in range(max(0, n - 1 - b), min(a, n - 1) + 1):
        yield prefix[i], suffix[n - 1 - i], _SKIP if i and word[i - 1] == word[i] else _SKIP_FIRST
    for i in range(max(0, n - b), min(a, n) + 1):
        yield prefix[i], suffix[n - i], _GAP


def _pairs(numbered: DataFrame, same_prefix: dict[int, int], same_suffix: dict[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            columns = (batch.column(c).to_pylist() for c in ("word", "n", "pre_id", "pre", "suf"))
            for word, n, place, pre, suf in zip(*columns):
                pre, suf = [same_prefix.get(x, x) for x in pre], [same_suffix.get(x, x) for x in suf]
                for p, s, kind in word_pairs(word, pre, suf):
                    for values, value in zip(out, (p, s, kind, place, n)):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["p", "s", "kind", "id", "n"])

    return numbered.select("word", "n", "pre_id", "pre", "suf").mapInArrow(run, "p long, s long, kind long, id long, n long")


def _near(pairs: DataFrame) -> DataFrame:
    """(``id``, ``n_near``, ``best`` = (n, -id) of the most frequent near word).

    Words that share a pair differ in the one code point skipped, so a pair has no more words than the alphabet has letters
    (90) and one that skips nothing. A near word is met in exactly one pair.
    """
    member = F.struct(F.col("n").alias("n"), (-F.col("id")).alias("neg"), F.col("kind").alias("kind"))
    met = pairs.groupBy("p", "s").agg(F.sort_array(F.collect_list(member), asc=False).alias("all")).where("size(all) > 1")
    met = met.select(
        F.filter("all", lambda x: x["kind"] != _GAP).alias("skips"), F.filter("all", lambda x: x["kind"] == _SKIP_FIRST).alias("firsts"),
        F.filter("all", lambda x: x["kind"] == _GAP).alias("gaps"), F.explode("all").alias("x"))
    x = F.col("x")
    plain = lambda y: F.when(y.isNotNull(), F.struct(y["n"].alias("n"), y["neg"].alias("neg")))
    other = F.when(F.get("skips", F.lit(0))["neg"] == x["neg"], F.get("skips", F.lit(1))).otherwise(F.get("skips", F.lit(0)))
    gap = F.when(x["kind"] == _SKIP_FIRST, F.get("gaps", F.lit(0)))
    near = F.when(x["kind"] == _GAP, F.size("firsts")).otherwise(
        F.size("skips") - 1 + F.when(x["kind"] == _SKIP_FIRST, F.size("gaps")).otherwise(0))
    best = F.when(x["kind"] == _GAP, plain(F.get("firsts", F.lit(0)))).otherwise(F.greatest(plain(other), plain(gap)))
    found = met.select((-x["neg"]).alias("id"), near.cast("long").alias("near"), best.alias("best")).where("near > 0")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(``id``, ``root_id``) by pointer doubling. A form is ten times as frequent as its variant, so chains are short."""
    ends = written(forms.select("id", F.col("form_id").alias("root_id")), "variant-roots")
    while True:
        ahead = ends.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        step = ends.join(ahead, "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved"))
        step = written(step, "variant-roots")
        ends = step.select("id", "root_id")
        if not step.where("moved").limit(1).count():
            return ends


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(``word``, ``n``, ``form``, ``form_n``, ``root``, ``n_near``) of every row of ``words`` (``word``, ``n``).

    ``n_near`` counts the words that differ by exactly one inserted, deleted or replaced code point. The form is the near
    word of the largest ``n`` (of equal ones the smallest in code-point order), if that is at least ``ratio`` times the word's;
    else null. The root is the end of the chain of forms. ``word`` must be unique and not null; ``words`` should be a written
    table, as it is read once for each trie. An empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("with a ratio below 2 chains of forms could close")
    forward = _numbered(words.select("word", "n"), "word", "pre", "variant-prefixes")
    same_prefix = _same_nodes(forward, "word", "pre")
    backward = _numbered(forward.select("word", "n", "pre_id", "pre", F.reverse("word").alias("rev")), "rev", "suf", "variant-suffixes")
    near = written(_near(_pairs(backward, same_prefix, _same_nodes(backward, "rev", "suf"))), "variant-near")
    named = forward.select(F.col("pre_id").alias("id"), "word", "n")
    linked = named.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.neg")).alias("form_id"))
    linked = written(linked, "variant-links")
    forms = linked.where("form_id IS NOT NULL").select("id", "form_id")
    ends = forms.join(_roots(forms), "id")
    ends = ends.join(named.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n")), "form_id")
    ends = ends.join(named.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id")
    return linked.select("id", "word", "n", "n_near").join(ends.select("id", "form", "form_n", "root"), "id", "left").select(
        "word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """The variants (``group_variants``) of the words of all documents.

    Words are the runs of the letters A-Z, a-z and U+00C0 to U+00FF of whole texts with A-Z lower-cased; of every 31st pair of
    document and run (by crc32 of ``<doc_id>:<run>``) one code point is left out, a planted slip. Words of fewer than
    ``min_length`` code points or ``min_count`` occurrences are left out. A null text has no words; a null id counts as an
    empty one; repeated rows count again; columns other than ``doc_id`` and ``text`` are not read.
    """
    return group_variants(written(word_counts(docs, min_length, min_count), "variant-words"), ratio)

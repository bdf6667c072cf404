"""Collocations by dynamic itemset counting.

The documents are dealt into shards, which are scanned one after the other in a cycle; each scan is one Spark job. Words are
counted from the first scan on. As soon as both shorter phrases within a longer one have reached the least count, the longer
one is counted too, from the next scan on, and for exactly one cycle: every shard once. So long phrases are counted while
short ones still are, and a phrase that becomes active in the middle of a cycle ends in the middle of the next.

When a phrase became active follows from two small tables that every scan carries: at which scan a word, or a phrase, first
reached the least count, by a hash of it. Their size is fixed. Phrases that share a place with another one may be counted
without need, never too late and never twice: when counting starts and ends follows from the table alone, for all scans alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import mixed, slices, written

MAX_WORDS, MIN_COUNT, TOP = 3, 10, 2000
#: Shards of a cycle.
SHARDS = 2
#: Places of the table of each length: one byte each, carried by every scan.
PLACES = 1 << 22
#: A phrase is dropped for a longer one that has at least so many of its occurrences, in hundredths.
INSIDE_PERCENT = 50
#: Times that a block of texts must hold a phrase for the task to add it up over all its blocks; phrases so held at most.
OFTEN, MOST_HELD = 8, 1 << 17
_NEVER = 127
_BREAK = re.compile(rb"[.,;:!?\n-\r]+")


def piece_codes(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, number of every word of the texts in order, -1 between pieces); only A-Z are lower-cased."""
    body = _BREAK.sub(b" . ", b"\n".join(texts).lower())
    coded = pa.array(body.split(), pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    stop = pc.index(coded.dictionary, b".").as_py()  # no word holds a stop
    codes[codes == stop] = -1
    return coded.dictionary, codes


def places(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) & np.uint64(PLACES - 1)).astype(np.int64)


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of phrases from the hashes of what is before their last word and of the last word."""
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    """Hashes of words of one language, the same in all processes."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return mixed(pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) + np.uint64(xxhash.xxh64_intdigest(lang.encode())))


def phrase_hashes(lang: str, phrases: list[bytes]) -> np.ndarray:
    """Hashes of phrases of equal length."""
    words = list(zip(*(p.split(b" ") for p in phrases)))
    out = word_hashes(lang, pa.array(words[0], pa.binary()))
    for column in words[1:]:
        out = joined(out, word_hashes(lang, pa.array(column, pa.binary())))
    return out


def _names(words: pa.Array, grams: np.ndarray) -> pa.Array:
    """The phrases of rows of word numbers."""
    return pc.binary_join_element_wise(*[words.take(pa.array(column)) for column in grams.T], b" ")


def counted(lang: str, texts: list[bytes], step: int, shards: int, reached: list[np.ndarray], counting: list[bool]) -> Iterator[tuple]:
    """(length, start, phrases, counts) of what is active at scan ``step`` in texts of one language.

    ``reached[k]``: by place, the scan after which a phrase of k + 1 words had the least count; ``counting[k]``: whether
    any phrase of k + 1 words is still within its cycle.
    """
    words, codes = piece_codes(texts)
    if counting[0]:
        n = np.bincount(codes[codes >= 0], minlength=len(words))
        used = np.flatnonzero(n)
        yield 1, 0, words.take(pa.array(used)), n[used]
    own, base = word_hashes(lang, words), len(words)
    hashes = own
    # at: the phrase of k - 1 words that starts at each place of codes, as a row of grams; levels: its level, if there is one
    at, grams = codes, np.arange(base)[:, None]
    levels = np.full(len(codes), _NEVER, np.int64)
    levels[codes >= 0] = reached[0][places(hashes)][codes[codes >= 0]]
    for k in range(2, len(counting) + 1):
        before, after = levels[:-1], levels[1:]
        where = np.flatnonzero((before < _NEVER) & (after < _NEVER))
        if not len(where) or not any(counting[k - 1 :]):
            return
        inverse, keys = pd.factorize(at[where] * base + codes[where + k - 1])
        n = np.bincount(inverse)
        heads, tails = keys // base, keys % base
        grams = np.column_stack([grams[heads], tails])
        begins = np.maximum(before[where], after[where]) + 1
        if counting[k - 1]:
            start = np.zeros(len(keys), np.int64)
            start[inverse] = begins
            for s in range(max(1, step - shards + 1), step + 1):
                chosen = np.flatnonzero(start == s)
                if len(chosen):
                    yield k, s, _names(words, grams[chosen]), n[chosen]
        if k < len(counting):
            hashes = joined(hashes[heads], own[tails])
            level = reached[k - 1][places(hashes)]
            at, levels = np.full(len(at) - 1, -1, np.int64), np.full(len(at) - 1, _NEVER, np.int64)
            # Another phrase of its place may have been frequent before this one could be.
            at[where], levels[where] = inverse, np.maximum(level[inverse], begins)


def _rows(k: int, start: int, lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    size = len(phrases)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, k, np.int32)), pa.array(np.full(size, start, np.int32)), pa.array([lang], pa.string()).take(pa.array(np.zeros(size, np.int64))),
         phrases.cast(pa.string()), pa.array(n, pa.int64())], names=["k", "start", "lang", "phrase", "f"])


def _scan(shard: DataFrame, step: int, shards: int, tables: Broadcast, counting: list[bool]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: dict[tuple, Counter] = {}  # what a block of texts holds often leaves the task once
        for batch in slices(batches, "text"):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for k, start, phrases, n in counted(lang, texts, step, shards, tables.value, counting):
                    often = n >= OFTEN
                    held = frequent.setdefault((k, start, lang), Counter())
                    for phrase, f in zip(phrases.filter(pa.array(often)).to_pylist(), n[often].tolist()):
                        held[phrase] += f
                    yield _rows(k, start, lang, phrases.filter(pa.array(~often)), n[~often])
                    if len(held) > MOST_HELD:
                        yield _rows(k, start, lang, pa.array(held, pa.binary()), np.array(list(held.values())))
                        held.clear()
        for (k, start, lang), held in frequent.items():
            yield _rows(k, start, lang, pa.array(held, pa.binary()), np.array(list(held.values()), np.int64))

    return shard.select("lang", "text").mapInArrow(run, "k int, start int, lang string, phrase string, f long")


def _mark(level: np.ndarray, frequent: DataFrame, step: int) -> None:
    """Set the places of ``frequent`` (``lang``, ``phrase``) that had no level yet to ``step``.

    What comes to the driver is one bit a place in words of 64: at most ``PLACES / 64`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist()):
                by_lang.setdefault(lang, []).append(phrase)
            for lang, phrases in by_lang.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(places(phrase_hashes(lang, phrases))))], names=["place"])

    found = frequent.select("lang", "phrase").mapInArrow(run, "place long")
    bits = found.groupBy(F.expr("place div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 AS int)))").alias("bits")).toArrow()
    words = bits.column("word").to_numpy().astype(np.int64)
    bits = bits.column("bits").to_numpy().astype(np.int64).view(np.uint8).reshape(-1, 8)
    word, bit = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
    place = words[word] * 64 + bit
    place = place[level[place] == _NEVER]
    level[place] = step


def count_phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, shards: int = SHARDS) -> list[DataFrame]:
    """By length, a table (``lang``, ``phrase``, ``f``): all words, and all longer phrases with ``min_count`` occurrences.

    All counts are exact and over all documents. ``docs`` has ``lang`` (null: ``und``) and ``text`` (null: empty). The
    words of a phrase stand next to each other in a piece of a text (``[.,;:!?\\x0A-\\x0D]`` end a piece, blanks and tabs a word).
    """
    if max_words < 2 or min_count < 1 or not 1 <= shards < 32:
        raise ValueError("phrases have two words at least, counts are positive, and shards between 1 and 31")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text <> ''")
    dealt = written(rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")), "phrase-shards", "shard")
    reached = [np.full(PLACES, _NEVER, np.int8) for _ in range(max_words - 1)]
    done: list[list[DataFrame]] = [[] for _ in range(max_words)]
    running, step = None, 0
    while True:
        starts = [[0], *[(np.unique(level[level < _NEVER]).astype(int) + 1).tolist() for level in reached]]
        counting = [any(s <= step < s + shards for s in of_length) for of_length in starts]
        if not any(counting):
            return [_union(tables, docs) for tables in done]
        tables = docs.sparkSession.sparkContext.broadcast(reached)
        found = _scan(dealt.where(F.col("shard") == step % shards), step, shards, tables, counting)
        both = found if running is None else found.unionByName(running)
        # The scan has summed up its blocks already: sums are formed behind the exchange only. Of longer phrases whose cycle
        # ends here only the frequent ones are of further use.
        summed = both.repartition("lang", "phrase").groupBy("k", "start", "lang", "phrase").agg(F.sum("f").alias("f"))
        summed = summed.where((F.col("k") == 1) | (F.col("start") > step - shards + 1) | (F.col("f") >= min_count))
        total = written(summed, "phrase-counts", "k", "start")
        tables.unpersist()
        for k in range(1, max_words + 1):
            if counting[k - 1]:
                if step - shards + 1 in starts[k - 1]:
                    done[k - 1].append(total.where((F.col("k") == k) & (F.col("start") == step - shards + 1)))
                if k < max_words:
                    _mark(reached[k - 1], total.where((F.col("k") == k) & (F.col("f") >= min_count)), step)
        running = total.where(F.col("start") > step - shards + 1)
        step += 1


def _union(tables: list[DataFrame], docs: DataFrame) -> DataFrame:
    out = docs.sparkSession.createDataFrame([], "lang string, phrase string, f long")
    for table in tables:
        out = out.unionByName(table.select("lang", "phrase", "f"))
    return out


def _words(phrase: F.Column, first: F.Column, n: F.Column) -> F.Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """(``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``): the ``top`` phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` its two parts at the cut with the lowest score (of equal ones the first),
    ``n`` all words of the language; the score is floor(1000000 a a / (l r)). A phrase within a longer one that has half of
    its occurrences is left out. Order: score and ``a`` descending, then the phrase in byte order. A null text counts as
    empty, a null language as ``und``; repeated rows count again; an empty table gives an empty one.
    """
    by_length = count_phrases(docs, max_words, min_count, shards)
    n = by_length[0].groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = [t.where(F.col("f") >= min_count) for t in by_length]
    parts = written(frequent[0].unionByName(_union(frequent[1:-1], docs)), "phrase-parts")
    found = [t.withColumn("k", F.lit(k)) for k, t in enumerate(frequent[1:], 2)]
    longer = found[0]
    for t in found[1:]:
        longer = longer.unionByName(t)
    longer = written(longer, "phrase-candidates")
    cuts = longer.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "k", F.col("f").alias("a"), "cut", _words(F.col("phrase"), F.lit(1), F.col("cut")).alias("left"),
        _words(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    # a is at most l and r, so the quotient is at most 1,000,000; the products need up to 38 digits.
    score = F.expr("(1000000BD * cast(a AS decimal(15,0)) * cast(a AS decimal(15,0))) div (cast(l AS decimal(15,0)) * cast(r AS decimal(15,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("at"))
    inner = longer.where("k > 2").select("lang", F.col("f").alias("inside"), F.explode(F.array(
        _words(F.col("phrase"), F.lit(1), F.col("k") - 1), _words(F.col("phrase"), F.lit(2), F.col("k") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("inside").alias("inside"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(
        F.col("inside").isNull() | (100 * F.col("inside") < INSIDE_PERCENT * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "at.l", "at.r", "at.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))

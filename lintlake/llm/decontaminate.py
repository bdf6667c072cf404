"""Benchmark passages in documents: latent semantic retrieval, then sequence and answer checks.

1. Document frequencies of hashed words over all documents.
2. A latent space from a distributed randomised SVD of TF-IDF passages: all passages of the benchmark and all passages of the
   corpus, over the terms of the benchmark (a word that no item has tells no items apart; it counts in the length of a passage).
3. Every passage of every document is folded into that space and compared with all benchmark passages by cosine.
4. The candidates are checked on the words themselves: the longest common subsequence, and for paraphrases the telling words of
   the answer (the last sentence).

The space has a fixed rank, so a benchmark is searched in blocks of as many items as that rank tells apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import mixed, slices, text_bytes
from lintlake.llm.minhash_dedup import word_hashes

#: Hashed terms, rank of the latent space and the extra directions of the randomised range finder.
TERMS = 1 << 18
RANK, OVERSAMPLE = 256, 16
#: Words of a passage and the step to the next: passages overlap by half.
WINDOW, STEP = 64, 32
#: Benchmark items of a latent space: fewer than its rank. A larger benchmark is searched in more blocks.
BLOCK_ITEMS = 200
#: All passages of the corpus together weigh as much in the fit of a latent space as so many passages of the benchmark, or as many as
#: they are if they are fewer: else a large corpus would leave the benchmark no direction of its own.
CORPUS_WEIGHT = 2048
#: Cosine from which a pair is checked word by word: set low, as the checks decide.
MIN_COSINE = 0.13
#: Words in more documents than this number and this share are common: they tell nothing about an answer.
COMMON_DOCUMENTS, COMMON = 50, 0.02
#: Telling words that an answer must have to decide anything.
ANSWER_WORDS = 3
#: Share of an item's words in common order from which it counts as copied, and, if its answer is there too, as paraphrased.
COPIED, PARAPHRASED, ANSWERED = 0.75, 0.5, 0.8
#: A term is multiplied from more than one occurrence in so many stretches of text; passages that are folded at once.
_DENSE, _PASSAGES = 120, 4096
FOUND = "doc_id long, item_id long, lcs double, answer double, start_word long"
SEED = 9_091


@dataclass(frozen=True)
class Item:
    """A benchmark item as word hashes, and those of its answer."""

    item_id: int
    text: str
    words: np.ndarray
    answer: np.ndarray


def _words(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    hashes, ends = _blocked(pa.array(texts, pa.string()))
    return [hashes[a:b] for a, b in zip(ends[:-1], ends[1:])]


#: Bytes between words: all of ASCII but letters and digits, so that edits of punctuation change nothing.
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _blocked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a block of texts, and the n + 1 offsets of each text's words."""
    return word_hashes(*text_bytes(pa.compute.utf8_lower(column)), _BETWEEN)


def _terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(11)).astype(np.int64) % TERMS


def _passages(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, text) of every passage of a block of texts, in order; they cover every word."""
    counts = np.diff(ends)
    number = np.where(counts > WINDOW, -(-(counts - WINDOW) // STEP) + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), number)
    place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    start = ends[text] + place * STEP
    return start, np.minimum(start + WINDOW, ends[text + 1]), text


def read_items(benchmark: DataFrame, low: tuple[int, str] | None = None) -> list[Item]:
    """The next ``BLOCK_ITEMS`` different items after ``low`` by id and text; null ids and null texts are passed over."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    if low is not None:
        rows = rows.where((F.col("item_id") > low[0]) | (F.col("item_id") == low[0]) & (F.col("text") > low[1]))
    rows = rows.distinct().orderBy("item_id", "text").limit(BLOCK_ITEMS).collect()
    bodies = [row["text"] for row in rows]
    answers = [next((x for x in reversed(re.split(r"(?<=[.!?])\s+|\n+", t.strip())) if any(c.isalnum() for c in x)), t) for t in bodies]
    return [Item(r["item_id"], r["text"], w, a) for r, w, a in zip(rows, _words(bodies), _words(answers))]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """In how many of all documents each hashed term occurs, the number of documents and that of their passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, passages = np.zeros(TERMS, np.int64), 0, 0
        for batch in slices(batches, "text", 1 << 20):
            hashes, ends = _blocked(batch.column("text"))
            rows += batch.num_rows
            passages += len(_passages(ends)[0])
            key = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(ends)) * TERMS + _terms(hashes)
            key = np.sort(key.astype(np.int32) if batch.num_rows <= 1 << 12 else key)
            total += np.bincount(key[np.diff(key, prepend=-1) > 0] % TERMS, minlength=TERMS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, some]), pa.array(np.r_[passages, rows, total[some]])], names=["term", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [pa.array([batch.column(name).to_numpy().tobytes()], pa.binary()) for name in ("term", "n")]
            yield pa.RecordBatch.from_arrays(bodies, names=["term", "n"])

    out = np.zeros(TERMS + 2, np.int64)  # the two last ones, by negative index, are passages and documents
    sums = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for row in sums.mapInArrow(packed, "term binary, n binary").toLocalIterator():
        out[np.frombuffer(row["term"], np.int64)] = np.frombuffer(row["n"], np.int64)
    return out[:TERMS], int(out[-1]), int(out[-2])


def _signs(terms: np.ndarray, width: int) -> np.ndarray:
    """Rows of the random test matrix: signs drawn by the term, so that no task needs the whole matrix."""
    seeds = mixed(terms.astype(np.uint64) + np.uint64(SEED))[:, None] * (np.arange(width, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    return ((mixed(seeds) >> np.uint64(63)).astype(np.float32) * 2 - 1)


def _lengths(terms: np.ndarray, start: np.ndarray, stop: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Euclidean length of the TF-IDF vector of each passage, repeated words counted as one of more weight."""
    at = start[:, None] + np.arange(WINDOW)
    own = np.where(at < stop[:, None], terms[np.minimum(at, len(terms) - 1)], TERMS).astype(np.int32)
    own.sort(axis=1)
    first = np.ones(own.shape, bool)
    first[:, 1:] = own[:, 1:] != own[:, :-1]
    runs = np.flatnonzero(first)
    weight = np.diff(runs, append=own.size) * np.append(idf, 0)[own.ravel()[runs]]
    return np.sqrt(np.bincount(runs // WINDOW, weight**2, len(start)))


class _Folder:
    """Sums of one row of a matrix for each word of a passage that has one.

    Words that are frequent in a block of texts are counted by place and multiplied, all others are added one by one.
    """

    def __init__(self, terms: np.ndarray, rows: np.ndarray):
        self.rows = rows
        self.place = np.full(TERMS, -1, np.int32)
        self.place[terms] = np.arange(len(terms))

    def cut(self, own: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """Take the passages of a block: where they overlap, what lies between two edges is summed once."""
        self.cuts = np.unique(np.concatenate([start, stop]))
        self.low, self.high = np.searchsorted(self.cuts, start), np.searchsorted(self.cuts, stop)
        self.most = int((self.high - self.low).max(initial=1))
        place = self.place[own]
        known = np.flatnonzero(place >= 0)
        place, between = place[known], np.searchsorted(self.cuts, known, side="right") - 1
        column = np.full(len(self.rows), -1, np.int64)
        self.often = np.flatnonzero(np.bincount(place, minlength=len(column)) > len(self.cuts) / _DENSE)
        column[self.often] = np.arange(len(self.often))
        dense = column[place] >= 0
        cells = between[dense] * len(self.often) + column[place[dense]]
        self.counts = np.bincount(cells, minlength=len(self.cuts) * len(self.often)).astype(np.float32).reshape(len(self.cuts), -1)
        self.of_rest, self.between = place[~dense], between[~dense]

    def folded(self) -> np.ndarray:
        """The sum of each passage."""
        sums = self.counts @ self.rows[self.often]
        _add_rows(sums, self.between, self.rows, self.of_rest)
        out = sums[self.low]
        for step in range(1, self.most):
            more = self.low + step < self.high
            out[more] += sums[self.low[more] + step]
        return out

    def spread(self, rows: np.ndarray, total: np.ndarray) -> None:
        """The way back: add to each term's row of ``total`` the row of every passage, as often as it holds the term."""
        sums = np.zeros((len(self.cuts), rows.shape[1]), np.float32)
        for step in range(self.most):
            more = self.low + step < self.high
            sums[self.low[more] + step] += rows[more]
        total[self.often] += self.counts.T @ sums
        _add_rows(total, self.of_rest, sums, self.between)


def _add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray, of: np.ndarray) -> None:
    """Add ``rows[of]`` to ``total[at]``, in rounds of different ``at``."""
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    turn = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
    by_turn = np.argsort(turn, kind="stable")
    for part in np.split(by_turn, np.cumsum(np.bincount(turn))[:-1]) if len(at) else ():
        total[at[part]] += rows[of[part]]


def _runs(own: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words and passages of a block, ``_PASSAGES`` at a time: a long text takes no more memory than others."""
    for k in range(0, len(start), _PASSAGES):
        a, b = start[k], stop[k : k + _PASSAGES].max()
        yield own[a:b], start[k : k + _PASSAGES] - a, stop[k : k + _PASSAGES] - a


def latent_space(docs: DataFrame, passages: list[np.ndarray], idf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms, their rows of the latent space) by a randomised SVD of unit TF-IDF vectors over the terms of ``passages``.

    The vectors are those of ``passages`` (terms of the benchmark's) and of all ``n`` passages of ``docs``. For the matrix A of
    them and a random basis R, one distributed pass adds up A'AR by term; R'A'AR is the Gram matrix of the passages in the
    random basis, and A'AR in its orthonormal form is what a second pass would add up. The driver sees matrices of the rank only.
    """
    width = RANK + OVERSAMPLE
    terms = np.unique(np.concatenate(passages))
    signs = _signs(terms, width)
    shared = docs.sparkSession.sparkContext.broadcast((terms, idf.astype(np.float32)))

    def added(folder: _Folder, own, start, stop, idf, total) -> None:
        for own, start, stop in _runs(own, start, stop):
            folder.cut(own, start, stop)
            folder.spread(folder.folded() / np.maximum(_lengths(own, start, stop, idf) ** 2, 1e-12)[:, None].astype(np.float32), total)

    def of_corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = shared.value
        folder = _Folder(terms, _signs(terms, width) * idf[terms][:, None])
        total = np.zeros((len(terms), width))
        for batch in slices(batches, "text", 256 << 10):
            hashes, ends = _blocked(batch.column("text"))
            if len(hashes):
                added(folder, _terms(hashes), *_passages(ends)[:2], idf, total)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array([x.tobytes() for x in total[some].astype(np.float32)], pa.binary())], names=["place", "row"])

    def summed(rows: pa.Table) -> pa.Table:
        places, at = np.unique(rows.column("place").to_numpy(), return_inverse=True)
        total = np.zeros((len(places), width))
        for k, row in zip(at, rows.column("row")):
            total[k] += np.frombuffer(row.as_buffer(), np.float32)
        return pa.table({"place": places, "row": pa.array([x.tobytes() for x in total.astype(np.float32)], pa.binary())})

    ends = np.r_[0, np.cumsum([len(x) for x in passages])]
    z = np.zeros((len(terms), width))
    added(_Folder(terms, signs * idf[terms][:, None].astype(np.float32)), np.concatenate(passages), ends[:-1], ends[1:], idf, z)
    parts = docs.select("text").mapInArrow(of_corpus, "place long, row binary").withColumn("shard", F.pmod("place", F.lit(64)))
    for row in parts.groupBy("shard").applyInArrow(summed, "place long, row binary").toLocalIterator():
        z[row["place"]] += np.frombuffer(row["row"], np.float32) * min(1.0, CORPUS_WEIGHT / max(n, 1))
    shared.destroy()
    z *= idf[terms][:, None]
    sums = signs.T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh((sums + sums.T) / 2)
    good = values > max(values.max(), 0) * 1e-6  # rows are added up in single precision
    if not good.any():
        return np.zeros(0, np.int64), np.zeros((0, 1), np.float32)
    b = z @ (vectors[:, good] / np.sqrt(values[good]))  # terms x range
    values, vectors = np.linalg.eigh(b.T @ b)
    order = np.argsort(values)[::-1][:RANK]
    order = order[values[order] > values.max() * 1e-9]
    return terms, (b @ (vectors[:, order] / np.sqrt(values[order]))).astype(np.float32)


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one bit vector operation per word of ``b``."""
    places: dict[int, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        hit = places.get(word)
        if hit:
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


class _Searcher:
    """What a task needs of a block of items, prepared once."""

    def __init__(self, shared):
        self.names, bodies, answers, idf, terms, self.space, self.queries, self.owners = shared.value
        self.squares = idf.astype(np.float32) ** 2
        self.folder = _Folder(terms, self.space * idf[terms].astype(np.float32)[:, None])
        self.bodies, self.answers = [x.tolist() for x in bodies], [x.tolist() for x in answers]
        # Per item its different words, how often each occurs if any is repeated, and the places that a find must hold.
        self.sets = [frozenset(x) for x in self.bodies]
        self.times = [Counter(x) if len(x) > len(y) else None for x, y in zip(self.bodies, self.sets)]
        self.least = [PARAPHRASED * len(x) for x in self.bodies]
        self.margin = max(map(len, self.bodies))

    def scores(self, own: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Cosine of each passage, folded into the latent space, with each query."""
        energy = np.concatenate([[0], np.cumsum(self.squares[own], dtype=np.float64)])
        norm = np.sqrt(energy[stop] - energy[start]) + 1e-9
        out = np.zeros((len(start), len(self.queries)), np.float32)
        for k, run in enumerate(_runs(own, start, stop)):
            self.folder.cut(*run)
            np.matmul(self.folder.folded(), self.queries.T, out=out[k * _PASSAGES :][: len(run[1])])
        return out / norm[:, None].astype(np.float32)

    def found(self, column: pa.Array) -> dict[tuple[int, int], tuple[float, float, int]]:
        """(share in common order, share of the answer, minus the first word) of each (text, item) that is found."""
        hashes, ends = _blocked(column)
        out: dict[tuple[int, int], tuple[float, float, int]] = {}
        if not len(hashes):
            return out
        start, stop, text = _passages(ends)
        near, query = np.nonzero(self.scores(_terms(hashes), start, stop) >= MIN_COSINE)
        words_of, passage = hashes.tolist(), -1
        for p, i in dict.fromkeys(zip(near.tolist(), self.owners[query].tolist())):
            if p != passage:
                # The words around the passage, as far as the longest item could reach: most items are ruled out by them.
                passage, low, high = p, int(ends[text[p]]), int(ends[text[p] + 1])
                around = set(words_of[max(low, int(start[p]) - self.margin) : min(high, int(stop[p]) + self.margin)])
            held = self.sets[i] & around
            if (len(held) if self.times[i] is None else sum(self.times[i][w] for w in held)) < self.least[i]:
                continue
            words, margin = self.bodies[i], len(self.bodies[i])
            region = words_of[max(low, int(start[p]) - margin) : min(high, int(stop[p]) + margin)]
            share = common_length(words, region) / len(words)
            if share < PARAPHRASED:
                continue
            answer = common_length(self.answers[i], region) / len(self.answers[i]) if self.answers[i] else 0.0
            if share >= COPIED or answer >= ANSWERED:
                key = int(text[p]), i
                out[key] = max(out.get(key, (-1.0, -1.0, 0)), (share, answer, -int(start[p] - ends[text[p]])))
        return out


def _search(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    searcher = _Searcher(shared)
    for batch in slices(batches, "text", 256 << 10):
        found = searcher.found(batch.column("text"))
        keys = sorted(found)
        ids = batch.column("doc_id").take(pa.array([k[0] for k in keys], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([searcher.names[k[1]] for k in keys], pa.int64()), pa.array([found[k][0] for k in keys], pa.float64()),
             pa.array([found[k][1] for k in keys], pa.float64()), pa.array([-found[k][2] for k in keys], pa.int64())],
            names=["doc_id", "item_id", "lcs", "answer", "start_word"])


def _clean(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    searcher = _Searcher(shared)
    for batch in slices(batches, "text", 256 << 10):
        hit = {text for text, _ in searcher.found(batch.column("text"))}
        yield batch.filter(pa.array([k not in hit for k in range(batch.num_rows)], pa.bool_()))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(``doc_id``, ``item_id``, ``lcs``, ``answer``, ``start_word``) of every benchmark item found in a document.

    An item is found when at least ``COPIED`` of its words stand in common order near one passage of the document, or at least
    ``PARAPHRASED`` of them and ``ANSWERED`` of the telling words of its answer, if that has ``ANSWER_WORDS`` of them. Only passages
    whose cosine to the item in the latent space is ``MIN_COSINE`` or more are compared: the README gives the recall against a
    comparison of all. The best place is given (ties: the first). Whole texts are searched;
    a null or empty text, an item without words or id and an empty table give no rows; repeated rows are found again.
    """
    parts = [
        docs.select("doc_id", "text").mapInArrow(lambda batches, s=shared: _search(batches, s), FOUND) for shared in _blocks(docs, benchmark)]
    if not parts:
        return docs.sparkSession.createDataFrame([], FOUND)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which :func:`leaks` finds no item, with all their columns and without a shuffle."""
    out = docs
    for shared in _blocks(docs, benchmark):
        out = out.mapInArrow(lambda batches, s=shared: _clean(batches, s), docs.schema)
    return out


def _blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """What is shared with the tasks for each block of items."""
    low, corpus = None, None
    while items := read_items(benchmark, low):
        low = items[-1].item_id, items[-1].text
        items = [x for x in items if len(x.words)]
        if items:
            if corpus is None:
                corpus = document_frequencies(docs)
            yield _shared(docs, items, *corpus)


def _shared(docs: DataFrame, items: list[Item], frequencies: np.ndarray, n: int, n_passages: int):
    idf = np.log((1.0 + n) / (1.0 + frequencies)) + 1e-3
    own, owners, answers = [], [], []
    for i, item in enumerate(items):
        terms = _terms(item.words)
        start, stop, _ = _passages(np.array([0, len(terms)]))
        own += [terms[a:b] for a, b in zip(start, stop)]
        owners += [i] * len(start)
        telling = item.answer[frequencies[_terms(item.answer)] <= max(COMMON_DOCUMENTS, COMMON * n)]
        answers.append(telling if len(telling) >= ANSWER_WORDS else telling[:0])
    terms, space = latent_space(docs, own, idf, n_passages)
    place = {int(t): k for k, t in enumerate(terms)}
    queries = np.stack([
        sum((idf[t] * space[place[t]] for t in x.tolist() if t in place), np.zeros(space.shape[1], np.float32)) for x in own])
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
    return docs.sparkSession.sparkContext.broadcast((
        [x.item_id for x in items], [x.words for x in items], answers, idf, terms, space, queries.astype(np.float32), np.array(owners)))

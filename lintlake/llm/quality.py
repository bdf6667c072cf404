"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain. Expectation-maximisation over the counts of vote patterns
estimates how accurate each of them is, without any true label; the posterior of a document's votes is its label. A linear
scorer over hashed features (byte trigrams and binned measures) learns the posteriors and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import mixed, slices, text_bytes, written
from lintlake.llm.minhash_dedup import word_hashes

#: Documents that the scorer is trained on, drawn by a hash of their id: the bound of the fit. All are scored.
TRAIN_DOCS = 8192
FEATURES = 1 << 15
ROUNDS, STEPS = 3, 40
MIN_SCORE = 0.5
BAD, NONE, GOOD = 0, 1, 2
#: Bounds of a labeller's accuracy: its votes for bad on good and on bad documents.
MAX_FALSE, LEAST_TRUE = 0.001, 0.1
#: Function words of the languages that the stop word labeller knows (fixed values).
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
    "le la les de des et un une du en que qui dans pour par est sur pas "
    "el los las y del se por con para una no al"
).split()
#: Measures by words need as many; a table marks each byte's kind.
LEAST_WORDS, LEAST_LETTERS = 20, 20
_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 0xC3 for b in range(256)])
_CHARACTER = np.array([b & 0xC0 != 0x80 for b in range(256)])
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_SYMBOL = np.array([chr(b) in "|#$%&*!<>=_{}~^\\+" for b in range(256)])
_STOP_MARK = np.array([chr(b) in ".!?" for b in range(256)])
MEASURES = ("symbols", "capitals", "distinct", "function_words", "repeated_lines", "word_length", "sentences")

_WORDS = [w.encode() for w in dict.fromkeys(STOP_WORDS)]
_STOPS = np.sort(word_hashes(np.frombuffer(b" ".join(_WORDS), np.uint8), np.array([0, len(b" ".join(_WORDS))]))[0])


def measured(batch: pa.RecordBatch) -> np.ndarray:
    """What the labellers look at, documents x measures; not a number where a text is too short for the measure."""
    flat, ends = text_bytes(batch.column("text"))
    n = batch.num_rows
    out = np.full((n, len(MEASURES)), np.nan)
    if not len(flat):
        return out
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[ends])
    size, letters = count(_CHARACTER[flat]), count(_LETTER[flat])
    capitals = _CAPITAL[flat]
    capitals[1:] |= (flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E)  # A with grave to thorn in UTF-8
    words, word_ends = word_hashes(flat, ends, ~_LETTER & (np.arange(256) < 128))
    lines, line_ends = word_hashes(flat, ends, np.arange(256) == 10)
    n_words, n_lines = np.diff(word_ends), np.diff(line_ends)
    stops = _STOPS[np.minimum(np.searchsorted(_STOPS, words), len(_STOPS) - 1)] == words
    n_stops = np.diff(np.concatenate([[0], np.cumsum(stops)])[word_ends])
    with np.errstate(divide="ignore", invalid="ignore"):
        out[:, 0] = np.where(size > 0, count(_SYMBOL[flat]) / size, np.nan)
        out[:, 1] = np.where(letters >= LEAST_LETTERS, count(capitals) / letters, np.nan)
        out[:, 3] = np.where(n_words >= LEAST_WORDS, n_stops / n_words, np.nan)
        out[:, 5] = np.where(n_words > 0, letters / n_words, np.nan)
        out[:, 6] = np.where(n_words >= LEAST_WORDS, count(_STOP_MARK[flat]) / n_words, np.nan)
    for d in np.flatnonzero(n_words >= LEAST_WORDS):
        out[d, 2] = len(np.unique(words[word_ends[d] : word_ends[d + 1]])) / n_words[d]
    for d in np.flatnonzero(n_lines >= 3):
        out[d, 4] = 1 - len(np.unique(lines[line_ends[d] : line_ends[d + 1]])) / n_lines[d]
    return out


def votes(values: np.ndarray) -> np.ndarray:
    """The vote of each labeller, documents x labellers."""
    symbols, capitals, distinct, function_words, repeated, length, sentences = values.T
    with np.errstate(invalid="ignore"):
        rules = (
            (symbols > 0.015, symbols < 0.002),
            (capitals > 0.4, capitals < 0.12),
            (distinct < 0.4, distinct > 0.55),
            (function_words < 0.04, function_words > 0.1),
            (repeated > 0.4, repeated < 0.05),
            ((length < 2) | (length > 16), (length > 3) & (length < 10)),
            (sentences > 0.5, (sentences > 0.02) & (sentences < 0.3)),
        )
    return np.stack([np.where(bad, BAD, np.where(good, GOOD, NONE)) for bad, good in rules], axis=1).astype(np.int8)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(share of good documents, P(vote | class) as labellers x classes x votes) by expectation-maximisation.

    ``patterns`` are the distinct rows of votes and ``counts`` how often each occurs. To abstain says nothing of the class.
    Votes for bad are meant to be sure, those for good are not: the start takes a document with any vote for bad as bad, and
    the estimate stays within ``MAX_FALSE`` votes for bad on good documents and at least ``LEAST_TRUE`` on bad ones.
    """
    good = np.where((patterns == BAD).any(axis=1), 0.1, np.where((patterns == GOOD).any(axis=1), 0.9, 0.5))
    hot = np.stack([patterns == v for v in (BAD, GOOD)], axis=2).astype(float)
    prior, table = 0.5, np.full((patterns.shape[1], 2, 2), 1 / 2)
    for _ in range(rounds):
        weights = np.stack([counts * (1 - good), counts * good])
        table = np.einsum("cp,plv->lcv", weights, hot) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        table[:, 1, 0] = np.minimum(table[:, 1, 0], MAX_FALSE)
        table[:, 0, 0] = np.maximum(table[:, 0, 0], LEAST_TRUE)
        table[:, :, 1] = 1 - table[:, :, 0]
        prior = float(np.clip(weights[1].sum() / max(counts.sum(), 1), 0.02, 0.98))
        new = posterior(patterns, prior, table)
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """P(good | votes) of each row of votes."""
    gain = np.log(table[:, 1]) - np.log(table[:, 0])
    odds = np.log(prior / (1 - prior)) + (patterns == BAD) @ gain[:, 0] + (patterns == GOOD) @ gain[:, 1]
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _bins(values: np.ndarray) -> np.ndarray:
    """Hashed indicator features of the binned measures: one a measure and document (not a number is a bin of its own)."""
    step = np.where(np.isnan(values), -1, np.floor(np.sqrt(np.clip(values, 0, 100)) * 12)).astype(np.int64)
    keys = (step + 10).astype(np.uint64) * np.uint64(31) + np.arange(len(MEASURES), dtype=np.uint64) * np.uint64(4096)
    return (mixed(keys) % np.uint64(FEATURES)).astype(np.int64)


def _trigrams(flat: np.ndarray) -> np.ndarray:
    wide = flat.astype(np.uint64)
    return (mixed(wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)) % np.uint64(FEATURES)).astype(np.int64)


def _features(batch: pa.RecordBatch, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) of a block: trigram shares times 8, and the bins with value 1."""
    flat, ends = text_bytes(batch.column("text"))
    n = batch.num_rows
    bins = _bins(values)
    docs, places, parts = [np.repeat(np.arange(n), bins.shape[1])], [bins.ravel()], [np.ones(bins.size)]
    for d in range(n):
        own = flat[ends[d] : ends[d + 1]]
        if len(own) >= 3:
            place, count = np.unique(_trigrams(own), return_counts=True)
            docs.append(np.full(len(place), d)), places.append(place), parts.append(8.0 * count / count.sum())
    return np.concatenate(docs), np.concatenate(places), np.concatenate(parts)


def _learned(batches: Iterator[pa.RecordBatch], weights: np.ndarray, prior: float, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Weights after some steps on this task's documents, and their number."""
    docs, places, values, labels, n = [], [], [], [], 0
    for batch in slices(batches, "text", 1 << 20):
        found = measured(batch)
        d, p, v = _features(batch, found)
        docs.append(d + n), places.append(p), values.append(v), labels.append(posterior(votes(found), prior, table))
        n += batch.num_rows
    if not n:
        return
    d, p, v, y = (np.concatenate(x) for x in (docs, places, values, labels))
    w, squares = weights.astype(float), np.full(FEATURES, 1e-8)
    for _ in range(STEPS):
        z = np.bincount(d, w[p] * v, n)
        slope = np.bincount(p, (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)[d] * v, FEATURES) / n + 1e-6 * w
        squares += slope**2
        w -= 0.3 * slope / np.sqrt(squares)
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([w.astype(np.float32).tobytes()], pa.binary())], names=["n", "weights"])


def train(sample: DataFrame, prior: float, table: np.ndarray, tasks: int = 8) -> np.ndarray:
    """Weights of the scorer: every task takes some steps on its part of the sample, the parts are averaged, in rounds."""
    weights = np.zeros(FEATURES, np.float32)
    rows = written(sample.select("text").repartition(tasks), "quality-sample")
    for _ in range(ROUNDS):
        parts = rows.mapInArrow(lambda batches, w=weights: _learned(batches, w, prior, table), "n long, weights binary").collect()
        total = sum(r["n"] for r in parts)
        if not total:
            break
        weights = sum(np.frombuffer(r["weights"], np.float32) * np.float32(r["n"] / total) for r in parts)
    return weights


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vote patterns of a task's documents, a row a block and pattern."""
    for batch in slices(batches, "text", 1 << 20):
        rows, counts = np.unique(votes(measured(batch)), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([bytes(r) for r in rows], pa.binary()), pa.array(counts)], names=["pattern", "n"])


def _scored(batches: Iterator[pa.RecordBatch], weights: np.ndarray, prior: float, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        flat, ends = text_bytes(batch.column("text"))
        values = measured(batch)
        z = weights[_bins(values)].sum(axis=1).astype(float)
        sums = np.concatenate([[0.0], np.cumsum(weights[_trigrams(flat)], dtype=float)]) if len(flat) >= 3 else np.zeros(1)
        size = np.diff(ends) - 2
        some = size > 0
        z[some] += 8.0 * (sums[ends[1:][some] - 2] - sums[ends[:-1][some]]) / size[some]
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        score[np.diff(ends) == 0] = 0.0
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(posterior(votes(values), prior, table)), pa.array(score), pa.array(score >= MIN_SCORE)],
            names=["doc_id", "posterior", "score", "kept"])


def classify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``posterior`` of its votes, ``score`` of the linear scorer (0 to 1) and ``kept``.

    A null or empty text has score 0 and is not kept; an empty table gives an empty result. Votes are counted over all rows,
    the scorer learns from at most about ``TRAIN_DOCS`` of them.
    """
    result = "doc_id long, posterior double, score double, kept boolean"
    patterns = docs.select("text").mapInArrow(_counted, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    rows = patterns.collect()  # at most three to the power of the number of labellers
    if not rows:
        return docs.sparkSession.createDataFrame([], result)
    counts = np.array([r["n"] for r in rows], float)
    prior, table = estimate(np.stack([np.frombuffer(r["pattern"], np.int8) for r in rows]), counts)
    share = min(1.0, TRAIN_DOCS / counts.sum())
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    weights = train(drawn, prior, table)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _scored(batches, weights, prior, table), result)

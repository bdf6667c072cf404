"""Language identification by compression.

Each language has a raw-content zstandard dictionary of its own text. A text is compressed piece by piece with
every dictionary; the language whose dictionary gives the smallest total is its language, and a text for which
two dictionaries do about as well is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Bounds of the training sample: so many texts of a language, in the order of a hash of their id, cut to so many bytes in all.
SAMPLE_DOCS = 400
DICTIONARY_BYTES = 112 << 10
MAX_LANGUAGES = 400
#: A text is compressed in pieces of so many characters, so that the dictionary counts in long texts as well.
PIECE_CHARS = 1 << 12
LEVEL = 6
#: Rejected below this share of bytes saved against the second best dictionary.
MIN_MARGIN = 0.005
_NO_LETTER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-cased letters with single spaces: what is compared."""
    return _NO_LETTER.sub(" ", text.lower()).strip()


def train(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries from labelled rows (``doc_id``, ``text``, ``lang``).

    Takes the ``SAMPLE_DOCS`` rows of each language that come first by a hash of id and text, of the ``MAX_LANGUAGES`` most frequent
    languages (ties: by name); rows without an id are drawn like all others. Rows without a language or a
    letter are passed over. The languages stand in the order of their number of rows, which decides ties.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    often = {row["lang"]: row["count"] for row in counted}
    if not often:
        return {}
    # The share of the hash range that holds about twice the sample: few rows are left to rank. Repeated rows are drawn together;
    # the rank bounds them in every task, before anything is moved.
    shares = F.create_map(*[F.lit(x) for lang, n in often.items() for x in (lang, min(1.0, 2 * SAMPLE_DOCS / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    part = F.substring("text", 1, DICTIONARY_BYTES).alias("text")
    drawn = known.select("doc_id", "lang", part, draw.alias("draw")).where(F.col("draw") < F.try_element_at(shares, F.col("lang")) * F.lit(1 << 40))
    rows = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE_DOCS).collect()
    texts: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: r["place"]):
        body = plain(row["text"])
        if any(map(str.isalpha, body)):
            texts.setdefault(row["lang"], []).append(body)
    return {lang: _content(texts[lang]) for lang in sorted(texts, key=lambda x: (-often.get(x, 0), x))}


def _content(bodies: list[str]) -> bytes:
    """An equal share of each text, so that a few long ones do not fill the dictionary."""
    share = max(200, DICTIONARY_BYTES // len(bodies))
    spare = DICTIONARY_BYTES - sum(min(share, len(b)) for b in bodies)
    pieces = []
    for body in bodies:
        take = share + max(0, min(spare, len(body) - share))
        spare -= max(0, take - share)
        pieces.append(body[:take])
    return " ".join(pieces).encode()[:DICTIONARY_BYTES]


def _coders(dictionaries: dict[str, bytes]) -> list:
    out = []
    for content in dictionaries.values():
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_content_size=False, write_dict_id=False))
    return out


def _language(text: str | None, langs: list[str], coders: list) -> tuple[str, float, bool]:
    """(language, score, rejected) of one whole text."""
    body = plain(text) if text else ""
    if not langs or not any(map(str.isalpha, body)):
        return UNKNOWN, 0.0, True
    sizes = np.zeros(len(langs))
    for at in range(0, len(body), PIECE_CHARS):
        piece = body[at : at + PIECE_CHARS].encode()
        sizes += [len(c.compress(piece)) for c in coders]
    best, *rest = np.argsort(sizes, kind="stable")
    margin = float(1.0 - sizes[best] / sizes[rest[0]]) if rest else 1.0
    return langs[best], margin, margin < MIN_MARGIN


def _predicted(batches: Iterator[pa.RecordBatch], dictionaries: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    langs, coders = list(dictionaries), _coders(dictionaries)
    for batch in batches:
        rows = [_language(text, langs, coders) for text in batch.column("text").to_pylist()]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "lang_pred", "score", "rejected"])


def _identified(batches: Iterator[pa.RecordBatch], dictionaries: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    langs, coders = list(dictionaries), _coders(dictionaries)
    for batch in batches:
        yield batch.filter(pa.array([not _language(text, langs, coders)[2] for text in batch.column("text").to_pylist()], pa.bool_()))


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``doc_id`` of every row with ``lang_pred``, ``score`` (share of bytes saved, 0 to 1) and ``rejected``.

    Reads the whole text, nothing else. A null text or one without a letter is ``und`` with score 0 and rejected, and so
    is every text when no dictionary could be trained. Of equal sizes the more frequent language wins. The
    dictionaries travel with the tasks: at most ``MAX_LANGUAGES`` of ``DICTIONARY_BYTES``.
    """
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _predicted(batches, dictionaries), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, in one pass and with all their columns."""
    return docs.mapInArrow(lambda batches: _identified(batches, dictionaries), docs.schema)

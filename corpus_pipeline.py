"""A training corpus from raw documents: language, near-duplicates, benchmark leaks, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns they were given. None of the stages needs a column besides those of
``documents``, others are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import decontaminate, language_id, minhash_dedup, packing, secret_scan
from lintlake.llm.common import one_per_id, table, written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Dictionaries come from the labelled rows of ``docs``.

    Texts that are null or without a letter and texts with a narrow margin go.
    """
    return language_id.keep_identified(docs, language_id.train(docs.select("doc_id", "text", "lang")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; a repeated id comes once.

    Rows without an id cannot stand for a group: they pass.
    """
    kept = minhash_dedup.near_texts(docs.select("doc_id", "text")).where("kept").select("doc_id")
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi")
    return one_per_id(named).select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind of secret."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bin and place of every piece of every document."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]
#: Compression and best-fit packing have no SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

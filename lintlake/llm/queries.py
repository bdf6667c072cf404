"""The queries of this subpackage over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import (
    decontaminate, html_text, language_id, minhash_dedup, packing, personal_data, phrase_mining, quality, secret_scan, spelling_variants, suffix_dedup,
    url_filter, vector_dedup,
)
from lintlake.llm.common import table
from lintlake.llm.oracles import ORACLES

#: Documents whose CRC-32 of the id leaves this remainder by 4 are held out from training.
HELD_OUT = 2


def op1_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate embeddings inside of each label."""
    return vector_dedup.near_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated strings of 200 bytes removed from every document."""
    found = suffix_dedup.repeated_strings(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on the URL of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "word_rule")


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT


def language_dictionaries(spark: SparkSession, folder: str) -> dict[str, bytes]:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return language_id.train(docs.where(~held_out(F.col("doc_id"))))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    found = language_id.identify(table(spark, folder, "documents"), language_dictionaries(spark, folder))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Bin and place of every piece of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return packing.pack(packing.with_near_clusters(docs), F.col("cluster"), size=F.col("size"))


def op6_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    return minhash_dedup.near_texts(table(spark, folder, "documents").select("doc_id", "text"))


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, folder, "pages"))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from weak labels only."""
    return quality.classify(table(spark, folder, "documents").select("doc_id", "text"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, folder, "benchmark"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, each distinct text scanned once."""
    found, _ = secret_scan.scan_versions(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document, plain and disguised."""
    return personal_data.find_personal_data(table(spark, folder, "documents").select("doc_id", "text"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Near words, forms and roots of all words."""
    return spelling_variants.spelling_variants(table(spark, folder, "documents"))


def op13_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest collocations of each language."""
    return phrase_mining.collocations(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_vector_dedup, op2_suffix_dedup, op3_url_filter, op4_language_id, op5_best_fit_packing, op6_minhash_dedup, op7_html_extraction,
    op8_quality_classifier, op9_decontamination, op10_secret_scan, op11_personal_data,
    op12_spelling_variants, op13_phrase_mining,
)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {key: sql for key, sql in ORACLES.items() if key in QUERIES}

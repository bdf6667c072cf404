"""Secret scans over a ledger of content-addressed versions.

Every historical version of a path is addressed by the SHA-256 of its text. The ledger holds one row per
scanned (blob, rule version); a run scans only the pairs that the ledger lacks, each blob once however many
paths and versions hold it, and joins the findings back to all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import slices, written

#: Raise this with every change of the rules below: the ledger then scans every blob anew.
RULE_VERSION = "2"
#: kind, pattern, group whose length counts, least length, literals of which one must occur (lower case; none: always run).
BASE_RULES = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
     ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    ("hex", r"[0-9a-f]+", 0, 24, ()),
)
ADDED_RULES = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("private key",)),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, ("eyj",)),
)
FINDINGS = "n_assign long, n_access long, n_hex long, base string, spans string"
NAMES = ("n_assign", "n_access", "n_hex", "base", "spans")
_SHORT = {"hex": r"[0-9a-f]{24,}"}  # greedy runs: the same matches as of the plain pattern, short runs passed over faster


def find_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, order of the kind, kind, end) of every secret, by start and then kind."""
    found, low = [], text.lower()
    for order, (kind, pattern, group, least, literals) in enumerate((*BASE_RULES, *ADDED_RULES)):
        if literals and not any(x in low for x in literals):
            continue
        for m in re.finditer(_SHORT.get(kind, pattern), text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return sorted(found)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = {"n_assign": [], "n_access": [], "n_hex": [], "base": [], "spans": []}
        for text in batch.column("text").to_pylist():
            spans = find_spans(text or "")
            kinds = [x[2] for x in spans]
            show = [f"{kind}:{start}:{end}" for start, _, kind, end in spans]
            for kind in ("assign", "access", "hex"):
                rows[f"n_{kind}"].append(kinds.count(kind))
            rows["base"].append(",".join(s for s, (_, order, _, _) in zip(show, spans) if order < len(BASE_RULES)))
            rows["spans"].append(",".join(show))
        yield pa.RecordBatch.from_arrays(
            [batch.column("blob"), *[pa.array(v, pa.int64() if k[0] == "n" else pa.string()) for k, v in rows.items()]],
            names=["blob", *rows],
        )


def blob_of(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def may_hold_secret(text) -> F.Column:
    """Whether any rule could match at all: cheap enough to run in the pass that reads and addresses the text."""
    low = F.lower(text)
    test = F.lit(False)
    for kind, _, _, _, literals in (*BASE_RULES, *ADDED_RULES):
        for literal in literals:
            test = test | low.contains(literal)
        if kind in _SHORT:
            test = test | text.rlike(_SHORT[kind])
    return F.coalesce(test, F.lit(False))


def new_ledger_rows(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """The ledger rows of all blobs in ``versions`` that ``ledger`` has not under the current rule version.

    Copies of a blob meet by their address and one of them is scanned; only texts in which some rule could
    match are moved, the others are on the ledger as their address. A null text is the empty blob.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    blobs = versions.select(
        blob_of(F.col(text)).alias("blob"), F.when(may_hold_secret(content), content).alias("text")
    )
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    found = blobs.dropDuplicates(["blob"]).mapInArrow(_scanned, f"blob binary, {FINDINGS}")
    return found.withColumn("rule_version", F.lit(RULE_VERSION)).select("blob", "rule_version", *NAMES)


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``versions`` with their findings, the rows to append to the ledger).

    Every row of ``versions`` (a path at a time in its history) comes back once with ``n_assign``, ``n_access``,
    ``n_hex``, ``base`` and ``spans`` (comma-joined ``kind:start:end``, code points, end exclusive); repeated rows come
    back as often as given, columns of these names are replaced. An empty table gives empty results.
    """
    fresh = written(new_ledger_rows(versions, ledger, text), "secret-ledger")
    hits = _hits(fresh, ledger)
    out = versions.drop(*[c for c in NAMES if c != text]).withColumn("__blob", blob_of(F.col(text)))
    out = out.join(hits, "__blob", "left").withColumns({
        c: F.coalesce(F.col(f"__{c}"), F.lit(0) if c[0] == "n" else F.lit("")) for c in NAMES
    }).drop("__blob", *[f"__{c}" for c in NAMES])
    return out, fresh


def _hits(fresh: DataFrame, ledger: DataFrame | None) -> DataFrame:
    known = fresh
    if ledger is not None:
        known = fresh.unionByName(ledger.where(F.col("rule_version") == RULE_VERSION).select(fresh.columns))
    return known.where(F.col("spans") != "").select(
        F.col("blob").alias("__blob"), *[F.col(c).alias(f"__{c}") for c in NAMES]
    ).dropDuplicates(["__blob"])


def redacted(text: str, spans: str) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one."""
    at, out = 0, []
    for item in spans.split(",") if spans else ():
        kind, start, end = item.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], f"<{kind}>"]
        at = max(at, int(end))
    return "".join([*out, text[at:]])


def _redacted(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([redacted(t, s) for t, s in zip(text, spans)], dtype=object)


def redact(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` and ``n_chars`` counted anew where that changed it.

    No row is dropped and no other column touched. Texts in which no rule could match pass by without a shuffle.
    """
    fresh = written(new_ledger_rows(docs, ledger), "secret-ledger")
    flag = may_hold_secret(F.coalesce(F.col("text"), F.lit("")))
    hits = _hits(fresh, ledger).select("__blob", "__spans")
    apply = F.pandas_udf(_redacted, "string")
    text = F.when(F.col("__spans").isNotNull(), apply("text", F.coalesce("__spans", F.lit("")))).otherwise(F.col("text"))
    marked = docs.where(flag).withColumn("__blob", blob_of(F.col("text"))).join(hits, "__blob", "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.when(F.col("__spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
        marked = marked.withColumn("n_chars", length)
    return docs.where(~flag).unionByName(marked.select(docs.columns))

"""Packing, benchmark leaks and the pipeline: against brute force, and the odd cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lintlake.llm import decontaminate, language_id, packing, queries
from tests.llm.test_dedup import brute_groups
from tests.llm.test_filters import brute_spans


def plain_best_fit(lengths, sources, clusters, capacity):
    """The tightest compatible bin by looking at all of them; the earliest of equals."""
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [k for k, b in enumerate(bins) if b[0] >= n and (s is None or s not in b[1]) and (c is None or c not in b[2])]
        k = min(fits, key=lambda k: (bins[k][0], k), default=None)
        if k is None:
            k = len(bins)
            bins.append([capacity, set(), set()])
        bins[k][0] -= n
        bins[k][1].add(s), bins[k][2].add(c)
        out.append(k)
    return out


def test_best_fit_against_looking_at_all_bins():
    rng = random.Random(7)
    for _ in range(40):
        n = rng.randint(0, 120)
        lengths = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        sources = [rng.choice([None, "hot", "hot", "a", "b"]) for _ in range(n)]
        clusters = [rng.choice([None, 1, 2, *range(10, 40)]) for _ in range(n)]
        assert packing.best_fit(lengths, sources, clusters, 100) == plain_best_fit(lengths, sources, clusters, 100)


def test_packing_keeps_everything_apart_and_whole(spark, make_docs):
    rng = random.Random(8)
    texts = ["é" * rng.randint(0, 60) + "x" * rng.randint(0, 30) for _ in range(200)] + ["same"] * 20 + [" SAME "] * 3 + ["", None, "y" * 1000, "z" * 100]
    docs = make_docs(texts).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 40)))
    packed = packing.pack(docs, capacity=100, block_rows=64)
    rows = packed.join(docs.select("doc_id", "source"), "doc_id").collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        if r["bin_id"] is not None:
            by_bin.setdefault(r["bin_id"], []).append(r)
    for k, t in enumerate(texts):
        parts = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [p["start"] for p in parts] == [100 * p["piece"] for p in parts]
        assert sum(p["n_bytes"] for p in parts) == len((t or "").encode()) and all((p["bin_id"] is None) == (p["n_bytes"] == 0) for p in parts)
    for group in by_bin.values():
        group.sort(key=lambda r: r["bin_start"])
        assert [r["bin_start"] for r in group] == [sum(x["n_bytes"] for x in group[:k]) for k in range(len(group))]
        assert sum(r["n_bytes"] for r in group) <= 100
        named = [r["source"] for r in group if r["source"]]
        assert len(named) == len(set(named)) and sum(200 <= r["doc_id"] < 220 for r in group) <= 1
    content = {r["bin_id"]: bytes(r["content"]) for r in packing.sequences(docs, packed, 100).collect()}
    for b, group in by_bin.items():
        assert content[b] == b"".join(texts[r["doc_id"]].encode()[r["start"] : r["start"] + r["n_bytes"]] for r in group)


def test_packing_keeps_near_copies_apart(spark, make_docs, tmp_path):
    rng = random.Random(14)
    body = [f"w{k}" for k in range(60)]
    texts = [" ".join("other" if j == k else w for j, w in enumerate(body)) for k in range(8)] + [passage(rng, 20) for _ in range(8)]
    docs = make_docs(texts + [(None, " ".join(body))]).withColumn("source", F.concat(F.lit("s"), "doc_id"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op5_best_fit_packing(spark, str(tmp_path)).collect()
    assert len(rows) == 17 and len({r["bin_id"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 8}) == 8


def test_packing_of_rows_without_id_repeated_and_empty(make_docs):
    rows = packing.pack(make_docs([(None, "a"), (1, "b"), (1, "b"), (None, None)])).collect()
    assert len(rows) == 4 and len({r["bin_id"] for r in rows if r["doc_id"] == 1}) == 2
    assert packing.pack(make_docs([])).count() == 0


WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("sha", "to", "vil", "wen", "xi") for c in ("", "d", "n", "st")]


def passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def plain_leak(item, text):
    """The rule over all places of the text: common order with any stretch of the item's length and a margin."""
    words = decontaminate._words([item])[0].tolist()
    body = decontaminate._words([text or ""])[0].tolist()
    margin = len(words)
    return any(
        decontaminate.common_length(words, body[max(0, k - margin) : k + decontaminate.WINDOW + margin]) >= decontaminate.COPIED * margin
        for k in range(0, max(1, len(body) - decontaminate.WINDOW + decontaminate.STEP), decontaminate.STEP)) if words else False


def test_leaks(spark, make_docs):
    rng = random.Random(9)
    items = [passage(rng, rng.randint(15, 60)) + ".\n" + passage(rng, 5) + "." for _ in range(25)] + [passage(rng, 200), "", None, "...", passage(rng, 20)]
    bench = spark.createDataFrame([(k, t, 0) for k, t in enumerate(items[:-1])] + [(None, items[-1], 0), (0, items[0], 1)], "item_id long, text string, doc_id int")
    texts, held = [], []
    for k in range(60):
        body, item = passage(rng, rng.randint(0, 300)), rng.randrange(26)
        kind = k % 4
        own = items[item].split()
        if kind == 1:
            own = [w.upper() + rng.choice(["", ",", "!"]) for w in own]
        elif kind == 2:  # one word in seven changed
            own = [rng.choice(WORDS) if j % 7 == 3 else w for j, w in enumerate(own)]
        texts.append(body + " " + " ".join(own if kind < 3 else []) + " " + passage(rng, rng.randint(0, 200)))
        held.append(item if kind < 3 else None)
    texts += ["", None, "short", passage(rng, 20_000) + " " + items[3], texts[0]]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(make_docs(texts), bench).collect()}
    expected = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items[:-1]) if plain_leak(x or "", t)}
    assert {(d, i) for d, i in enumerate(held) if i is not None} <= expected
    assert len(got & expected) >= 0.98 * len(expected) and {(k, i) for k, i in enumerate(held) if i is not None} <= got
    assert {d for d, _ in got} == {d for d, _ in expected}
    clean = decontaminate.without_leaks(make_docs(texts), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(set(range(len(texts))) - {d for d, _ in got})
    assert decontaminate.leaks(make_docs([]), bench).count() == 0
    assert decontaminate.leaks(make_docs(texts), bench.where("item_id < 0")).count() == 0
    assert decontaminate.without_leaks(make_docs(texts), bench.where("item_id < 0")).count() == len(texts)


def test_paraphrase_needs_its_answer(spark, make_docs):
    rng = random.Random(10)
    question, answer = passage(rng, 40).split(), passage(rng, 6)
    bench = spark.createDataFrame([(1, " ".join(question) + ".\n" + answer + ".")], "item_id long, text string")
    half = " ".join(f"other{j}" if j % 5 in (1, 3) else w for j, w in enumerate(question))
    found = decontaminate.leaks(make_docs([half + ". " + answer, half + ". not this one here", passage(rng, 100)]), bench).collect()
    assert [r["doc_id"] for r in found] == [0] and found[0]["lcs"] < decontaminate.COPIED and found[0]["answer"] == 1


def test_benchmark_in_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 4)
    rng = random.Random(11)
    items = [passage(rng, 30) for _ in range(10)]
    bench = spark.createDataFrame([(k // 2, t) for k, t in enumerate(items)], "item_id long, text string")
    got = decontaminate.leaks(make_docs([passage(rng, 50) + " " + t for t in items]), bench)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(k, k // 2) for k in range(10)]


def plain_leaks(items, text):
    """(item, share in common order, share of the answer, first word) of all items found, by comparing all passages with all."""
    body, out = decontaminate._words([text])[0].tolist(), {}
    for i, item in enumerate(items):
        words = decontaminate._words([item])[0].tolist()
        answer = decontaminate._words([item.split("\n")[-1]])[0].tolist()
        for k in range(0, max(1, len(body) - decontaminate.WINDOW + decontaminate.STEP), decontaminate.STEP):
            region = body[max(0, k - len(words)) : k + decontaminate.WINDOW + len(words)]
            share = decontaminate.common_length(words, region) / len(words)
            held = decontaminate.common_length(answer, region) / len(answer)
            if share >= decontaminate.COPIED or share >= decontaminate.PARAPHRASED and held >= decontaminate.ANSWERED:
                out[i] = max(out.get(i, (-1.0, -1.0, 0)), (share, held, -k))
    return {(i, share, held, -k) for i, (share, held, k) in out.items()}


def changed(rng, words, share):
    """Words of which a share is replaced."""
    return " ".join(rng.choice(WORDS) + "q" if rng.random() < share else w for w in words.split())


def test_recall_on_a_full_block(spark, make_docs, monkeypatch):
    """Items of one latent space in as many documents, whole and with 12 and 24 in 100 words changed."""
    rng = random.Random(12)
    given = [r["text"].split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' AND n_chars > 900").select("text").collect()]
    items = []
    for _ in range(decontaminate.BLOCK_ITEMS):
        words = rng.choice(given)
        at = rng.randrange(len(words) - 70)
        items.append(" ".join(words[at : at + rng.randint(15, 60)]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts, planted = [], []
    for k, item in enumerate(items * 3):
        words = rng.choice(given)
        at = rng.randrange(len(words) - 60)
        texts.append(" ".join([*words[at : at + 50], changed(rng, item, 0.12 * (k // len(items))), *words[at + 50 :][:80]]))
    pick = range(0, len(texts), 4)
    expected = {(d, x[0]) for d in pick for x in plain_leaks(items, texts[d]) if x[1] >= decontaminate.COPIED}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(make_docs(texts), bench).collect()}
    planted = {(k, k % len(items)) for k in range(2 * len(items))}
    assert len(got & expected) >= 0.97 * len(expected) and len(planted & got) >= 0.97 * len(planted)
    monkeypatch.setattr(decontaminate, "MIN_COSINE", float("inf"))  # the latent search switched off
    assert decontaminate.leaks(make_docs(texts), bench).count() == 0


def test_the_latent_space_is_fitted_on_all_passages(spark, make_docs, monkeypatch):
    """Its directions are those of the Gram matrix of every passage of every document, whatever their number."""
    monkeypatch.setattr(decontaminate, "CORPUS_WEIGHT", 40)
    rng = random.Random(16)
    items, texts = [passage(rng, 30) for _ in range(4)], [passage(rng, rng.choice((0, 3, 64, 65, 200))) for _ in range(90)]
    texts += ["only the last document has these words " * 30 + passage(rng, 5)]
    docs = make_docs(texts)
    frequencies, n, n_passages = decontaminate.document_frequencies(docs)
    idf = np.log((1.0 + n) / (1.0 + frequencies)) + 1e-3
    own = [decontaminate._terms(x) for x in decontaminate._words(items)]
    terms, space = decontaminate.latent_space(docs, own, idf, n_passages)

    place, cut = {t: k for k, t in enumerate(terms.tolist())}, []
    for words in (decontaminate._terms(x).tolist() for x in decontaminate._words(texts)):
        last = max(0, -(-(len(words) - decontaminate.WINDOW) // decontaminate.STEP))
        cut += [words[k * decontaminate.STEP :][: decontaminate.WINDOW] for k in range(last + 1) if words]
    assert (n, n_passages) == (len(texts), len(cut))
    gram = np.zeros((len(terms), len(terms)))
    for words, weight in [(x.tolist(), 1.0) for x in own] + [(x, 40 / len(cut)) for x in cut]:
        full = {t: words.count(t) * idf[t] for t in set(words)}
        row = np.zeros(len(terms))
        for t, v in full.items():
            if t in place:
                row[place[t]] = v / np.sqrt(sum(x * x for x in full.values()))
        gram += weight * np.outer(row, row)
    values, vectors = np.linalg.eigh(gram)
    assert values[-1] > 1.05 * values[-2] and abs(vectors[:, -1] @ space[:, 0]) > 0.999
    assert np.allclose(space.T @ gram @ space, np.diag(values[::-1][: space.shape[1]]), atol=1e-3 * values[-1])


def test_an_answer_of_common_words_decides_nothing(spark, make_docs):
    rng = random.Random(15)
    item = passage(rng, 40) + ".\nIs the was that of."
    half = " ".join(f"other{j}" if j % 5 in (1, 3) else w for j, w in enumerate(item.split()[:40]))
    texts = [half + " is the was that of", *["is the was that of " + passage(rng, 30)] * 80]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.leaks(make_docs(texts), bench).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    """The smallest given tables with odd rows added, in a folder of their own."""
    import tempfile

    folder, given = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{given}/documents.parquet")
    text = docs.orderBy("doc_id").first()["text"]
    odd = [(9001, text, None, None, None), (9001, text, None, None, None), (9002, None, "en", "s", 0), (9003, "", "en", "s", 0), (9004, "12", None, "s", 2)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("id", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{given}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_stages_against_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    kept = stages["language_id"](spark, docs, corpus)
    learned = language_id.train(docs)
    expected = {r["doc_id"] for r in language_id.identify(docs, learned).where("NOT rejected").collect()}
    first = kept.collect()
    assert kept.columns == columns and {r["doc_id"] for r in first} == expected and not {9002, 9003, 9004} & expected
    assert len(expected) > 0.9 * docs.count()

    kept = stages["minhash_dedup"](spark, spark.createDataFrame(first, docs.schema), corpus)
    rows = sorted({(r["doc_id"], r["text"]) for r in first})
    _, part = brute_groups([t for _, t in rows])
    second = kept.collect()
    assert kept.columns == columns and sorted(r["doc_id"] for r in second) == [rows[k][0] for k in range(len(rows)) if part[k] == k]

    kept = stages["decontamination"](spark, spark.createDataFrame(second, docs.schema), corpus)
    items = [r["text"] for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    third = kept.collect()
    assert kept.columns == columns
    assert {r["doc_id"] for r in second} - {r["doc_id"] for r in third} == {r["doc_id"] for r in second if any(plain_leak(i, r["text"]) for i in items)}

    kept = stages["secret_scan"](spark, spark.createDataFrame(third, docs.schema), corpus)
    fourth = {r["doc_id"]: r for r in kept.collect()}
    assert kept.columns == columns and len(fourth) == len(third)
    for r in third:
        spans = brute_spans(r["text"])
        assert bool(spans) == (fourth[r["doc_id"]]["text"] != r["text"]) and not brute_spans(fourth[r["doc_id"]]["text"])
        assert fourth[r["doc_id"]]["n_chars"] == (len(fourth[r["doc_id"]]["text"]) if spans else r["n_chars"])

    packed = stages["best_fit_packing"](spark, spark.createDataFrame(list(fourth.values()), docs.schema), corpus).collect()
    assert {r["doc_id"] for r in packed} == set(fourth)
    whole = sorted((r["doc_id"], r["piece"], r["n_bytes"]) for r in packed)
    assert sorted((r["doc_id"], r["piece"], r["n_bytes"]) for r in corpus_pipeline.run(spark, corpus).collect()) == whole


def test_pipeline_on_an_empty_table(spark, corpus, tmp_path):
    folder = f"{tmp_path}/empty"
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{corpus}/benchmark.parquet").limit(0).write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0

"""Near-duplicate vectors and texts, repeated strings: against brute force, and the odd cases."""

import hashlib
import random

import numpy as np
import pytest

from lintlake.llm import components, minhash_dedup, suffix_dedup, vector_dedup
from lintlake.llm.suffix_array import common_prefixes, places_in, suffix_array


def groups_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(x) for x in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101 + k) for k in range(30)] + [(200, 200), (7, 3), (3, 7)]
    rows = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    found = {r["node"]: r["component"] for r in rows}
    assert all(found[k] == 0 for k in range(41)) and all(found[k] == 100 for k in range(100, 131)) and 200 not in found
    assert len(rows) == len(found)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [2048, 7])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 16))
    rows = []
    for k in range(150):
        v = base[k % 30] + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25, 0.4])
        rows.append((k, [float(x) for x in v * rng.uniform(0.1, 9)], int(k % 30 % 3)))
    rows += [(150, rows[5][1], rows[5][2]), (151, rows[5][1], None), (152, None, 1), (153, [0.0] * 16, 1), (154, [float("nan")] * 16, 1)]
    rows += [(155, [], 1), (156, [1.0, None], 1), (157, [1.0, float("inf")], 1)]
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    units = {k: np.array(v) / np.linalg.norm(v) for k, v, _ in rows if v and k < 151}
    links = [(a, b) for a in units for b in units if a < b and rows[a][2] == rows[b][2] and units[a] @ units[b] >= 0.98]
    part = groups_of(len(rows), links)
    for k in range(len(rows)):
        assert got[k]["n_links"] == sum(k in x for x in links)
        assert got[k]["component_id"] == part[k] and got[k]["kept"] == (part[k] == k)


def test_vectors_without_id_repeated_and_empty(spark):
    kind = "vec_id long, embedding array<float>, label int, rep string"
    rows = [(None, [1.0, 0.0], 1, "x"), (4, [1.0, 0.0], 1, "y"), (4, [1.0, 0.0], 1, "y"), (3, [2.0, 0.0], 1, "z")]
    got = sorted(tuple(r) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, kind)).fillna(-1).collect())
    assert got == [(-1, 0, -1, False), (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False)]
    assert vector_dedup.near_vectors(spark.createDataFrame([], kind)).count() == 0


def shingle_sets(texts):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_groups(texts):
    sets = shingle_sets(texts)
    links = [
        (a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, groups_of(len(sets), links)


@pytest.mark.parametrize("block", [2048, 5])
def test_texts_against_brute_force(make_docs, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "SET_BLOCK", block)
    rng = random.Random(2)
    words = [f"w{k}é" for k in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(60)] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", " \t"]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    texts += ["a b", "A  b", "a b c", "", None, " \n ", "no break one two three four", "x " * 3000, "x " * 2000]
    texts = [t.replace("É", "é") if t else t for t in texts]
    sets, part = brute_groups(texts)
    got = {r["doc_id"]: r for r in minhash_dedup.near_texts(make_docs(texts)).collect()}
    for k in range(len(texts)):
        assert (got[k]["n_shingles"], got[k]["component_id"], got[k]["kept"]) == (len(sets[k]), part[k], part[k] == k)


def test_texts_without_id_repeated_and_empty(make_docs):
    got = sorted(tuple(r) for r in minhash_dedup.near_texts(make_docs([(None, "a b c"), (9, "a b c"), (9, "a b c"), (8, "A b c")])).fillna(-1).collect())
    assert got == [(-1, 1, -1, False), (8, 1, 8, True), (9, 1, 8, False), (9, 1, 8, False)]
    assert minhash_dedup.near_texts(make_docs([])).count() == 0


def test_suffix_arrays_against_sorting():
    rng = random.Random(3)
    for turn in range(60):
        body = bytes(rng.randrange(rng.choice([1, 2, 4, 256])) for _ in range(rng.randint(1, 200)))
        body = body[: len(body) // 3] * 3 + body if turn % 3 == 0 else body
        text = np.frombuffer(body, np.uint8)
        order = sorted(range(len(body)), key=lambda i: body[i:])
        assert suffix_array(text).tolist() == order
        lanes = np.array(sorted({0, *(rng.randrange(len(body)) for _ in range(4))}), np.int64)
        share = lambda a, b: next((k for k in range(40) if body[a + k : a + k + 1] != body[b + k : b + k + 1] or a + k >= len(body)), 40)
        assert common_prefixes(text, np.array(order), lanes, 40).tolist() == [0] + [share(a, b) for a, b in zip(order, order[1:])]
        other = np.frombuffer(body[3:] + b"xyz", np.uint8)
        held = np.array([k for k in order if k + 12 <= len(body)], np.int64)
        starts = np.arange(max(0, len(other) - 11))
        known = {body[k : k + 12] for k in held}
        assert places_in(text, held, other, starts, 12).tolist() == [bytes(other[k : k + 12]) in known for k in starts]


def brute_repeats(texts, length=200):
    bodies = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(bodies):
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], []).append((d, k))
    cut = [bytearray(len(b)) for b in bodies]
    for places in seen.values():
        if len(places) > 1:
            for d, k in places:
                cut[d][k : k + length] = b"\1" * length
    out = []
    for b, c in zip(bodies, cut):
        spans = sum(1 for k in range(len(c)) if c[k] and (k == 0 or not c[k - 1]))
        out.append((len(b), sum(c), spans, hashlib.sha256(bytes(x for x, y in zip(b, c) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize("block", [8192, 2])
def test_repeated_strings_against_brute_force(make_docs, block):
    rng = random.Random(4)
    letters = "abcdé fgh"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [some(260), some(199), some(200), some(230)]
    texts = [some(rng.randint(0, 300)) + rng.choice(shared) + some(rng.randint(0, 300)) for _ in range(60)]
    common = some(80)  # shorter than what counts, with other text around it each time
    texts += [some(150) + common + some(150) for _ in range(30)]
    texts += [texts[0], texts[0], "", None, "ab " * 400, "x" * 199, "x" * 200, "y" * 200, some(40) * 12, some(3000) + shared[0][:215]]
    docs = make_docs(texts)
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_strings(docs, shard_bytes=20_000, block=block).collect()}
    for k, expected in enumerate(brute_repeats(texts)):
        assert tuple(got[k][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == expected, texts[k]


def test_repeated_strings_across_steps_of_the_sieve(make_docs, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    texts = ["q" + long[100:900] + "r" * 50, long, None]
    steps = [suffix_dedup._segments(flat := np.frombuffer(t.encode(), np.uint8), np.array([0, len(flat)]), suffix_dedup._constants(5000))
             for t in texts[:2]]
    assert sum(int(w.sum()) for part in steps for _, _, w, _, _ in part) == sum(len(t) - 199 for t in texts[:2])
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    steps = suffix_dedup._segments(np.frombuffer(long.encode(), np.uint8), np.array([0, 1500]), suffix_dedup._constants(500))
    assert sum(int(w.sum()) for _, _, w, _, _ in steps) == 1301
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_strings(make_docs(texts)).collect()}
    assert got == {0: 800, 1: 800, 2: 0}


def test_repeated_strings_without_id_and_empty(make_docs):
    text = "".join(chr(97 + k * k % 26) for k in range(250)) + "é"
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in suffix_dedup.repeated_strings(make_docs([(None, text), (None, None), (5, text), (5, text)])).collect())
    assert got == [(-1, 0), (-1, 252), (5, 252), (5, 252)]
    assert suffix_dedup.repeated_strings(make_docs([])).count() == 0

"""Personal data, spelling variants and phrases against brute force, and the odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lintlake.llm import personal_data, phrase_mining, spelling_variants


def brute_base(text):
    """The base spans by the plain patterns."""
    kinds = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]")

    def fits(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        if kind == 1:
            return all(int(p) <= 255 for p in hit.split("."))
        if kind == 2:
            total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
            return 14 <= len(digits) <= 19 and total % 10 == 0
        return kind == 0 or 10 <= len(digits) <= 15

    found = [(m.start(), k, m.end()) for k, p in enumerate(kinds) for m in re.finditer(p, text) if fits(k, m[0])]
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in sorted(found))


PLAIN = [
    "é a.b+c@x-y.co.uk, d@e", "a@b.c@d.e", "a@b.c_d@e.f.", "@x.y", "1.2.3.4.5.6.7.8.9", "256.1.1.1.1.1.1.1", "001.02.3.0004", "4111 1111-1111 1111",
    "4111  1111 1111 1111", "41111111111111111", "+49 (151) 234-5678 9", "+1234567890123456", "++1 234 567 890 12", "4111111111111111.1.1.1", "", None,
    "1" * 40_000, "a" * 40_000 + "@", "x " * 50_000 + "me@here.org", "0.0.0." * 9_000, "+1" + "(" * 30_000, "[" * 20_000 + " at",
]
DISGUISED = {
    "mail bob [at] example [dot] com now": "bob [at] example [dot] com",
    "john dot doe AT example dot co dot uk!": "john dot doe AT example dot co dot uk",
    "bob&#64;example.com": "bob&#64;example.com",
    "é bob@mail.exаmple.com": "bob@mail.exаmple.com",
    "b­ob@exam​ple.com,": "b­ob@exam​ple.com",
    "card 4l11 1111 1111 1111": "4l11 1111 1111 1111",
    "４111 1111 1111 1111.": "４111 1111 1111 1111",
    "one nine two dot one six eight dot one dot one": "one nine two dot one six eight dot one dot one",
    "call plus four nine one five one, two three four five six seven": "plus four nine one five one, two three four five six seven",
    "null eins zwei, vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins": None,
    "look at example.com": None, "meet at noon dot": None, "un six neuf": None, "me@here.org at once": None, "point": None,
}


def test_base_spans_equal_the_plain_patterns():
    some = random.Random(4)
    texts = [t for t in PLAIN if t and len(t) < 100]
    texts += ["".join(some.choices("0123456789  --..@+a(é", k=some.randint(0, 60))) for _ in range(3000)]
    for text in texts:
        assert personal_data.shown(personal_data.detect(text)) == brute_base(text), text


def test_personal_data(make_docs):
    texts = [*PLAIN, *DISGUISED]
    docs = make_docs([*texts, (0, texts[0])]).withColumn("spans", F.lit("clash"))
    rows = personal_data.find_personal_data(docs).collect()
    assert len(rows) == len(texts) + 1 and rows[0]["source"] == "s"
    for r in rows:
        text = texts[r["doc_id"]] or ""
        if len(text) < 200:
            base = brute_base(text)
            assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["n_email"] == base.count("email")
            assert (r["n_ip"], r["n_card"], r["n_phone"]) == (base.count("ip"), base.count("card"), base.count("phone"))
        if text in DISGUISED:
            more = [s.split(":")[1:] for s in r["spans"].split(",") if s and s not in brute_base(text).split(",")]
            assert [text[int(a) : int(b)] for a, b in more] == ([DISGUISED[text]] if DISGUISED[text] else []), text
            assert r["n_added"] == len(more)
    assert personal_data.find_personal_data(make_docs([])).count() == 0


def test_masked_texts(make_docs):
    texts = ["a b@c.de f", None, "clean", "bob [at] example [dot] com, 1.2.3.4", "b@mail.exаmple.com."]
    rows = {r["doc_id"]: r["text"] for r in personal_data.find_personal_data(make_docs(texts), mask=True).collect()}
    assert [rows[k] for k in range(5)] == ["a <email> f", None, "clean", "<email>, <ip>", "<email>."]


def brute_words(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def brute_variants(words):
    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w, n in words.items():
        met = [x for x in words if near(w, x)]
        best = min(met, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
        out[w] = len(met)
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (words[w], form[w], form[w] and words[form[w]], root, out[w])
    return out


def as_dict(rows):
    out = {r["word"]: (r["n"], r["form"], r["form_n"], r["root"], r["n_near"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_equal_brute_force(spark):
    some = random.Random(3)
    words = {"".join(some.choices("abé", k=some.randint(7, 9))): some.choice([2, 3, 25, 30, 300, 4000]) for _ in range(900)}
    words |= {"a" * k: 3 for k in range(7, 12)} | {"÷" * 8: 5, "z" * 5000: 2, "z" * 5001: 70}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(7)
    got = as_dict(spelling_variants.group_variants(table).collect())
    assert got == brute_variants(words) and len({r[3] for r in got.values()}) < len(got)
    assert spelling_variants.group_variants(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling_variants.group_variants(table, ratio=1)


def test_variants_of_documents(make_docs, spark):
    some = random.Random(5)
    vocabulary = ["".join(some.choices("abcd", k=8)) for _ in range(60)] + ["École×xyz", "Straßenname"]
    texts = [" ".join(some.choices(vocabulary, k=some.randint(0, 60))) for _ in range(80)]
    docs = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (90, None), (91, "short x"), (92, "Wort" * 30_000), (93, "WORT" * 30_000)]
    table = make_docs(docs).withColumn("n", F.lit(0)).withColumn("word", F.lit("clash"))
    assert as_dict(spelling_variants.spelling_variants(table).collect()) == brute_variants(brute_words(docs))
    assert spelling_variants.spelling_variants(make_docs([])).count() == 0


def brute_phrases(docs, top=2000):
    counts: dict = {}
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts.setdefault(lang or "und", Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        rows, n = [], sum(x for p, x in f.items() if len(p) == 1)
        for p, a in f.items():
            if len(p) == 1 or a < 10 or len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and x >= 10 and 2 * x >= a for q, x in f.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 3])
def test_phrases_equal_brute_force(spark, shards):
    some = random.Random(8)
    words = ["The", "Été", "b", "c\x00d", "e", " f"] + [f"x{k}" for k in range(12)]
    weight = [9, 5, 5, 4, 3, 2] + [1] * 12
    docs = []
    for _ in range(500):
        text = "".join(w + some.choice([" "] * 9 + ["\t ", ". ", ",\r\n"]) for w in some.choices(words, weight, k=some.randint(0, 40)))
        docs.append((some.choice(["en", "fr", None]), text + some.choice(["", " late start here"])))
    docs += [(None, None), ("en", ""), ("de", "only one"), ("und", "a a a a a a a a a a a a")] + [("es", "same words again and again")] * 30
    table = spark.createDataFrame([(lang, text, 1) for lang, text in docs], "lang string, text string, n int").repartition(5)
    got = sorted(tuple(r) for r in phrase_mining.collocations(table, shards=shards).collect())
    assert got == brute_phrases(docs) and sum(len(r[2].split()) == 3 for r in got) > 20
    assert phrase_mining.collocations(table.limit(0), shards=shards).count() == 0


def test_phrases_that_share_a_place(spark, monkeypatch):
    """With a table of few places phrases are active without need, and some before their own words are; no result changes."""
    monkeypatch.setattr(phrase_mining, "PLACES", 64)
    some = random.Random(9)
    words = [f"w{k}" for k in range(160)]
    docs = [("en", " ".join(some.choices(words, [1 / (k + 1) for k in range(160)], k=30))) for _ in range(150)]
    docs += [("en", f"a{k % 9} b{k % 9} c{k % 9}") for k in range(108)]
    some.shuffle(docs)
    table = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    for shards in (2, 5):
        got = sorted(tuple(r) for r in phrase_mining.collocations(table, top=500, shards=shards).collect())
        assert got == brute_phrases(docs, 500) and sum(r[2].startswith("a") for r in got) >= 9

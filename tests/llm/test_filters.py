"""URL filters, language, HTML, quality and secrets: results on small cases, and the odd cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lintlake.llm import html_text, language_id, quality, secret_scan, url_filter


def test_urls(spark):
    cases = {
        "http://a.com": ("a.com", "", None, "allow"),
        "http://A.Com/x?y#z": ("a.com", "/x", "com/", "allow"),
        "x://example.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
        "http://sub.EXAMPLE.com/en/": ("sub.example.com", "/en/", "example.com/en/", "block"),
        "http://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://www.example.com/EN/1": ("www.example.com", "/EN/1", "com/", "allow"),
        "http://notexample.com/en/1": ("notexample.com", "/en/1", "com/", "allow"),
        "http://b.net/es/": ("b.net", "/es/", "net/es/", "block"),
        "http://net/fr/a://b": ("net", "/fr/a://b", "net/fr/", "block"),
        "http://b.net/es": ("b.net", "/es", None, "allow"),
        "http://b.net?/es/": ("b.net", "", None, "allow"),
        "http://casino.org/": ("casino.org", "/", None, "block"),
        "http://a.org/my-free-bets.html": ("a.org", "/my-free-bets.html", None, "block"),
        "http://casinos.org/": ("casinos.org", "/", None, "allow"),
        "no scheme/es/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://É.com/ü": ("É.com", "/ü", "com/", "allow"),
        "http://" + "a." * 50_000 + "com/" + "b" * 50_000: ("a." * 50_000 + "com", "/" + "b" * 50_000, "com/", "allow"),
    }
    rows = [(k, url, "kept") for k, url in enumerate(cases)] + [(0, "http://a.com", "kept")]
    out = url_filter.judge_urls(spark.createDataFrame(rows, "page_id int, url string, host string")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["url"]], r["url"]
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_url_rules_that_end_inside_a_word_and_ties(spark):
    sites = [url_filter.SiteRule("", "/ab", "block"), url_filter.SiteRule("a.b", "/", "block"), url_filter.SiteRule("a.b", "/", "allow")]
    rows = spark.createDataFrame([("s://x/abc",), ("s://q.a.b/z",), ("s://a.bb/z",)], "url string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(rows, sites=sites, words=()).collect()}
    assert got == {"s://x/abc": (None, "allow"), "s://q.a.b/z": ("a.b/", "block"), "s://a.bb/z": (None, "allow")}
    assert url_filter.judge_urls(rows, sites=(), words=()).where("verdict = 'allow'").count() == 3
    with pytest.raises(ValueError):
        url_filter.judge_urls(rows, sites=sites * url_filter.MAX_RULES)


ENGLISH = "the quick brown fox jumps over the lazy dog and runs through the green forest with all of its friends "
GERMAN = "der schnelle braune fuchs springt über den faulen hund und läuft durch den grünen wald mit allen seinen freunden "


def test_languages(spark, make_docs):
    train = make_docs([ENGLISH * 3] * 6, "en").unionByName(make_docs([GERMAN * 3] * 5, "de")).unionByName(make_docs([ENGLISH], None))
    learned = language_id.train(train)
    assert list(learned) == ["en", "de"]
    texts = [ENGLISH[20:], GERMAN[20:].upper(), "", None, "12 -- 34", "z", (ENGLISH * 2000), ENGLISH[20:]]
    rows = {r["doc_id"]: r for r in language_id.identify(make_docs(texts), learned).collect()}
    assert [rows[k]["lang_pred"] for k in range(8)] == ["en", "de", "und", "und", "und", "en", "en", "en"]
    assert [rows[k]["rejected"] for k in range(8)] == [False, False, True, True, True, True, False, False]
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    kept = language_id.keep_identified(make_docs(texts), learned)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 6, 7] and kept.columns == make_docs([]).columns
    assert language_id.train(make_docs([])) == {} and language_id.train(make_docs(["1", None])) == {}
    assert {r["lang_pred"] for r in language_id.identify(make_docs(texts), {}).collect()} == {"und"}
    assert {r["lang_pred"] for r in language_id.identify(make_docs(["½ ²", "١٢", "③"]), learned).collect()} == {"und"}
    same = make_docs([(None, ENGLISH)] * 3 + [(7, GERMAN)] * 3 + [(7, ENGLISH)], "xx")  # no id, shared ids
    assert list(language_id.train(same)) == ["xx"]
    assert language_id.identify(make_docs([]), learned).count() == 0


def test_language_on_held_out_documents(spark):
    from lintlake.llm import queries

    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = queries.op4_language_id(spark, folder).join(truth, "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.98


PAGES = {
    "<html><head><title>t</title><script>a<p>b</script></head><body><nav><a>menu</a></nav><article><h1>Head &amp; more</h1>"
    "<p>One,  two\n three.<p>Four<br>five <b>six</b>.<ul><li>x</ul></article><footer>f</footer>": "Head & more\nOne, two three.\nFour five six .\nx".replace(" .", "."),
    "<div id=c><h2>T</h2><p>Some words, and more words, and more.</p><div class='comments'><p>a, b, c, d</p></div></div>"
    "<div class=sidebar><p>s, s, s</p></div>": "T\nSome words, and more words, and more.",
    "<article><p>kept</p><aside>no</aside><form><p>no</p></form><div class='ad'>no</div><div hidden>no</div><section id=comments>no</section></article>": "kept",
    "<main><header><h1>Title</h1><p>by me</p></header><p>Body</p><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul></main>": "Title\nBody",
    "plain &lt;text&gt; only": "plain <text> only",
    "<p>un<!-- no --> closed <i>a": "un closed a",
    "<p>a &nbsp; b</p>": "a b",
    "<script>only": "",
    "": "",
    None: "",
    "<": "<",
    "<div>" * 3000 + "<p>deep</p>": "deep",
    "<p>" + "word, " * 40_000 + "</p>": ("word, " * 40_000).strip(),
}


def test_html(spark):
    rows = [(k, f"u{k}", page, k) for k, page in enumerate(PAGES)] + [(0, None, next(iter(PAGES)), 1)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(out) == len(rows)
    for r in out:
        expected = list(PAGES.values())[r["page_id"]]
        assert (r["text"], r["n_chars"]) == (expected, len(expected)), r["page_id"]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_on_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    rows = quality.classify(docs.withColumn("score", F.lit("clash"))).join(labels, "doc_id")
    right = rows.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    lost = rows.where("quality = 1 AND NOT kept").count()
    assert right > 0.97 and lost <= 2


def test_quality_of_odd_rows(make_docs):
    some = random.Random(6)
    prose = lambda n: "It was a long day for the people, and " + " ".join(
        some.choice(["the", "of", "in", "to"]) if k % 5 == 0 else "".join(some.choices("abcdeilmnorst", k=7)) + "." * (k % 12 == 1) for k in range(n))
    first = prose(60)
    texts = [first, first, None, "", "x", "BUY!! NOW!! " * 30, "a\n" * 5000, prose(60_000), *[prose(80) for _ in range(20)]]
    rows = {r["doc_id"]: r for r in quality.classify(make_docs(texts)).collect()}
    assert len(rows) == 28 and not any(rows[k]["kept"] for k in (2, 3, 5)) and rows[0]["kept"] and rows[7]["kept"]
    assert rows[2]["score"] == 0 and rows[0]["score"] == rows[1]["score"]
    assert quality.classify(make_docs([])).count() == 0


def brute_spans(text):
    kinds = (
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    found = [(m.start(), k, name, m.end()) for k, (name, p, g, n) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= n]
    return ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(found))


SECRETS = [
    'é password = "abc123=="', "PASSWD:'x'", "password=token:abcdefgh", "api_key : 0123456789abcdef0123456789abcdef", "AKIA" + "A" * 16 + "b",
    "AKIA" + "A" * 15, "AKIAAKIA" + "9" * 12, "f" * 23, "f" * 24, "", None, "to\u212Aen=abcdefgh", "secret=1\u00a0token =  ' abc", "ab " * 100_000 + "apikey=abcdef",
]


def test_secrets(make_docs):
    docs = make_docs([*SECRETS, (0, SECRETS[0])])
    out, ledger = secret_scan.scan_versions(docs.withColumn("base", F.lit("clash")))
    rows = out.collect()
    assert len(rows) == len(SECRETS) + 1 and out.columns[: len(docs.columns)] == docs.columns
    for r in rows:
        expected = brute_spans(SECRETS[r["doc_id"]] or "")
        assert r["base"] == expected and r["spans"] == expected, SECRETS[r["doc_id"]]
        assert r["n_assign"] == expected.count("assign") and r["n_hex"] == expected.count("hex") and r["n_access"] == expected.count("access")
    assert ledger.count() == len({s or "" for s in SECRETS})
    assert secret_scan.scan_versions(make_docs([]))[0].count() == 0


def test_ledger_scans_only_what_is_new(make_docs):
    first, ledger = secret_scan.scan_versions(make_docs(SECRETS))
    again, fresh = secret_scan.scan_versions(make_docs([*SECRETS, "token = new_secret"]), ledger)
    assert [bytes(r["blob"]) for r in fresh.collect()] == [hashlib.sha256(b"token = new_secret").digest()]
    assert again.where("doc_id < 14").exceptAll(first).count() == 0 and again.where("spans <> ''").count() == first.where("spans <> ''").count() + 1
    old = ledger.withColumn("rule_version", F.lit("0"))
    assert secret_scan.scan_versions(make_docs(SECRETS), old)[1].count() == ledger.count()


def test_added_kinds_and_redaction(make_docs):
    texts = ["a -----BEGIN RSA PRIVATE KEY----- b", "token=eyJhbGciOiJI.eyJzdWIiOiIx.abc-defghij z", "clean", None, SECRETS[0] + " end"]
    rows = {r["doc_id"]: r for r in secret_scan.redact(make_docs(texts)).collect()}
    assert [rows[k]["text"] for k in range(5)] == ["a <pem> b", "<assign> z", "clean", None, "é <assign>\" end"]
    assert rows[0]["n_chars"] == 9 and rows[2]["n_chars"] == 5 and len(rows) == 5

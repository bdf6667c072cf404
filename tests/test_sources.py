import io
import json
import random
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from lintlake.functions import paths
from lintlake.operators import context, exports, history, ingest, usage, views
from lintlake.sources import files as sources
from lintlake.sources import reports, store


def test_ingest(make_files):
    rows = make_files({
        "node_modules/pkg/index.js": "x", "src/app.ts": "first", "src/huge.ts": "x" * (600 * 1024), "../up.ts": "x",
        "\\win\\a.ts": "x", "src/empty.ts": "", "notes.txt": "x", "deploy/Dockerfile": "FROM x",
    })
    again = make_files({"/src/app.ts": "second"})
    every = rows.withColumn("o", F.lit(0)).unionByName(again.withColumn("o", F.lit(1)))
    every_kept = ingest.filter_supported(every)
    assert [r.path for r in every_kept.where("too_large").collect()] == ["src/huge.ts"]
    kept = ingest.dedupe_paths(every_kept.where("NOT too_large"), [F.col("o")])
    assert {r.path: r.content for r in kept.collect()} == {"src/app.ts": "first", "win/a.ts": "x", "deploy/Dockerfile": "FROM x"}
    assert [r.path for r in ingest.quarantined(every).collect()] == ["../up.ts"]


def test_budget_is_a_prefix(make_files):
    files = make_files({f"f{i}.ts": "x" * 40 for i in range(10)})
    assert ingest.corpus_budget(files, max_files=4).where("within_budget").count() == 4
    budget = ingest.corpus_budget(files, max_bytes=130)
    assert budget.where("within_budget").count() == 3 and budget.count() == files.count()


def test_globs():
    import re

    match = lambda g, p: bool(re.search(paths.glob_to_regex(g), p))
    assert match("**/node_modules/**", "a/node_modules/b/c.js") and match("**/node_modules/**", "node_modules/c.js")
    assert match("src/*.ts", "src/a.ts") and not match("src/*.ts", "src/b/a.ts")
    assert match("*.{js,ts}", "a.ts") and not match("*.{js,ts}", "a.py")
    assert re.search(paths.ignore_regex("dist"), "a/dist/b") and not re.search(paths.ignore_regex("dist"), "a/distant/b")


def test_read_files(spark, folder):
    root = Path(folder)
    (root / "src").mkdir()
    (root / "src" / "a.ts").write_text("one\ntwo", encoding="utf-8")
    (root / "bad.py").write_bytes(b"\xff\xfeok")
    rows = {r.path: r for r in sources.read_files(spark, folder).collect()}
    assert set(rows) == {"src/a.ts", "bad.py"}
    assert rows["src/a.ts"].content == "one\ntwo" and rows["src/a.ts"].size == 7 and rows["src/a.ts"].language == "ts"


def test_folders_are_listed_in_tasks(spark, folder):
    """The files that Spark's reader finds, without a listing in the driver."""
    import os

    contents = {"a.ts": b"one", "b/part-1": b"x" * 10, "b/part-2": b"y" * 40, "b/c/d/part-3": b"z", "b/c/empty": b"", "b/.hidden": b"h", ".git/part-4": b"g",
                "_tmp/part-5": b"t", "_SUCCESS": b"s", "k=1/_x=2/part-6": b"u", "n/part-7._COPYING_": b"c", "sp ace/\u00e9%20+#.ts": b"\xff\xfeok", "\u4e2d.py": b"\x00[\n"}
    for path, data in contents.items():
        os.makedirs(os.path.dirname(f"{folder}/in/{path}"), exist_ok=True)
        Path(f"{folder}/in/{path}").write_bytes(data)
    os.symlink(f"{folder}/nowhere", f"{folder}/in/broken")
    for glob, limit in ((None, None), ("part-*", None), ("part-*", 20), ("{a.ts,part-[1-2]}", 20), ("*.p[!x]", None), ("none", None)):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(f"{folder}/in")
        raw = raw.select(F.substring_index("path", f"{folder}/in/", -1), F.make_valid_utf8(F.col("content").cast("string")), "length").where(f"length <= {limit or 10**9}")
        for root in (f"{folder}/in", f"file://{folder}/in/", f"file:{folder}/in"):
            read = sources.read_files(spark, root, glob=glob, max_bytes=limit)
            assert sorted((r.path, r.content, r.size) for r in read.collect()) == sorted(map(tuple, raw.collect())), (glob, limit, root)
    assert "binaryFile" not in read._jdf.queryExecution().toString()  # a relation that holds the status of every file
    assert len(sources.read_files(spark, f"{folder}/in/a.ts").collect()) == 1


def test_archives(spark, folder):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("src/a.ts", "one")
        z.writestr("vendor/b.js", "two")
    Path(folder, "proj.zip").write_bytes(buffer.getvalue())
    Path(folder, "broken.zip").write_bytes(b"no archive")
    rows = sources.read_archives(spark, folder)
    assert sorted((r.project_id, r.path, r.content) for r in rows.collect()) == [
        ("proj", "src/a.ts", "one"), ("proj", "vendor/b.js", "two")]
    assert [r.path for r in ingest.filter_supported(rows).collect()] == ["src/a.ts"]


def test_reports(spark):
    def issues(tool, text):
        df = spark.createDataFrame([("p", "f", text)], "project_id string, file_path string, report string")
        return [r.asDict() for r in reports.READERS[tool](df).collect()]

    semgrep = '{"results": [{"check_id": "javascript.eval", "path": "t.js", "start": {"line": 1}, "extra": {"message": "m", "severity": "ERROR"}}], "errors": []}'
    (row,) = issues("semgrep", semgrep)
    assert (row["issue_id"], row["title"], row["severity"], row["line_start"], row["confidence"]) == (
        "semgrep-javascript.eval-1", "eval", "CRITICAL", 0, 70)
    assert issues("ruff", '[{"code": "S105", "message": "a\\nb", "location": {"row": 3, "column": 2}}]')[0]["title"] == "S105: a"
    for tool in reports.READERS:
        assert issues(tool, "not json") == []
        assert issues(tool, "{}") == []


def test_sarif_and_json(make_issues):
    issues = make_issues([{"issue_id": "r-1", "title": "first"}, {"issue_id": "r-2", "title": "second"}]).withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp"))
    log = json.loads(exports.export_sarif(issues).first().log)
    run = log["runs"][0]
    assert [r["name"] for r in run["tool"]["driver"]["rules"]] == ["first"]
    assert run["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 2
    chunks = exports.export_issues_json(issues, "d", size=1).collect()
    assert len(chunks) == 2 and {json.loads(c.document)["totalIssues"] for c in chunks} == {2}


def test_running_number(spark):
    numbered = exports.with_running_number(spark.range(100).select((F.col("id") * 7 % 100).alias("k")), ["k"])
    assert [(r.k, r.number) for r in numbered.orderBy("k").collect()] == [(i, i) for i in range(100)]


SNAPSHOT = "scan_id string, project_id string, scanned_at timestamp, score int, load_order int"


def test_snapshots_are_merged_by_folder(spark, folder):
    import glob
    import os

    from datetime import datetime

    make = lambda rows: spark.createDataFrame([(s, p, datetime.fromisoformat(at), n, k) for s, p, at, n, k in rows], SNAPSHOT)
    shape = spark.createDataFrame([], "scan_id string, project_id string, scanned_at timestamp, score int, month string").schema
    table = lambda: {r.scan_id: (r.project_id, r.score) for r in store.health_snapshots(spark, folder, shape).collect()}
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/snapshots/**/*.parquet", recursive=True)}
    first = [("a", "p", "2024-01-05", 1, 0), ("b", "p", "2024-02-05", 2, 0), ("c", "q", "2024-01-05", 3, 0), ("d", "q", "2024-02-05", 9, 0)]
    assert store.upsert_health_snapshot(make(first), folder) == 4
    before = files()
    # b twice, the last one wins; e is new in the same folder
    new = [("b", "p", "2024-02-05", 3, 0), ("b", "p", "2024-02-05", 4, 1), ("e", "p", "2024-02-09", 5, 0)]
    assert store.upsert_health_snapshot(make(new), folder) == 1
    assert table() == {"a": ("p", 1), "b": ("p", 4), "c": ("q", 3), "d": ("q", 9), "e": ("p", 5)}
    kept = [f for f in before if "project_id=p/month=2024-02" not in f]
    assert len(kept) == 3 and {f: files()[f] for f in kept} == {f: before[f] for f in kept}
    # d moves by a month: both folders are written, and the old one is left empty
    assert store.upsert_health_snapshot(make([("d", "q", "2024-03-01", 8, 0)]), folder) == 2
    assert table()["d"] == ("q", 8) and len(table()) == 5
    assert store.upsert_health_snapshot(make([]), folder) == 0 and len(table()) == 5


def test_cost(spark):
    calls = spark.createDataFrame([("gpt-4o", 1000, 1000), ("unknown", 1000, 0), ("gemini-1.5-flash", 1, 0)],
                                  "model string, prompt_tokens int, completion_tokens int")
    costs = [float(r.estimated_cost_usd) for r in usage.priced(calls).collect()]
    assert costs == [0.02, 0.01, 0.0]


def snapshots(spark, scores):
    rows = [("p", f"s{i}", s, f"2024-0{1 + i // 4}-{10 + i:02d} 00:00:00") for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "project_id string, scan_id string, health_score long, at string")
    return df.withColumn("scanned_at", F.col("at").cast("timestamp")).drop("at")


def test_trends(spark):
    snaps = snapshots(spark, [50, 53, 55, 52, 51, 60, 61])
    trend = {r.scan_id: r.trend for r in history.snapshot_trend(snaps).collect()}
    assert trend == {"s0": "stable", "s1": "improving", "s2": "stable", "s3": "worsening", "s4": "stable", "s5": "improving", "s6": "stable"}
    delta = {r.scan_id: r.delta for r in history.score_delta(snaps).collect()}
    assert delta["s0"] == 0 and delta["s4"] == -1 and delta["s5"] == 9
    assert history.overall_trend(snaps).first().trend == "improving"
    assert history.overall_trend(snapshots(spark, [50, 90, 10])).first().trend == "stable"
    assert history.recent_average(snaps, 30, "2024-02-17").first().average_30 == 57  # 51, 60 and 61 fall within the 30 days
    assert history.recent_average(snaps, 1, "2025-01-01").first().average_1 == 61


def test_streaks_over_chunks(spark):
    rng = random.Random(3)
    rows, expected, run = [], {}, 0
    for i in range(80):
        ok = rng.random() < 0.3
        run = 0 if ok else run + 1
        expected[i] = run
        rows.append((i, "a", ok, f"2024-01-{1 + i // 8:02d} {i % 8:02d}:00:00"))
    calls = spark.createDataFrame(rows, "call_id long, provider string, success boolean, at string").withColumn(
        "created_at", F.col("at").cast("timestamp"))
    many = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(many)
    for coalesce in ("true", "false"):  # one segment, and several of one provider
        spark.conf.set(many, coalesce)
        out = history.failure_streaks(calls).collect()
        assert {r.call_id: r.streak for r in out} == expected
        assert all(r.circuit_open == (r.streak >= 3) for r in out)
    spark.conf.set(many, before)


def test_config(make_files):
    files = make_files({".lintrc": '{"maxComplexity": 7}', ".lintrc.json": "{nope", "package.json": '{"lint": {"maxComplexity": 9}}'})
    row = history.config_precedence(files).first()
    assert (row.config_path, row.maxComplexity, row.maxLineLength) == (".lintrc", 7, 120)
    manifest = history.config_precedence(make_files({"package.json": '{"lint": {"maxComplexity": 9}}'})).first()
    assert manifest.maxComplexity == 9
    assert history.config_precedence(make_files({"a.ts": "x"})).first().maxComplexity == 10


def test_imports(make_files):
    from lintlake.rules.symbols import exports as exported, imports, symbols

    files = make_files({
        "src/a.ts": "import x, { y as z } from './b';\nimport * as n from \"../lib\";\nimport 'side';\n",
        "src/b.ts": "export const k = 1;\nexport default function go() {\n}\nimport './a';",
        "lib/index.ts": "export { p, q as r };\nclass C {\n  run(a) {\n  }\n}\n",
    })
    rows = {(r.path, r.module): r for r in imports(files).collect()}
    first = rows[("src/a.ts", "./b")]
    assert (first.default_import, list(first.named_imports), first.is_relative) == ("x", ["z"], True)
    assert rows[("src/a.ts", "../lib")].namespace_import == "n"
    resolved = context.resolve_imports(files, imports(files))
    assert {(r.path, r.resolved) for r in resolved.collect()} == {
        ("src/a.ts", "src/b.ts"), ("src/a.ts", "lib/index.ts"), ("src/b.ts", "src/a.ts")}
    related = {(r.path, r.related): r["rank"] for r in context.related_files(resolved).collect()}
    assert related[("src/a.ts", "src/b.ts")] == 1 and related[("lib/index.ts", "src/a.ts")] == 1
    assert {r.module for r in context.dependencies(imports(files)).collect()} == {"side"}
    assert {(r.name, r.kind, r.is_default) for r in exported(files).collect()} == {
        ("k", "constant", False), ("go", "function", True), ("p", "variable", False), ("r", "variable", False)}
    assert ("C.run", "function") in {(r.name, r.kind) for r in symbols(files).collect()}


def test_fix_responses(spark):
    one = '{"id": "fix-1", "suggestedCode": "const answer = 42;"}'
    texts = [f"```json\n[{one}]\n```", f'{{"suggestions": [{one}]}}', f"Sure: [{one}] done", f"[{one}", '[{"id": "x", "suggestedCode": "short"}]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string")
    assert sorted(r.n for r in context.parse_fix_response(df).collect()) == [0, 1, 2]


def test_validation(spark):
    rows = spark.createDataFrame([("ok name", "upload", None), ("bad/name", "svn", "nope")], "name string, source string, repo_full_name string")
    out = views.validate_projects(rows).collect()
    assert out[0].valid and len(out[1].errors) == 3


def test_islands_over_range_borders(spark):
    from lintlake.operators.sequence import with_islands

    rng = random.Random(4)
    rows = [(key, at, at + rng.choice([0, 0, 1, 30])) for key in "ab" for at in sorted(rng.sample(range(2000), 150))]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = with_islands(spark.createDataFrame(rows, "k string, a int, b int"), ["k"], "a", "b", 5).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    got, reach, first = {(r.k, r.a): r.island for r in out}, {}, {}
    for key, a, b in rows:
        if key not in reach or a > reach[key] + 5:
            first[key] = a
        reach[key] = max(reach.get(key, b), b)
        assert got[key, a] == first[key]


def test_requests_hold_whole_texts_and_related_files(spark, make_files):
    from lintlake.operators import context
    from lintlake.rules import symbols

    long = "".join(f"export function f{k}() {{ return {k}; }}\n" for k in range(400))
    files = make_files({"a.ts": "import { f1 } from './b';\nimport { x } from './c';\nf1();\n", "b.ts": long, "c.ts": "export const x = 1;\n", "d.ts": "", "e.ts": None})
    rows = context.analysis_request(files, symbols.symbols(files), symbols.imports(files)).collect()
    parts = {}
    for r in sorted(rows, key=lambda r: (r.path, r.part)):
        body = json.loads(r.request)
        parts.setdefault(r.path, []).append(body)
        assert body["file"]["part"] == r.part + 1 and body["file"]["parts"] == len([x for x in rows if x.path == r.path])
    assert "".join(b["code"] for b in parts["b.ts"]) == long and len(parts["b.ts"]) > 2
    assert len(parts["b.ts"][0]["context"]["symbols"]) == 400 and not parts["b.ts"][1]["context"]["symbols"]
    assert [b["code"] for b in parts["d.ts"]] == [""] == [b["code"] for b in parts["e.ts"]]
    resolved = context.resolve_imports(files, symbols.imports(files))
    edges = context.file_graph(resolved)
    assert sorted((r.path, r.dependencies, r.dependents) for r in context.file_degrees(edges).collect()) == [("a.ts", 2, 0), ("b.ts", 0, 1), ("c.ts", 0, 1)]
    issues = spark.createDataFrame([("p", "a.ts", 2, 2, "i-1", "T", "bug", "MAJOR"), ("p", "c.ts", 0, 0, "i-2", "T", "bug", "MAJOR")],
                                   "project_id string, file_path string, line_start int, line_end int, issue_id string, title string, category string, severity string")
    heads = context.related_heads(files, context.related_files(resolved))
    prompts = {r.issue_id: json.loads(r.prompt) for r in context.fix_prompt(context.fix_context(files, issues), heads).collect()}
    assert [x["path"] for x in prompts["i-1"]["related"]] == ["b.ts", "c.ts"] and prompts["i-1"]["related"][0]["head"] == long[:500]
    assert [x["path"] for x in prompts["i-2"]["related"]] == ["a.ts"] and "3: f1();" in prompts["i-1"]["code"]
    totals = context.project_context(files, issues, edges).first()
    assert (totals.n_files, totals.total_issues, totals.files_with_issues, totals.n_edges, totals.most_dependents, totals.not_imported) == (5, 2, 2, 2, 1, 3)


def test_rows_become_files_of_few_folders(spark, folder):
    rows = spark.createDataFrame([(k, "x\n" * k) for k in range(0, 3000, 100)], "file_id long, content string")
    sources.write_files(rows, f"file://{folder}/out")
    made = [p for p in Path(folder).rglob("*") if p.is_file()]
    assert len(made) == 30 and not [p for p in made if p.name.endswith(".crc")]
    assert {p.parent.name for p in made} == {"0", "1", "2"}
    read = sources.read_files(spark, f"{folder}/out", glob="part-*").select(sources.file_id_of(F.col("path")).alias("k"), "content").collect()
    assert {r.k: r.content for r in read} == {k: "x\n" * k + "\n" for k in range(0, 3000, 100)}
    other = spark.createDataFrame([("p/file_id=17/part-00000-x.c000.txt",)], "path string").select(sources.file_id_of(F.col("path")))
    assert other.first()[0] == 17


def test_texts_are_not_broadcast(make_files, make_issues):
    files, found = make_files({"src/a.ts": "a\nb\nc"}), make_issues([{"line_start": 1}])
    plan = context.fix_context(files, found)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2

import os
import random

import pandas as pd
from pyspark.sql import functions as F

from lintlake.operators.history import failure_streaks
from lintlake.rules.lines import line_issues
from lintlake.rules.registry import STYLE_RULES
from lintlake.streaming import changes, live, results, streaks


def drop(spark, folder, rows, name):
    df = spark.createDataFrame(rows, "path string, ts string, content string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{folder}/{name}")
    return df.schema


ROWS = [
    ("a", "2024-01-01 00:00:00", "a1"), ("a", "2024-01-01 00:00:01", "a2"), ("a", "2024-01-01 00:00:09", "a3"),
    ("b", "2024-01-01 00:00:00", "b1"), ("z", "2024-01-01 00:01:00", "late marker"),
]


def test_debounce(spark, folder):
    schema = drop(spark, folder, ROWS, "in")
    stream = changes.change_stream(spark, f"{folder}/in", schema)
    out = changes.drain(changes.debounce(stream), f"{folder}/work")
    assert sorted((r.path, r.content, r.changes) for r in out.collect()) == [("a", "a2", 2), ("a", "a3", 1), ("b", "b1", 1)]


def test_skip_seen(spark, folder):
    rows = [("a", "2024-01-01 00:00:00", "x"), ("a", "2024-01-01 00:00:05", "x"), ("a", "2024-01-01 00:00:06", "y"), ("b", "2024-01-01 00:00:06", "x")]
    schema = drop(spark, folder, rows, "in")
    out = changes.drain(changes.skip_seen(changes.change_stream(spark, f"{folder}/in", schema)), f"{folder}/work")
    assert sorted((r.path, r.content) for r in out.collect()) == [("a", "x"), ("a", "y"), ("b", "x")]


def test_watched(spark):
    df = spark.createDataFrame([("a/x.ts", "1"), ("node_modules/x.ts", "1"), ("a/.env.local", "1"), ("a/x.exe", "1")], "path string, content string")
    assert sorted(r.path for r in changes.watched(df).collect()) == ["a/.env.local", "a/x.ts"]


def test_watched_files_of_a_stream_are_spread(spark, folder):
    from lintlake import catalog
    from lintlake.catalog import bindings
    from lintlake.catalog.core import Tables

    parts = [(k, f"Brand#{k % 3}", f"red blue {k}", k % 50) for k in range(1, 97)]
    rows = pd.DataFrame(parts, columns=["p_partkey", "p_brand", "p_name", "p_size"])
    os.makedirs(f"{folder}/file")
    os.makedirs(f"{folder}/folder/part.parquet")
    rows.to_parquet(f"{folder}/file/part.parquet")  # a table is a file, or a folder of files
    for k in range(2):
        rows[k::2].to_parquet(f"{folder}/folder/part.parquet/part-{k}.parquet")
    shown = lambda df: sorted((r.path, r.too_large) for r in df.collect())
    for where in (f"{folder}/file", f"{folder}/folder"):
        got = shown(catalog.queries()["X01_file_change_stream"](spark, where))
        assert got and got == shown(changes.watched(bindings.code_files(Tables(spark, where)), ["**/scripts/**"], large_kilobytes=2))


LIVE = "file_path string, issue_id string"


def test_live_table(spark, folder):
    write = live.append_by_path(f"{folder}/table")
    batch = lambda rows: spark.createDataFrame(rows, LIVE)
    table = lambda: sorted((r.file_path, r.issue_id) for r in live.live_table(spark, f"{folder}/table", LIVE).collect())
    assert table() == [] and live.compact(spark, f"{folder}/table", LIVE) == -1
    write(batch([("a", "1"), ("a", "2"), ("b", "3"), ("c", "7")]), 0)
    before = {f: os.path.getmtime(f"{folder}/table/changes/version=0/{f}") for f in os.listdir(f"{folder}/table/changes/version=0")}
    write(batch([("a", "4")]), 1)
    write(batch([("a", "4")]), 1)
    assert table() == [("a", "4"), ("b", "3"), ("c", "7")]
    write(batch([("a", None), ("c", "8")]), 2)  # a was analysed again and is clean
    assert table() == [("b", "3"), ("c", "8")]
    # a batch of two files wrote two rows into its own folder and touched nothing else
    assert spark.read.parquet(f"{folder}/table/changes/version=2").count() == 2
    assert before == {f: os.path.getmtime(f"{folder}/table/changes/version=0/{f}") for f in os.listdir(f"{folder}/table/changes/version=0")}
    assert live.compact(spark, f"{folder}/table", LIVE) == 2 == live.compact(spark, f"{folder}/table", LIVE)
    assert table() == [("b", "3"), ("c", "8")]
    write(batch([("b", None), ("a", "9")]), 3)
    assert table() == [("a", "9"), ("c", "8")]
    assert live.compact(spark, f"{folder}/table", LIVE) == 3 and table() == [("a", "9"), ("c", "8")]


FILES = "project_id string, path string, content string"
CODE = {"a.ts": "if (x == y) { }\n", "b.ts": "debugger;\n", "c.py": "x = 1\n"}


def test_results_are_stored_by_content_and_rules(spark, folder):
    analysed = []

    def analyse(files):
        analysed.append(sorted((r.path, r.content) for r in files.collect()))
        return line_issues(files, STYLE_RULES).select("project_id", "file_path", "rule_id", "line_start")

    root, batch = f"{folder}/store", lambda rows: spark.createDataFrame(rows, FILES)
    first = batch([("p", path, text) for path, text in CODE.items()] + [("p", "a.ts", CODE["a.ts"])])
    write = results.analyse_new(root, "1", analyse)
    write(first, 0)
    assert analysed[-1] == sorted(CODE.items())
    # Two contents of one path, a path in another project, a known content: only the new ones are analysed.
    second = batch([("p", "a.ts", CODE["a.ts"]), ("p", "a.ts", "debugger;\ndebugger;\n"), ("p", "a.ts", "let a = 1;\n"), ("q", "b.ts", CODE["b.ts"])])
    write(second, 1)
    assert analysed[-1] == sorted([("a.ts", "debugger;\ndebugger;\n"), ("a.ts", "let a = 1;\n"), ("b.ts", CODE["b.ts"])])
    write(second, 1)  # the batch again: the same work, the same result
    assert analysed[-1] == analysed[-2]
    write(first, 2)
    assert analysed[-1] == []
    for epoch in (3, 4):  # a file without content is analysed once as well
        write(spark.createDataFrame([(None, "n.ts", None)], FILES), epoch)
    assert analysed[-2:] == [[("n.ts", "")], []]
    results.analyse_new(root, "2", analyse)(first, 0)  # other rules: everything again
    assert analysed[-1] == sorted(CODE.items())
    schema = "project_id string, file_path string, rule_id string, line_start int, hash string"
    shown = lambda df: sorted(tuple(r) for r in df.collect())
    for files, version in ((second, "1"), (first, "2")):
        stored = results.stored_issues(files, root, version, schema)
        for r in files.distinct().collect():
            one = batch([tuple(r)])
            whole = line_issues(one, STYLE_RULES).select("project_id", "file_path", "rule_id", "line_start")
            assert shown(results.stored_issues(one, root, version, schema).drop("hash").select(*whole.columns)) == shown(whole)
        assert stored.count() >= 2
    assert results.stored_issues(first, root, "3", schema).count() == 0


CALLS = "provider string, call_id long, created_at timestamp, success boolean"


def call_log(n):
    rng, at, rows = random.Random(2), pd.Timestamp("2024-01-01"), []
    for k in range(n):
        at += pd.Timedelta(seconds=rng.choice([0, 1, 20, 59, 60, 61, 200]))
        rows.append((rng.choice("abc"), k, at.to_pydatetime(), rng.random() < 0.3))
    return rows


def test_streaks_are_kept_as_state(spark, folder):
    rows = call_log(150)
    for expire in (False, True):
        root = f"{folder}/{expire}"
        for part in (rows[:60], rows[60:61], rows[61:]):  # each a run that goes on from the checkpoint
            spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(f"{root}/log")
            stream = changes.change_stream(spark, f"{root}/log", spark.createDataFrame([], CALLS).schema)
            streaks.follow_streaks(stream, root, expire=expire).awaitTermination()
        streaks.follow_streaks(stream, root, expire=expire).awaitTermination()  # nothing new
        got = {r.call_id: (r.streak, r.circuit_open) for r in spark.read.parquet(f"{root}/out").collect()}
        assert len(got) == len(rows) == spark.read.parquet(f"{root}/out").count()
        failures, last = {}, {}
        for provider, call, at, success in rows:
            n = failures.get(provider, 0)
            if expire and n >= 3 and (at - last[provider]).total_seconds() >= 60:
                n = 0
            failures[provider] = n = 0 if success else n + 1
            last[provider] = last.get(provider) if success else at
            assert got[call] == (n, n >= 3)
        if not expire:
            batch = failure_streaks(spark.createDataFrame(rows, CALLS))
            assert got == {r.call_id: (r.streak, r.circuit_open) for r in batch.collect()}


def test_sliding_rate(spark):
    rows = [(i, "k", f"2024-01-01 00:00:{s:02d}") for i, s in enumerate((0, 10, 20, 59))] + [(9, "k", "2024-01-01 00:01:05")]
    df = spark.createDataFrame(rows, "n int, key string, at string").withColumn("ts", F.col("at").cast("timestamp"))
    out = {r.n: (r.calls, r.over) for r in changes.sliding_rate(df, "key", limit=4).collect()}
    assert out == {0: (1, False), 1: (2, False), 2: (3, False), 3: (4, True), 9: (4, True)}

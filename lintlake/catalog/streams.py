"""Streaming queries: each runs over the whole given table as a stream and reads back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lintlake.catalog.bindings import ai_usage, code_files, corpus, issues
from lintlake.catalog.core import Tables, query, sql_list
from lintlake.catalog.rule_sql import EXT
from lintlake.catalog.scans import SLICE_RULES, analyse_with, rule_sql
from lintlake.operators import ingest
from lintlake.session import checkpoint_dir
from lintlake.streaming import changes, live, results, streaks


class StreamTables(Tables):
    """The given tables as streams of change records; a table is a file or a folder of files, the pattern stands for either."""

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return changes.change_stream(self.spark, f"{self.folder}/{name}.parque[t]", schema)


def _streams(t) -> StreamTables:
    return StreamTables(t.spark, t.folder)


def _folder(t, name: str) -> str:
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


_exts = sql_list(ingest.WATCHED_EXTENSIONS + ingest.WATCHED_CONFIG_EXTENSIONS)


@query("X01_file_change_stream", f"""
SELECT path, strlen(content) > 2048 AS too_large FROM {{{{code_files}}}} WHERE ({EXT} IN ({_exts}) OR lower(split_part(path, '/', -1)) IN ({sql_list(ingest.WATCHED_STREAM_NAMES)}))
  AND NOT regexp_matches(path, '^(?:.*/)?scripts/.*$')""")
def file_changes(t):
    stream = changes.watched(code_files(_streams(t)), ["**/scripts/**"], large_kilobytes=2)
    return changes.drain(stream.select("path", "too_large"), _folder(t, "changes"))


def _events(t):
    return t.events.select(F.col("user_id").cast("string").alias("path"), "ts", F.col("props").alias("content"))


@query("X02_debounce", """
WITH e AS (SELECT user_id::VARCHAR AS path, ts, props AS content FROM events),
g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY path ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts) AS burst FROM g)
SELECT path, arg_max(content, ts) AS content, count(*) AS changes FROM s GROUP BY path, burst
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 60 MINUTE FROM e)""")
def debounce(t):
    """Bursts with half an hour of quiet (the events are minutes apart); open bursts stay in the state."""
    stream = changes.debounce(_events(_streams(t)), quiet="30 minutes", lateness="60 minutes")
    return changes.drain(stream, _folder(t, "debounce")).select("path", "content", "changes")


@query("X03_skip_seen", "SELECT DISTINCT user_id::VARCHAR AS path, sha256(props)[1:16] AS hash FROM events")
def skip_seen(t):
    stream = changes.skip_seen(_events(_streams(t)), ttl="60 days")
    return changes.drain(stream, _folder(t, "seen")).select("path", "hash")


# The rules of two versions; the second one has a rule less.
_version_rules = {"1": SLICE_RULES, "2": [r for r in SLICE_RULES if r.id != "smell-todo"]}
STORED = "project_id string, file_path string, rule_id string, line_start int, hash string"
_sql_of = lambda rules: " UNION ALL ".join(f"SELECT * FROM ({rule_sql(r)})" for r in rules)


@query("X03_incremental_analyze", " UNION ALL ".join(
    f"SELECT '{version}' AS rules_version, file_path, rule_id, count(*) AS n, count(DISTINCT line_start) AS lines FROM ({_sql_of(rules)}) GROUP BY 2, 3"
    for version, rules in _version_rules.items()))
def incremental_analyze(t):
    """The corpus in two runs of one stream, the second with all files of the first again, under two versions of the rules.

    A file of the first run is not analysed again in the second; what the store holds in the end is a full analysis.
    """
    root, files = _folder(t, "analysed"), corpus(t).select("project_id", "path", "content")
    odd = F.crc32(F.col("path").cast("binary")) % 2 == 1
    for run, part in (("a", files.where(odd)), ("b", files)):
        part.write.mode("append").parquet(f"{root}/changes")
        for version, rules in _version_rules.items():
            stream = changes.change_stream(t.spark, f"{root}/changes", files.schema)
            results.incremental(stream, f"{root}/store", f"{root}/cp-{version}", version, lambda f, r=rules: analyse_with(f, r)).awaitTermination()
    out = None
    for version in _version_rules:
        found = results.stored_issues(files, f"{root}/store", version, STORED).withColumn("rules_version", F.lit(version))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("rules_version", "file_path", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("line_start").alias("lines"))


@query("X03_unseen_batch", """
SELECT e.user_id::VARCHAR AS path, sha256(e.props)[1:16] AS hash, count(*) AS n FROM events e
WHERE e.ts >= TIMESTAMP '2024-01-16' AND NOT EXISTS (SELECT 1 FROM events o WHERE o.user_id = e.user_id AND o.props = e.props AND o.ts < TIMESTAMP '2024-01-16') GROUP BY 1, 2""")
def unseen(t):
    e = _events(t)
    from lintlake.functions.text import content_hash16

    seen = e.where("ts < '2024-01-16'").select("path", content_hash16(F.col("content")).alias("hash"), F.lit("v1").alias("rules_version"))
    return changes.unseen(e.where("ts >= '2024-01-16'"), seen, "v1").groupBy("path", "hash").agg(F.count(F.lit(1)).alias("n"))


@query("X04_live_metrics", """
WITH later AS (SELECT DISTINCT file_path FROM {{head}}),
cur AS (SELECT * FROM {{head}} WHERE NOT (file_path LIKE '%7.%') UNION ALL SELECT * FROM {{base}} WHERE file_path NOT IN (SELECT file_path FROM later))
SELECT file_path, count(*) AS n, count(*) FILTER (severity = 'BLOCKER') AS blockers FROM cur GROUP BY 1""")
def live_metrics(t):
    """Two runs of one stream of issues; the second replaces the files it touches, and some of these became clean."""
    folder = _folder(t, "live")
    rows = issues(t).select("file_path", "issue_id", "severity", "created_at")
    clean = F.col("file_path").contains("7.")
    later = rows.where("created_at >= '2024-01-16'")
    later = later.where(~clean).unionByName(later.where(clean).select("file_path", F.lit(None).cast("string").alias("issue_id"), F.lit(None).cast(
        "string").alias("severity"), "created_at").dropDuplicates(["file_path"]))
    for part in (rows.where("created_at < '2024-01-16'"), later):
        part.select("file_path", "issue_id", "severity").write.mode("append").parquet(f"{folder}/changes")
        stream = changes.change_stream(t.spark, f"{folder}/changes", part.select("file_path", "issue_id", "severity").schema)
        live.live_issues(stream, f"{folder}/table", f"{folder}/cp").awaitTermination()
    table = live.live_table(t.spark, f"{folder}/table", "file_path string, issue_id string, severity string")
    return table.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"),
                                          F.count_if(F.col("severity") == "BLOCKER").alias("blockers"))


@query("X06_rate_windows", """
SELECT user_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS requests, count(*) > 2 AS over
FROM events GROUP BY 1, 2""")
def rate_windows(t):
    counts = changes.rate_windows(t.events, "user_id", limit=2, width="1 hour")
    return counts.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "requests", "over")


@query("X06_rate_windows_stream", """
SELECT user_id, epoch_us(s) AS start_us, requests FROM (
  SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS requests FROM events GROUP BY 1, 2)
WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def rate_stream(t):
    stream = changes.rate_windows(_streams(t).events, "user_id", limit=2, width="1 hour", lateness="10 minutes")
    out = changes.drain(stream, _folder(t, "rates"))
    return out.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "requests")


@query("X07_sliding_rate", """
SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS calls FROM events""")
def sliding(t):
    return changes.sliding_rate(t.events, "event_type", limit=10, seconds=3600).select("event_id", "calls")


@query("X07_sliding_windows_stream", """
SELECT event_type, epoch_us(s) AS start_us, count(*) AS calls
FROM (SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(10 * unnest(range(0, 6))) AS s FROM events)
WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""")
def sliding_stream(t):
    """Windows of an hour, one every ten minutes; those still open at the end of the log stay in the state."""
    stream = changes.sliding_windows(_streams(t).events, "event_type", width="1 hour", step="10 minutes", lateness="10 minutes")
    out = changes.drain(stream, _folder(t, "sliding"))
    return out.select("event_type", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "calls")


def _streaks_by_state(t, expire: bool):
    """The call log in three parts, each a run of one stream that starts from the state at its checkpoint."""
    root, log = _folder(t, "streaks"), ai_usage(t).select("call_id", "provider", "success", "created_at")
    for low, high in (("1900", "1994"), ("1994", "1996"), ("1996", "2100")):
        log.where(f"created_at >= '{low}-01-01' AND created_at < '{high}-01-01'").write.mode("append").parquet(f"{root}/log")
        streaks.follow_streaks(changes.change_stream(t.spark, f"{root}/log", log.schema), root, expire=expire).awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select("call_id", "streak", "circuit_open")


@query("X08_failure_streak_state", """
SELECT call_id, streak, streak >= 3 AS circuit_open FROM (
  SELECT *, CASE WHEN success THEN 0 ELSE count(*) OVER (PARTITION BY provider, g ORDER BY created_at, call_id) - CASE WHEN g > 0 THEN 1 ELSE 0 END END AS streak
  FROM (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY provider ORDER BY created_at, call_id) AS g FROM {{ai_usage}}))""")
def streak_state(t):
    return _streaks_by_state(t, expire=False)


@query("X08_circuit_expiry", """
WITH RECURSIVE calls AS (SELECT *, dense_rank() OVER (PARTITION BY provider ORDER BY created_at) AS day FROM {{ai_usage}}),
within AS (
  SELECT *, sum(success::INT) OVER (PARTITION BY provider, day ORDER BY call_id) AS ok, row_number() OVER (PARTITION BY provider, day ORDER BY call_id) AS rn FROM calls),
runs AS (SELECT *, rn - coalesce(max(CASE WHEN success THEN rn END) OVER (PARTITION BY provider, day ORDER BY call_id), 0) AS run FROM within),
days AS (SELECT provider, day, count(*) AS n, max(ok) AS ok, arg_max(run, rn) AS tail FROM runs GROUP BY 1, 2),
carried(provider, day, carry) AS (
  SELECT provider, 1::BIGINT, 0::BIGINT FROM days WHERE day = 1
  UNION ALL
  SELECT provider, day + 1, CASE WHEN streak >= 3 THEN 0 ELSE streak END
  FROM (SELECT c.provider, c.day, (CASE WHEN d.ok > 0 THEN d.tail ELSE c.carry + d.n END)::BIGINT AS streak FROM carried c JOIN days d USING (provider, day)))
SELECT call_id, streak, streak >= 3 AS circuit_open
FROM (SELECT call_id, (CASE WHEN success THEN 0 WHEN ok > 0 THEN run ELSE carry + run END)::BIGINT AS streak FROM runs JOIN carried USING (provider, day))""")
def circuit_expiry(t):
    """Calls are dated by day: an open circuit has expired by the next day with calls."""
    return _streaks_by_state(t, expire=True)

"""Queries of metrics, hotspots, history, comparison and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.catalog.bindings import ai_usage, corpus, issues, issues_large, projects, scans
from lintlake.catalog.core import query, relation, sql_case
from lintlake.catalog.ingest import CATEGORY
from lintlake.catalog.rule_sql import LANGUAGE
from lintlake.operators import compare, history, hotspots, metrics, usage
from lintlake.rules import symbols
from lintlake.schema import CATEGORIES, SEVERITIES

SEV = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in SEVERITIES)
CAT = ", ".join(f"count(*) FILTER (category = '{c}') AS {c.replace('-', '_')}" for c in CATEGORIES)
SCORE = ("greatest(0, least(100, floor(100.0::DOUBLE - blocker * 15 - critical * 10 - major * 5 - minor * 2 - "
         "info * 0.5::DOUBLE + 0.5)))::BIGINT")


@query("A01_issues_by_severity", f"SELECT project_id, {SEV} FROM {{{{issues_large}}}} GROUP BY 1")
def by_severity(t):
    return metrics.issues_by_severity(issues_large(t), ["project_id"])


@query("A02_issues_by_category", f"SELECT project_id, {CAT} FROM {{{{issues_large}}}} GROUP BY 1")
def by_category(t):
    return metrics.issues_by_category(issues_large(t), ["project_id"])


relation("file_scores", f"""
SELECT *, {SCORE} AS file_score FROM (SELECT project_id, file_path, {SEV} FROM {{{{issues_large}}}} GROUP BY 1, 2)""")


@query("A03_file_health_score", "SELECT project_id, file_path, file_score FROM {{file_scores}}")
def file_score(t):
    return metrics.file_health(issues_large(t)).select("project_id", "file_path", "file_score")


# Files analysed per project: those with issues and one clean file per line number seen.
relation("analysed", """
SELECT project_id, count(DISTINCT file_path) + 7 * (project_id % 3) AS files_analyzed FROM {{issues_large}} GROUP BY 1""")


def _analysed(t):
    return issues_large(t).groupBy("project_id").agg(F.countDistinct("file_path").alias("n")).select(
        "project_id", (F.col("n") + 7 * (F.col("project_id") % 3)).alias("files_analyzed")
    )


@query("A04_health_score_mean", """
SELECT a.project_id, floor((s.score + (greatest(files_analyzed, s.n) - s.n) * 100) / greatest(files_analyzed, s.n)::DOUBLE + 0.5)::BIGINT
  AS score_mean FROM {{analysed}} a JOIN (SELECT project_id, sum(file_score)::BIGINT AS score, count(*) AS n FROM {{file_scores}} GROUP BY 1) s
USING (project_id)""")
def mean_score(t):
    return metrics.mean_score(issues_large(t), _analysed(t))


_totals = " - ".join(f"ceil({s.lower()} / files_analyzed::DOUBLE) * {w}" for s, w in
                     (("BLOCKER", 15), ("CRITICAL", 10), ("MAJOR", 5), ("MINOR", 2), ("INFO", "0.5::DOUBLE")))


@query("A05_health_score_totals", f"""
SELECT project_id, greatest(0, least(100, floor(100.0::DOUBLE - {_totals} + 0.5)))::BIGINT AS score_totals,
  blocker * 120 + critical * 60 + major * 30 + minor * 10 + info * 5 AS tech_debt_minutes
FROM (SELECT project_id, {SEV} FROM {{{{issues_large}}}} GROUP BY 1) JOIN {{{{analysed}}}} USING (project_id)""")
def totals_score(t):
    """Also A07, the debt."""
    return metrics.project_metrics(issues_large(t), _analysed(t)).select(
        "project_id", "score_totals", "tech_debt_minutes"
    )


@query("A06_health_score_flat", f"""
SELECT project_id, file_path, greatest(0, least(100, 100 - blocker * 15 - critical * 10 - major * 5 - minor * 2 - info)) AS score_flat
FROM {{{{file_scores}}}}""")
def flat_score(t):
    return metrics.issues_by_severity(issues_large(t), ["project_id", "file_path"]).select(
        "project_id", "file_path", metrics.flat_score().alias("score_flat")
    )


@query("A07_tech_debt_minutes", f"""
SELECT project_id, (blocker * 120 + critical * 60 + major * 30 + minor * 10 + info * 5)::BIGINT AS minutes
FROM (SELECT project_id, {SEV} FROM {{{{issues_large}}}} GROUP BY 1)""")
def debt(t):
    return metrics.issues_by_severity(issues_large(t), ["project_id"]).select(
        "project_id", metrics.debt_minutes().alias("minutes")
    )


@query("A08_lines_of_code", """
SELECT project_id, sum(raw_lines)::BIGINT AS raw_lines, sum(code_lines)::BIGINT AS code_lines FROM {{line_counts}} GROUP BY 1""")
def lines_of_code(t):
    return metrics.lines_of_code(corpus(t))


@query("A08_symbol_span_lines", """
SELECT project_id, sum(line_end - line_start + 1)::BIGINT AS lines FROM {{symbols}} GROUP BY 1""")
def span_lines(t):
    return symbols.symbols(corpus(t)).groupBy("project_id").agg(F.sum(F.col("line_end") - F.col("line_start") + 1).alias("lines"))


@query("A09_avg_complexity", """
SELECT project_id, round(count(*) / any_value(files_analyzed)::DOUBLE, 6) AS avg_complexity
FROM {{issues_large}} JOIN {{analysed}} USING (project_id) GROUP BY 1""")
def avg_complexity(t):
    counted = metrics.project_metrics(issues_large(t), _analysed(t))
    return counted.select("project_id", F.round(metrics.ratio(F.col("total_issues"), F.col("files_analyzed")), 6)
                          .alias("avg_complexity"))


@query("A09_function_complexity", """
SELECT project_id, round(coalesce(any_value(f), 0) / count(*)::DOUBLE, 6) AS avg_complexity
FROM {{corpus}} LEFT JOIN (SELECT project_id, count(*) AS f FROM {{symbols}} WHERE kind = 'function' GROUP BY 1) USING (project_id) GROUP BY 1""")
def function_complexity(t):
    return metrics.function_complexity(corpus(t), symbols.symbols(corpus(t))).select("project_id", "avg_complexity")


@query("A10_file_type_histogram", f"""
SELECT file_type, n_files, (sum(n_files) OVER ())::BIGINT AS total_files
FROM (SELECT {CATEGORY} AS file_type, count(*) AS n_files FROM {{{{corpus}}}} GROUP BY 1)
QUALIFY row_number() OVER (ORDER BY n_files DESC, file_type) <= 12""")
def histogram(t):
    return metrics.file_type_histogram(corpus(t), keep=12)


@query("A11_language_stats", f"""
SELECT upper({LANGUAGE}) AS language, count(*) AS n_files FROM {{{{corpus}}}} GROUP BY 1 ORDER BY n_files DESC, language LIMIT 9""")
def languages(t):
    return metrics.language_stats(corpus(t))


@query("A12_user_stats", """
SELECT user_email, count(*) AS total_projects, coalesce(sum(n), 0)::BIGINT AS total_scans, coalesce(sum(i), 0)::BIGINT AS total_issues_found,
  CASE WHEN coalesce(sum(n), 0) > 0 THEN floor(sum(s) / sum(n)::DOUBLE + 0.5)::BIGINT ELSE 0 END AS avg_score
FROM {{projects}} LEFT JOIN (SELECT project_id, count(*) AS n, sum(total_issues) AS i, sum(overall_score) AS s FROM {{scans}} GROUP BY 1)
USING (project_id) GROUP BY 1""")
def user_stats(t):
    return metrics.user_stats(projects(t), scans(t))


@query("A16_scan_issue_count", "SELECT scan_id, count(*) AS n FROM {{issues}} GROUP BY 1")
def scan_issue_count(t):
    return metrics.scan_issue_counts(issues(t))


@query("A17_issues_by_file", """
SELECT project_id, file_path, event_id // 1024 AS chunk, count(*) AS n, string_agg(issue_id, ',' ORDER BY event_id) AS issues
FROM {{issues}} GROUP BY 1, 2, 3""")
def by_file(t):
    """Issue lists per file, in chunks of ids so that no list grows with a hot file."""
    from lintlake.operators.exports import chunked_lists

    lists = chunked_lists(issues(t), ["project_id", "file_path"], "event_id", 1024, F.struct("event_id", "issue_id"))
    return lists.select("project_id", "file_path", "chunk", "n",
                        F.array_join(F.transform("items", lambda i: i["issue_id"]), ",").alias("issues"))


@query("A20_issues_by_extension", "SELECT lower(split_part(file_path, '.', -1)) AS ext, count(*) AS n FROM {{issues}} GROUP BY 1")
def by_extension(t):
    return metrics.issues_by_extension(issues(t))


@query("A21_top_files_for_rule", """
SELECT file_path, count(*) AS n FROM {{issues}} WHERE starts_with(title, 'Line exceeds maximum length')
GROUP BY 1 ORDER BY n DESC, file_path LIMIT 10""")
def top_files(t):
    return metrics.top_files_for_rule(issues(t), "Line exceeds maximum length")


@query("A22_accuracy_estimate", """
SELECT project_id, total, fp AS false_positives, total - fp AS true_positives, floor((total - fp) / total::DOUBLE * 100 + 0.5)::BIGINT AS accuracy
FROM (SELECT project_id, count(*) AS total, (count(*) FILTER (contains(file_path, '/f1'))
  + floor(count(*) FILTER (starts_with(title, 'Line exceeds maximum length')) * 0.3::DOUBLE + 0.5)
  + floor(count(*) FILTER (starts_with(title, 'Inline function in JSX prop')) * 0.4::DOUBLE + 0.5))::BIGINT AS fp
  FROM {{issues}} GROUP BY 1)""")
def accuracy(t):
    return metrics.accuracy_estimate(issues(t), "/f1", ["project_id"])


@query("A23_snapshot_counts", """
SELECT project_id, scan_id, blocker AS blocker_count, critical AS critical_count, major AS major_count, minor AS minor_count,
  info AS info_count, total_issues FROM {{scans}}""")
def snapshot_counts(t):
    return metrics.snapshot_counts(issues(t))


@query("A25_severity_share", f"""
SELECT project_id, total, s.severity, s.n, round(least(100.0::DOUBLE, s.n / greatest(1, total)::DOUBLE * 100), 6) AS share
FROM (SELECT project_id, count(*) AS total, unnest([{', '.join(f"{{'severity': '{s}', 'n': count(*) FILTER (severity = '{s}')}}" for s in SEVERITIES)}]) AS s
      FROM {{{{issues_large}}}} GROUP BY 1)""")
def share(t):
    return metrics.severity_share(issues_large(t))


@query("A27_unique_files", """
SELECT CASE WHEN regexp_matches(issue_id, '^(semgrep|biome|ruff|tflint|checkov)-') THEN 'external' ELSE 'static' END AS source,
  count(DISTINCT file_path) AS n_files FROM {{issues}} GROUP BY 1""")
def unique_files(t):
    return metrics.unique_files(issues(t))


@query("T09_category_ranking", "SELECT category, count(*) AS n FROM {{issues_large}} GROUP BY 1")
def category_ranking(t):
    return metrics.category_ranking(issues_large(t))


# ------------------------------------------------------------------ hotspots
def _spots(keys: str) -> str:
    on = " AND ".join(f"f.{k} = q.{k}" for k in keys.split(", "))
    return f"""
WITH counted AS (SELECT *, count(*) OVER (PARTITION BY {keys}, line_start) AS n FROM {{{{issues}}}}),
q AS (SELECT * FROM counted WHERE n >= 2 OR severity IN ('BLOCKER', 'CRITICAL', 'MAJOR')
        OR regexp_matches(issue_id, 'cyclomatic|cognitive|nesting|complexity') OR category = 'security'
        OR regexp_matches(issue_id, '^(?:semgrep|checkov)-|security')),
m AS (SELECT *, max(line_end) OVER (PARTITION BY {keys} ORDER BY line_start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q),
i AS (SELECT *, sum(CASE WHEN line_start > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY line_start, event_id) AS island FROM m),
r AS (SELECT {keys}, island, title, min((line_start::BIGINT * 100000000 + event_id)) AS o FROM i GROUP BY {keys}, island, title),
rr AS (SELECT {keys}, island, list(title ORDER BY o) AS titles FROM r GROUP BY {keys}, island)
SELECT {keys}, start_line, end_line,
  list_reduce(titles, lambda acc, x: CASE WHEN contains(acc, x) THEN acc ELSE acc || '; ' || x END) AS reason,
  (['BLOCKER', 'CRITICAL', 'MAJOR', 'MINOR', 'INFO'])[rank + 1] AS severity, source
FROM (SELECT {keys}, island, min(line_start) AS start_line, max(line_end) AS end_line,
        min({sql_case('severity', {s: n for n, s in enumerate(SEVERITIES)})}) AS rank,
        arg_min(CASE WHEN regexp_matches(issue_id, '^(semgrep|biome|ruff|tflint|checkov)-') THEN 'external' ELSE 'static' END,
                line_start::BIGINT * 100000000 + event_id) AS source FROM i GROUP BY {keys}, island) JOIN rr USING ({keys}, island)"""


relation("hotspots", _spots("project_id, file_path"))


@query("W06_hotspots", "SELECT * FROM {{hotspots}}")
def file_hotspots(t):
    return hotspots.hotspots(issues(t))


@query("W06_hotspots_project", _spots("project_id"))
def project_hotspots(t):
    return hotspots.hotspots(issues(t), scope="project")


@query("P08_hotspots_min_severity", "SELECT * FROM {{hotspots}} WHERE severity IN ('BLOCKER', 'CRITICAL')")
def severe_hotspots(t):
    return hotspots.at_least(hotspots.hotspots(issues(t)), "CRITICAL")


@query("T05_top_hotspots", f"""
SELECT * FROM {{{{hotspots}}}} ORDER BY {sql_case('severity', {s: n for n, s in enumerate(SEVERITIES)})}, project_id, file_path, start_line LIMIT 10""")
def top_hotspots(t):
    return hotspots.top_hotspots(hotspots.hotspots(issues(t)))


# ------------------------------------------------------------------ history
def snapshots(t):
    return scans(t).withColumnRenamed("overall_score", "health_score")


relation("snapshots", "SELECT *, overall_score AS health_score FROM {{scans}}")


@query("W01_snapshot_trend", """
SELECT project_id, scan_id, CASE WHEN d > 2 THEN 'improving' WHEN d < -2 THEN 'worsening' ELSE 'stable' END AS trend
FROM (SELECT *, health_score - lag(health_score) OVER (PARTITION BY project_id ORDER BY scanned_at) AS d FROM {{snapshots}})""")
def trend(t):
    return history.snapshot_trend(snapshots(t)).select("project_id", "scan_id", "trend")


@query("W02_overall_trend", """
SELECT project_id, CASE WHEN a - b > 3 THEN 'improving' WHEN a - b < -3 THEN 'worsening' ELSE 'stable' END AS trend
FROM (SELECT project_id, avg(health_score) FILTER (n <= 3) AS a, avg(health_score) FILTER (n BETWEEN 4 AND 6) AS b
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY scanned_at DESC) AS n FROM {{snapshots}}) GROUP BY 1)""")
def overall_trend(t):
    return history.overall_trend(snapshots(t))


@query("W03_score_delta", """
SELECT project_id, scan_id, coalesce(health_score - lag(health_score) OVER (PARTITION BY project_id ORDER BY scanned_at), 0) AS delta
FROM {{snapshots}}""")
def delta(t):
    return history.score_delta(snapshots(t)).select("project_id", "scan_id", "delta")


@query("W04_latest_scan", """
SELECT project_id, scan_id, health_score FROM {{snapshots}} QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY scanned_at DESC) = 1""")
def latest(t):
    return history.latest_scan(snapshots(t)).select("project_id", "scan_id", "health_score")


@query("W05_last_n_scans", """
SELECT project_id, scan_id, n AS position FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY scanned_at DESC) AS n FROM {{snapshots}}) WHERE n <= 20""")
def last_scans(t):
    return history.last_n(snapshots(t), 20).select("project_id", "scan_id", "position")


@query("W05_health_history", """
SELECT project_id, scan_id, n AS position FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY scanned_at DESC) AS n FROM {{snapshots}}) WHERE n <= 30""")
def health_history(t):
    return history.health_history(snapshots(t)).select("project_id", "scan_id", "position")


@query("A24_recent_average", """
SELECT project_id, coalesce(floor(avg(health_score) FILTER (scanned_at >= TIMESTAMP '2024-01-23 12:00:00') + 0.5)::BIGINT, arg_max(health_score, scanned_at)) AS average_7,
  coalesce(floor(avg(health_score) FILTER (scanned_at >= TIMESTAMP '2023-12-31 12:00:00') + 0.5)::BIGINT, arg_max(health_score, scanned_at)) AS average_30
FROM {{snapshots}} GROUP BY 1""")
def recent(t):
    return history.recent_average(snapshots(t), (7, 30), "2024-01-30 12:00:00")


@query("J04_latest_scan_per_project", """
SELECT p.project_id, coalesce(s.scan_id, '-') AS scan_id, coalesce(s.total_issues, 0) AS total_issues
FROM {{projects}} p LEFT JOIN (SELECT * FROM {{snapshots}} QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY scanned_at DESC) = 1) s USING (project_id)""")
def with_latest(t):
    return history.project_snapshots(projects(t), snapshots(t)).select(
        "project_id", F.coalesce("scan_id", F.lit("-")).alias("scan_id"),
        F.coalesce("total_issues", F.lit(0)).alias("total_issues"),
    )


@query("W14_failure_streaks", """
SELECT call_id, provider, streak, streak >= 3 AS circuit_open FROM (
  SELECT *, CASE WHEN success THEN 0 ELSE count(*) OVER (PARTITION BY provider, g ORDER BY created_at, call_id) - CASE WHEN g > 0 THEN 1 ELSE 0 END END AS streak
  FROM (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY provider ORDER BY created_at, call_id) AS g FROM {{ai_usage}}))""")
def streaks(t):
    out = history.failure_streaks(ai_usage(t))
    return out.select("call_id", "provider", "streak", "circuit_open")


# Config files derived from the parts: one to four candidates per project, some of them unparsable.
_cfg_names = (".lintrc.json", ".lintrc", "lintrc.json", "package.json", "other.json")


def _config_files(t):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(n) for n in _cfg_names]), (k % 5).cast("int") + 1)
    ai = F.when(k % 3 == 0, F.concat(F.lit(', "ai": {"enabled": true, "provider": "m'), (k % 4).cast("string"), F.lit('"}'))).otherwise("")
    body = F.concat(F.lit('{"maxComplexity": '), F.col("p_size").cast("string"),
                    F.lit(', "rules": {"unused": "off"}'), ai, F.lit("}"))
    content = F.when(k % 7 == 0, "{broken").when(k % 5 == 3, F.concat(F.lit('{"lint": '), body, F.lit("}"))).otherwise(body)
    return t.part.select(F.expr("p_partkey div 5").alias("project_id"), name.alias("path"), content.alias("content"))


@query("W13_config_precedence", f"""
WITH c AS (SELECT p_partkey // 5 AS project_id, ([{', '.join(f"'{n}'" for n in _cfg_names)}])[(p_partkey % 5)::INT + 1] AS name,
    p_partkey AS k, p_partkey % 7 > 0 AS ok, p_size FROM part),
best AS (SELECT project_id, arg_min(name, k % 5) AS name, arg_min(p_size, k % 5) AS size, arg_min(k, k % 5) AS k FROM c WHERE ok AND k % 5 < 4 GROUP BY 1)
SELECT project_id, coalesce(any_value(best.name), '') AS config_path, coalesce(any_value(best.size), 10) AS max_complexity,
  50 AS max_function_length, CASE WHEN any_value(best.name) IS NULL THEN '' ELSE 'off' END AS unused,
  coalesce(any_value(best.k) % 3 = 0, false) AS ai_enabled, CASE WHEN any_value(best.k) % 3 = 0 THEN 'm' || (any_value(best.k) % 4) END AS ai_provider
FROM c LEFT JOIN best USING (project_id) GROUP BY 1""")
def config(t):
    out = history.config_precedence(_config_files(t))
    return out.select(
        "project_id", "config_path", F.col("maxComplexity").alias("max_complexity"),
        F.col("maxFunctionLength").alias("max_function_length"),
        F.coalesce(F.try_element_at("rules", F.lit("unused")), F.lit("")).alias("unused"), "ai_enabled", "ai_provider",
    )


# ------------------------------------------------------------------ comparison
CUT = "2024-01-16"


def _halves(t):
    i = issues(t)
    return i.where(F.col("created_at") < CUT), i.where(F.col("created_at") >= CUT)


def _scores(half):
    files = half.groupBy("project_id").agg(F.countDistinct("file_path").alias("files_analyzed"))
    return metrics.project_metrics(half, files).select("project_id", F.col("score_totals").alias("health_score"))


relation("base", f"SELECT * FROM {{{{issues}}}} WHERE created_at < TIMESTAMP '{CUT}'")
relation("head", f"SELECT * FROM {{{{issues}}}} WHERE created_at >= TIMESTAMP '{CUT}'")
_anti = """SELECT * FROM {{{{{a}}}}} a WHERE NOT EXISTS (SELECT 1 FROM {{{{{b}}}}} b WHERE b.project_id = a.project_id
  AND b.file_path = a.file_path AND b.line_start = a.line_start AND b.title = a.title)"""
relation("new_issues", _anti.format(a="head", b="base"))
relation("fixed_issues", _anti.format(a="base", b="head"))


@query("J01_compare_new", "SELECT issue_id, severity, title FROM {{new_issues}}")
def new_issues(t):
    return compare.new_issues(*_halves(t)).select("issue_id", "severity", "title")


@query("J02_compare_fixed", "SELECT issue_id, severity, title FROM {{fixed_issues}}")
def fixed_issues(t):
    return compare.fixed_issues(*_halves(t)).select("issue_id", "severity", "title")


def _score_sql(rel: str) -> str:
    return f"""SELECT project_id, greatest(0, least(100, floor(100.0::DOUBLE - {_totals} + 0.5)))::BIGINT AS health_score
      FROM (SELECT project_id, count(DISTINCT file_path) AS files_analyzed, {SEV} FROM {{{{{rel}}}}} GROUP BY 1)"""


@query("U04_except_counts", """
SELECT project_id, 'new' AS side, count(*) AS n FROM {{new_issues}} GROUP BY 1
UNION ALL SELECT project_id, 'fixed', count(*) FROM {{fixed_issues}} GROUP BY 1""")
def except_counts(t):
    """Both differences with their repeats, counted per project."""
    base, head = _halves(t)
    count = lambda df, side: df.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
    return count(compare.new_issues(base, head), "new").unionByName(count(compare.fixed_issues(base, head), "fixed"))


@query("J03_compare_summary", f"""
SELECT p.project_id, coalesce(b.health_score, 0) AS base_score, coalesce(h.health_score, 0) AS head_score,
  coalesce(h.health_score, 0) - coalesce(b.health_score, 0) AS score_delta, coalesce(n.n, 0) AS new_issues, coalesce(n.bl, 0) AS new_blockers,
  coalesce(n.cr, 0) AS new_criticals, coalesce(f.n, 0) AS fixed_issues, coalesce(n.bl, 0) + coalesce(n.cr, 0) > 0 AS regression
FROM (SELECT DISTINCT project_id FROM {{{{issues}}}}) p LEFT JOIN ({_score_sql('base')}) b USING (project_id)
LEFT JOIN ({_score_sql('head')}) h USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n, count(*) FILTER (severity = 'BLOCKER') AS bl, count(*) FILTER (severity = 'CRITICAL') AS cr
           FROM {{{{new_issues}}}} GROUP BY 1) n USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n FROM {{{{fixed_issues}}}} GROUP BY 1) f USING (project_id)""")
def summary(t):
    base, head = _halves(t)
    return compare.compare_summary(base, head, _scores(base), _scores(head))


@query("J13_tool_overlap", """
SELECT issue_id FROM {{head}} WHERE (title, split_part(file_path, '/', -1)) IN (
  SELECT (title, split_part(file_path, '/', -1)) FROM {{base}})""")
def overlap(t):
    base, head = _halves(t)
    key = lambda d: d.withColumn("path_key", F.substring_index("file_path", "/", -1))
    return compare.tool_overlap(key(head), key(base)).select("issue_id")


# ------------------------------------------------------------------ usage
_prices = lambda i: sql_case("model", {m: p[i] for m, p in usage.PRICES.items()}, str(usage.DEFAULT_PRICE[i]))
relation("priced", f"""
SELECT *, prompt_tokens + completion_tokens AS total_tokens,
  (prompt_tokens::BIGINT * {_prices(0)} + completion_tokens::BIGINT * {_prices(1)} + 500) // 1000 AS micro FROM {{{{ai_usage}}}}""")


@query("M06_ai_cost", "SELECT call_id, total_tokens, micro / 1000000 AS cost FROM {{priced}}")
def cost(t):
    return usage.priced(ai_usage(t)).select("call_id", "total_tokens", F.col("estimated_cost_usd").cast("double").alias("cost"))


_SUMS = "sum(total_tokens)::BIGINT AS total_tokens, sum(micro)::BIGINT / 1000000 AS total_cost, count(*) AS api_calls"


def _shown(df, *keys):
    return df.select(*keys, "total_tokens", F.col("total_cost_usd").cast("double").alias("total_cost"), "api_calls")


@query("A13_ai_daily_costs", f"""
SELECT user_id, strftime(created_at, '%Y-%m-%d') AS day, provider, {_SUMS} FROM {{{{priced}}}} GROUP BY 1, 2, 3""")
def daily_costs(t):
    daily = usage.daily_costs(usage.priced(ai_usage(t))).withColumn("day", F.date_format("date", "yyyy-MM-dd"))
    return _shown(daily, "user_id", "day", "provider")


@query("A14_daily_ai_cost", f"SELECT user_id, strftime(created_at, '%Y-%m-%d') AS day, {_SUMS} FROM {{{{priced}}}} GROUP BY 1, 2")
def daily_cost(t):
    daily = usage.daily_cost(usage.daily_costs(usage.priced(ai_usage(t))))
    return _shown(daily.withColumn("day", F.date_format("date", "yyyy-MM-dd")), "user_id", "day")


@query("A15_monthly_ai_cost", f"""
SELECT user_id, {_SUMS} FROM {{{{priced}}}} WHERE created_at >= TIMESTAMP '1998-02-01' AND created_at < TIMESTAMP '1998-03-01' GROUP BY 1""")
def monthly_cost(t):
    return _shown(usage.monthly_cost(usage.priced(ai_usage(t)), 1998, 2), "user_id")

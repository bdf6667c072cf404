"""Queries of reports, exports, stores and file context."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lintlake.catalog.bindings import ai_usage, code_files, files as documents_as_files, issues, projects, scans
from lintlake.catalog.core import query, relation, sql_case, sql_text
from lintlake.operators import context, exports, jobs
from lintlake.rules import spans, symbols
from lintlake.schema import SARIF_LEVEL, lookup
from lintlake.session import checkpoint_dir, cut_lineage
from lintlake.sources import files as file_sources
from lintlake.sources import reports, store

ISSUE_FIELDS = ("issue_id", "title", "description", "category", "severity", "line_start", "col_start", "line_end",
                "col_end", "code_snippet", "confidence", "impact")


# ------------------------------------------------------------------ S10-S14 reports
def _report(t, body):
    """One report per event; every tenth is broken JSON."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = t.events.withColumn("k", k)
    text = F.when(F.col("event_id") % 10 == 9, F.concat(F.lit('{"x": ['), F.col("event_id").cast("string"))).otherwise(body)
    return e.select((F.col("user_id") % 40).alias("project_id"),
                    F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file_path"), text.alias("report"))


def _pick(values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values)).cast("int") + 1)


def _sql_pick(values):
    shown = ", ".join("NULL" if v is None else sql_text(v) for v in values)
    return f"([{shown}])[(event_id % {len(values)})::INT + 1]"


_REST = "WHERE event_id % 10 < 9"
relation("report_events", "SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events WHERE event_id % 10 < 9")
SG_CATEGORY = ("security", "Performance", "correctness", "best-practice", "other", None, "vulnerability")
SG_SEVERITY = ("ERROR", "WARNING", "INFO", "high", "none")
LEVELS = ("HIGH", "MEDIUM", "LOW", None)


@query("S10_read_semgrep", f"""
SELECT 'semgrep-rules.js.' || event_type || '-' || k AS issue_id, event_type AS title,
  CASE WHEN event_id % 4 = 0 THEN 'Semgrep security finding' ELSE 'found ' || event_type END AS description,
  {sql_case(_sql_pick(SG_CATEGORY), {'Performance': 'performance', 'correctness': 'bug', 'best-practice': 'best-practice'}, "'security'")} AS category,
  {sql_case(_sql_pick(SG_SEVERITY), {'ERROR': 'CRITICAL', 'high': 'CRITICAL', 'WARNING': 'MAJOR', 'INFO': 'MINOR'}, "'INFO'")} AS severity,
  greatest(k, 1) - 1 AS line_start, k % 7 AS col_start, greatest(k, 1) AS line_end, k % 5 AS col_end, '' AS code_snippet,
  {sql_case(_sql_pick(LEVELS), {'HIGH': 95, 'MEDIUM': 75, 'LOW': 50}, '70')} AS confidence,
  {sql_case(_sql_pick(LEVELS), {'HIGH': 90, 'MEDIUM': 60}, '40')} AS impact FROM {{{{report_events}}}}""")
def semgrep(t):
    pos = lambda line, col: F.struct(line.alias("line"), col.alias("col"))
    k = F.col("k")
    finding = F.struct(
        F.concat(F.lit("rules.js."), "event_type").alias("check_id"),
        pos(k, k % 7).alias("start"),
        pos(F.greatest(k, F.lit(1)) + 1, k % 5).alias("end"),
        F.struct(
            F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("found "), "event_type")).alias("message"),
            _pick(SG_SEVERITY).alias("severity"),
            F.struct(_pick(SG_CATEGORY).alias("category"), _pick(LEVELS).alias("confidence"), _pick(LEVELS).alias("impact")).alias("metadata"),
        ).alias("extra"),
    )
    body = F.to_json(F.struct(F.array(finding).alias("results"), F.array().cast("array<string>").alias("errors")))
    return reports.read_semgrep(_report(t, body)).select(*ISSUE_FIELDS)


BIOME_CATEGORY = ("lint/suspicious/noDoubleEquals", "lint/security/x", "lint/performance/y", "lint/style/useTemplate",
                  "lint/a11y/z", "format", None)
BIOME_SEVERITY = ("error", "warning", "information", "hint")


@query("S11_read_biome", f"""
SELECT 'biome-' || coalesce(c, 'lint') || '-' || k AS issue_id, coalesce(c, 'Lint Issue') AS title, 'say ' || event_type AS description,
  {sql_case('c', {'lint/suspicious/noDoubleEquals': 'bug', 'lint/security/x': 'security', 'lint/performance/y': 'performance', 'lint/style/useTemplate': 'maintainability', 'lint/a11y/z': 'accessibility'}, "'code-smell'")} AS category,
  {sql_case('s', {'error': 'CRITICAL', 'warning': 'MAJOR', 'information': 'MINOR'}, "'INFO'")} AS severity,
  k AS line_start, k % 3 AS col_start, k + 1 AS line_end, 0 AS col_end, 'src ' || k AS code_snippet, 90 AS confidence,
  CASE WHEN s = 'error' THEN 80 ELSE 50 END AS impact
FROM (SELECT *, {_sql_pick(BIOME_CATEGORY)} AS c, {_sql_pick(BIOME_SEVERITY)} AS s FROM {{{{report_events}}}})""")
def biome(t):
    k = F.col("k")
    diagnostic = F.struct(
        _pick(BIOME_CATEGORY).alias("category"), _pick(BIOME_SEVERITY).alias("severity"),
        F.concat(F.lit("say "), "event_type").alias("description"),
        F.struct(k.alias("line_start"), (k % 3).alias("column_start"), (k + 1).alias("line_end"),
                 F.struct(k.alias("start")).alias("span")).alias("location"),
        F.struct(F.concat(F.lit("src "), k.cast("string")).alias("text")).alias("source"),
    )
    return reports.read_biome(_report(t, F.to_json(F.struct(F.array(diagnostic).alias("diagnostics"))))).select(*ISSUE_FIELDS)


RUFF_CODES = ("F401", "E501", "S105", "B006", "C901", "N802", "D100", "I001", "PL01", "UP007", "PERF1", None)


@query("S12_read_ruff", f"""
SELECT 'ruff-' || coalesce(c, 'check') || '-' || k AS issue_id, coalesce(c, 'undefined') || ': line ' || k AS title,
  'line ' || k || chr(10) || 'more' AS description,
  CASE WHEN c IS NULL THEN 'code-smell' ELSE {sql_case('c[1]', {'F': 'bug', 'B': 'bug', 'S': 'security', 'C': 'maintainability', 'D': 'maintainability', 'I': 'maintainability', 'N': 'best-practice'}, "'code-smell'")} END AS category,
  CASE WHEN c IS NULL THEN 'MAJOR' ELSE {sql_case('c[1]', {'F': 'MAJOR', 'B': 'MAJOR', 'S': 'CRITICAL'}, "'INFO'")} END AS severity,
  greatest(k, 1) - 1 AS line_start, greatest(k % 4, 1) - 1 AS col_start, greatest(k, 1) - 1 AS line_end, 0 AS col_end, '' AS code_snippet,
  95 AS confidence, CASE WHEN c IS NULL THEN 50 ELSE {sql_case('c[1]', {'S': 90, 'F': 70, 'B': 70}, '40')} END AS impact
FROM (SELECT *, {_sql_pick(RUFF_CODES)} AS c FROM {{{{report_events}}}})""")
def ruff(t):
    k = F.col("k")
    diagnostic = F.struct(
        _pick(RUFF_CODES).alias("code"), F.concat(F.lit("line "), k.cast("string"), F.lit("\nmore")).alias("message"),
        F.struct(k.alias("row"), (k % 4).alias("column")).alias("location"),
    )
    return reports.read_ruff(_report(t, F.to_json(F.array(diagnostic)))).select(*ISSUE_FIELDS)


@query("S13_read_tflint", f"""
SELECT 'tflint-rule_' || event_type || '-' || k AS issue_id, 'rule_' || event_type AS title, 'TFLint finding' AS description,
  'best-practice' AS category, {sql_case(_sql_pick(('error', 'WARNING', 'notice', 'x')), {'error': 'CRITICAL', 'WARNING': 'MAJOR', 'notice': 'MINOR'}, "'INFO'")} AS severity,
  greatest(k, 1) - 1 AS line_start, k % 6 AS col_start, greatest(k, 1) AS line_end, 0 AS col_end, '' AS code_snippet, 85 AS confidence, 60 AS impact
FROM {{{{report_events}}}}""")
def tflint(t):
    k = F.col("k")
    pos = lambda line, col: F.struct(line.alias("line"), col.alias("column"))
    issue = F.struct(
        F.concat(F.lit("rule_"), "event_type").alias("rule"), F.lit("").alias("message"),
        _pick(("error", "WARNING", "notice", "x")).alias("severity"),
        F.struct(pos(k, k % 6).alias("start"), pos(F.greatest(k, F.lit(1)) + 1, F.lit(0)).alias("end")).alias("range"),
    )
    return reports.read_tflint(_report(t, F.to_json(F.struct(F.array(issue).alias("issues"))))).select(*ISSUE_FIELDS)


@query("S14_read_checkov", f"""
SELECT 'checkov-CKV_' || k || '-' || (k + 1) AS issue_id, 'CKV_' || k || ': no ' || event_type AS title, 'no ' || event_type AS description,
  'security' AS category, {sql_case(_sql_pick(('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'NONE', None)), {'CRITICAL': 'BLOCKER', 'HIGH': 'CRITICAL', 'MEDIUM': 'MAJOR', 'LOW': 'MINOR', 'NONE': 'INFO'}, "'MAJOR'")} AS severity,
  k AS line_start, 0 AS col_start, k + 2 AS line_end, 0 AS col_end, 'aws_' || event_type AS code_snippet, 90 AS confidence,
  {sql_case(_sql_pick(('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'NONE', None)), {'CRITICAL': 100, 'HIGH': 85}, '60')} AS impact FROM {{{{report_events}}}}""")
def checkov(t):
    k = F.col("k")
    check = F.struct(
        F.concat(F.lit("CKV_"), k.cast("string")).alias("check_id"), F.concat(F.lit("no "), "event_type").alias("check_name"),
        _pick(("CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE", None)).alias("severity"),
        F.concat(F.lit("aws_"), "event_type").alias("resource"), F.array(k + 1, k + 3).alias("file_line_range"),
    )
    body = F.to_json(F.struct(F.struct(F.array(check).alias("failed_checks")).alias("results")))
    return reports.read_checkov(_report(t, body)).select(*ISSUE_FIELDS)


# ------------------------------------------------------------------ S16, S17 exports
_issue_json = """{'id': issue_id, 'title': title, 'description': description, 'category': category, 'severity': severity,
  'location': {'filePath': file_path, 'startLine': line_start, 'startColumn': col_start, 'endLine': line_end, 'endColumn': col_end},
  'codeSnippet': code_snippet, 'confidence': confidence, 'impact': impact, 'createdAt': strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'}"""


@query("S16_export_issues_json", f"""
SELECT project_id, chunk, to_json({{'exportDate': '2024-02-01T00:00:00.000Z', 'totalIssues': total, 'issues': items}})::VARCHAR AS document
FROM (SELECT project_id, event_id // 2000 AS chunk, list({_issue_json} ORDER BY event_id) AS items FROM {{{{issues}}}} GROUP BY 1, 2)
JOIN (SELECT project_id, count(*) AS total FROM {{{{issues}}}} GROUP BY 1) USING (project_id)""")
def export_json(t):
    return exports.export_issues_json(issues(t), "2024-02-01T00:00:00.000Z")


_level = sql_case("severity", SARIF_LEVEL)


@query("S17_export_sarif", rf"""
WITH r AS (SELECT project_id, regexp_replace(issue_id, '-\d+$', '') AS rule, arg_min({{'t': title, 'd': description, 'l': {_level}}}, event_id) AS f, min(event_id) AS first
           FROM {{{{issues}}}} GROUP BY 1, 2),
rules AS (SELECT project_id, list({{'id': rule, 'name': f.t, 'shortDescription': {{'text': f.d}}, 'defaultConfiguration': {{'level': f.l}}}} ORDER BY first) AS rules FROM r GROUP BY 1),
res AS (SELECT project_id, event_id // 2000 AS chunk, list({{'ruleId': regexp_replace(issue_id, '-\d+$', ''), 'level': {_level}, 'message': {{'text': description}},
    'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': file_path}}, 'region': {{'startLine': line_start + 1, 'startColumn': col_start + 1, 'endLine': line_end + 1, 'endColumn': col_end + 1}}}}}}],
    'properties': {{'category': category, 'confidence': confidence, 'impact': impact}}}} ORDER BY event_id) AS results FROM {{{{issues}}}} GROUP BY 1, 2)
SELECT project_id, chunk, to_json({{'version': '2.1.0', 'runs': [{{'tool': {{'driver': {{'name': project_id::VARCHAR, 'version': '1.0.0', 'rules': rules}}}}, 'results': results}}]}})::VARCHAR AS log
FROM res JOIN rules USING (project_id)""")
def export_sarif(t):
    return exports.export_sarif(issues(t))


@query("U05_rule_registry", r"""
SELECT project_id, regexp_replace(issue_id, '-\d+$', '') AS rule, arg_min(title, event_id) AS title FROM {{issues}} GROUP BY 1, 2""")
def registry(t):
    return exports.sarif_rules(issues(t)).select("project_id", "rule", "title")


# ------------------------------------------------------------------ S09, S18-S23 stores
def _folder(t, name: str) -> str:
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("S18_save_scan", """
SELECT project_id, count(*) AS n_issues, count(DISTINCT scan_id) AS n_scans FROM {{issues}} GROUP BY 1""")
def save_scan(t):
    root = _folder(t, "scans")
    early = issues(t).where("created_at < '2024-01-16'"), issues(t).where("created_at >= '2024-01-16'")
    every = scans(t)
    for part, test in zip(early, ("scanned_at < '2024-01-16'", "scanned_at >= '2024-01-16'")):
        store.save_scan(every.where(test), part, root)
    saved = t.spark.read.parquet(f"{root}/issues").groupBy("project_id").agg(F.count(F.lit(1)).alias("n_issues"))
    stored = t.spark.read.parquet(f"{root}/scans").groupBy("project_id").agg(F.count(F.lit(1)).alias("n_scans"))
    return saved.join(stored, "project_id").select(F.col("project_id").cast("long").alias("project_id"), "n_issues", "n_scans")


@query("S19_replace_project_files", """
SELECT project_id, count(*) AS n_files, sum(CASE WHEN p < 30 THEN 1 ELSE size END)::BIGINT AS bytes
FROM (SELECT file_id % 60 AS project_id, file_id % 60 AS p, size FROM {{code_files}}) WHERE p <> 7 GROUP BY 1""")
def replace_files(t):
    root = _folder(t, "files")
    all_files = code_files(t).select((F.col("file_id") % 60).alias("project_id"), "path", "size")
    store.replace_project_files(all_files, root)
    changed = all_files.where("project_id < 30 AND project_id <> 7").withColumn("size", F.lit(1).cast("long"))
    store.replace_project_files(changed, root, all_files.where("project_id < 30").select("project_id"))  # project 7 has no files any more
    read = store.project_files(t.spark, root)
    return read.groupBy(F.col("project_id").cast("long").alias("project_id")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes")
    )


@query("S20_upsert_health_snapshot", """
SELECT scan_id, CASE WHEN total_issues % 3 = 0 THEN -2 WHEN total_issues % 2 = 0 THEN -1 ELSE overall_score END AS health_score FROM {{scans}}""")
def upsert(t):
    """All snapshots as a first load; then some scored anew, and some of these once more, one of them moved by a month."""
    root = _folder(t, "snapshots")
    old = scans(t).select("scan_id", F.col("project_id").cast("string").alias("project_id"), "scanned_at", "total_issues", F.col("overall_score").alias("health_score"))
    old = cut_lineage(old)
    store.upsert_health_snapshot(old.withColumn("load_order", F.lit(0)), root)
    load = lambda test, score, order: old.where(test).withColumns(
        {"health_score": F.lit(score).cast("long"), "load_order": F.lit(order)})
    again = load("total_issues % 3 = 0", -2, 1)
    moved = again.withColumn("scanned_at", F.when(F.col("total_issues") % 2 == 0, F.add_months("scanned_at", 1).cast(
        dict(old.dtypes)["scanned_at"])).otherwise(F.col("scanned_at")))
    store.upsert_health_snapshot(load("total_issues % 2 = 0", -1, 0).unionByName(moved), root)
    return store.health_snapshots(t.spark, root, old.withColumn("month", F.lit("")).schema).select("scan_id", "health_score")


@query("S21_replace_suggestions", """
SELECT issue_id, 'old' AS title FROM {{issues}} WHERE severity <> 'BLOCKER'
UNION ALL SELECT issue_id, 'new ' || unnest([1, 2]) FROM {{issues}} WHERE severity = 'BLOCKER' AND confidence % 2 = 0""")
def replace_suggestions(t):
    old = issues(t).select("issue_id", F.lit("old").alias("title"))
    blockers = issues(t).where("severity = 'BLOCKER'")
    new = blockers.where("confidence % 2 = 0").select("issue_id", F.explode(F.array(F.lit("new 1"), F.lit("new 2"))).alias("title"))
    return store.replace_suggestions(old, new, blockers)


@query("S22_record_ai_usage", """
SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS calls, sum(micro)::BIGINT / 1000000 AS cost FROM {{priced}} GROUP BY 1""")
def record_usage(t):
    root = _folder(t, "usage")
    store.record_ai_usage(ai_usage(t), root)
    saved = t.spark.read.parquet(f"{root}/ai_usage")
    return saved.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("estimated_cost_usd").cast("double").alias("cost")
    )


@query("S23_map_project_upsert", """
SELECT r.new_id, coalesce(k.known, r.new_id) AS project_id, k.known IS NOT NULL AS reused
FROM (SELECT project_id + 1000000 AS new_id, user_email, CASE WHEN project_id % 3 = 0 THEN repo_full_name || 'x' ELSE repo_full_name END AS repo FROM {{projects}}) r
LEFT JOIN (SELECT user_email, repo_full_name, min(project_id) AS known FROM {{projects}} GROUP BY 1, 2) k ON k.user_email = r.user_email AND k.repo_full_name = r.repo""")
def project_upsert(t):
    p = projects(t)
    repo = F.when(F.col("project_id") % 3 == 0, F.concat("repo_full_name", F.lit("x"))).otherwise(F.col("repo_full_name"))
    requests = p.select("user_email", repo.alias("repo_full_name"), (F.col("project_id") + 1000000).alias("new_id"),
                        (F.col("project_id") + 1000000).alias("asked"))
    return store.map_project_upsert(p.select("user_email", "repo_full_name", "project_id"), requests).select(
        F.col("asked").alias("new_id"), "project_id", "reused")


@query("S09_expand_archives", "SELECT path, md5(content) AS digest FROM {{code_files}}")
def archives(t):
    """Files packed into zip archives of 64 by Spark tasks, then expanded again."""
    import io
    import zipfile

    import pandas as pd

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for path, content in zip(frame["path"], frame["content"]):
                z.writestr(path, content)
        return pd.DataFrame({"project_id": [str(frame["bundle"].iloc[0])], "content": [buffer.getvalue()]})

    bundled = code_files(t).select(F.floor(F.col("file_id") / 64).alias("bundle"), "path", "content")
    packed = bundled.groupBy("bundle").applyInPandas(pack, "project_id string, content binary")
    return file_sources.expand_archives(packed).select("path", F.md5("content").alias("digest"))


# ------------------------------------------------------------------ jobs
relation("jobs", """
SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'queued' END AS status, o_custkey AS found,
  CASE WHEN o_orderstatus = 'F' THEN o_custkey // 2 ELSE 0 END AS analysed, o_orderdate::TIMESTAMP AS started_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 900) END AS completed_at FROM orders""")


def _jobs(t):
    started = F.col("o_orderdate").cast("timestamp")
    done = F.col("o_orderstatus") == "F"
    return t.orders.select(
        F.col("o_orderkey").alias("job_id"), lookup({"O": "running", "F": "completed"}, F.col("o_orderstatus"), "queued").alias("status"),
        F.col("o_custkey").alias("files_discovered"), F.when(done, F.expr("o_custkey div 2")).otherwise(0).alias("files_analyzed"),
        started.alias("started_at"), F.when(done, started + F.make_dt_interval(secs=F.col("o_orderkey") % 900)).alias("completed_at"))


@query("A29_scan_job_report", """
SELECT status, count(*) AS jobs, sum(found)::BIGINT AS discovered, sum(analysed)::BIGINT AS analysed, round(avg(epoch(completed_at) - epoch(started_at)), 6) AS mean_seconds,
  count(*) FILTER (status = 'running' AND started_at < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 10 MINUTE) AS stale FROM {{jobs}} GROUP BY 1""")
def job_report(t):
    out = jobs.job_report(_jobs(t), as_of="1998-06-01 00:00:00")
    return out.select("status", "jobs", F.col("files_discovered").alias("discovered"), F.col("files_analyzed").alias("analysed"),
                      F.round("mean_seconds", 6).alias("mean_seconds"), "stale")


@query("A29_requeue_stale", """
SELECT job_id, CASE WHEN stale THEN 'queued' ELSE status END AS status, CASE WHEN NOT stale THEN strftime(started_at, '%Y-%m-%d') END AS started
FROM (SELECT *, status = 'running' AND started_at < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 10 MINUTE AS stale FROM {{jobs}})""")
def requeue(t):
    out = jobs.requeue_stale(_jobs(t), as_of="1998-06-01 00:00:00")
    return out.select("job_id", "status", F.date_format("started_at", "yyyy-MM-dd").alias("started"))


@query("J05_scan_job_with_owner", """
SELECT o_orderkey AS job_id, user_email FROM orders JOIN {{projects}} ON project_id = o_custkey""")
def job_owner(t):
    owned = t.orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("project_id"))
    return jobs.with_owner(owned, projects(t)).select("job_id", "user_email")


# ------------------------------------------------------------------ imports and related files
def one_repo(t):
    """The source files as one project, so that their imports can meet."""
    return code_files(t).withColumn("project_id", F.lit("repo"))


_candidates = ", ".join(f"{{'p': {i}, 's': {sql_text(s)}}}" for i, s in enumerate(context.CANDIDATE_SUFFIXES))
relation("repo_imports", "SELECT * FROM {{imports}} WHERE starts_with(path, 'repo/')")
relation("resolved", rf"""
SELECT i.path, i.position, i.module, arg_min(c.path, i.p) AS resolved
FROM (SELECT path, position, module, u.p AS p,
        regexp_replace(regexp_replace(regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || module, '/\./', '/', 'g'), '/[^/]+/\.\./', '/', 'g') || u.s AS candidate
      FROM (SELECT *, unnest([{_candidates}]) AS u FROM {{{{repo_imports}}}} WHERE is_relative)) i
JOIN {{{{code_files}}}} c ON c.path = i.candidate GROUP BY 1, 2, 3""")


@query("J08_resolve_imports", "SELECT path, position, module, resolved FROM {{resolved}}")
def resolve(t):
    files = one_repo(t)
    return context.resolve_imports(files, symbols.imports(files)).select("path", "position", "module", "resolved")


@query("J09_related_files", """
WITH pairs AS (SELECT path, resolved AS related, 0 AS side, position AS place, '' AS name FROM {{resolved}} WHERE resolved <> path
  UNION ALL SELECT resolved, path, 1, 0, path FROM {{resolved}} WHERE resolved <> path),
best AS (SELECT path, related, min((side, place, name)) AS r FROM pairs GROUP BY 1, 2)
SELECT path, related, row_number() OVER (PARTITION BY path ORDER BY r, related) AS rank FROM best""")
def related(t):
    files = one_repo(t)
    return context.related_files(context.resolve_imports(files, symbols.imports(files))).select("path", "related", "rank")


@query("J10_dependencies", "SELECT DISTINCT path, module FROM {{repo_imports}} WHERE NOT is_relative")
def dependency_rows(t):
    return context.dependencies(symbols.imports(one_repo(t))).select("path", "module")


relation("edges", "SELECT DISTINCT path AS src, resolved AS dst FROM {{resolved}} WHERE resolved <> path")


def _edges(t):
    files = one_repo(t)
    return context.file_graph(context.resolve_imports(files, symbols.imports(files)))


@query("J10_degrees", """
SELECT path, sum(o)::BIGINT AS dependencies, sum(i)::BIGINT AS dependents
FROM (SELECT src AS path, 1 AS o, 0 AS i FROM {{edges}} UNION ALL SELECT dst, 0, 1 FROM {{edges}}) GROUP BY 1""")
def degrees(t):
    return context.file_degrees(_edges(t)).select("path", "dependencies", "dependents")


@query("J10_neighbours", """
SELECT path, other, side FROM (SELECT src AS path, dst AS other, 'dependencies' AS side FROM {{edges}} UNION ALL SELECT dst, src, 'dependents' FROM {{edges}})
WHERE path IN (SELECT path FROM {{code_files}} WHERE size > 400)""")
def graph_neighbours(t):
    return context.neighbours(_edges(t), one_repo(t).where("size > 400")).select("path", "other", "side")


def _placed(t):
    """Two findings per source file, at lines told by its key."""
    files = one_repo(t)
    k = F.col("file_id")
    at = F.explode(F.array((k % 20).cast("int"), (k % 7 + 3).cast("int")))
    found = files.select("project_id", F.col("path").alias("file_path"), at.alias("line_start"), "file_id")
    return files, found.withColumns({
        "line_end": (F.col("line_start") + F.col("file_id") % 4).cast("int"),
        "issue_id": F.concat_ws("-", F.col("file_id").cast("string"), F.col("line_start").cast("string")),
        "title": F.lit("Magic number detected"), "category": F.lit("maintainability"), "severity": F.lit("INFO"),
    })


relation("placed", """
SELECT path AS file_path, line_start, (line_start + file_id % 4)::INT AS line_end, file_id || '-' || line_start AS issue_id
FROM (SELECT path, file_id, unnest([(file_id % 20)::INT, (file_id % 7 + 3)::INT]) AS line_start FROM {{code_files}})""")
relation("contexts", """
SELECT p.*, greatest(line_start - 15, 0) + 1 AS first_line,
  array_to_string(list_transform(range(greatest(line_start - 15, 0) + 1, least(len(lines), line_end + 15) + 1), lambda i: i || ': ' || lines[i]), chr(10)) AS context
FROM {{placed}} p JOIN (SELECT path, string_split(content, chr(10)) AS lines FROM {{code_files}}) f ON f.path = p.file_path""")


_folder_of = lambda c: F.regexp_extract(c, "^repo/([^/]+)/", 1)
_sql_folder = lambda c: f"regexp_extract({c}, '^repo/([^/]+)/', 1)"


@query("A26_project_context_totals", f"""
WITH f AS (SELECT {_sql_folder('path')} AS project_id, path FROM {{{{code_files}}}}),
e AS (SELECT {_sql_folder('src')} AS project_id, src, dst FROM {{{{edges}}}} WHERE {_sql_folder('src')} = {_sql_folder('dst')}),
i AS (SELECT {_sql_folder('file_path')} AS project_id, count(*) AS total_issues, count(DISTINCT file_path) AS files_with_issues FROM {{{{placed}}}} GROUP BY 1),
d AS (SELECT project_id, sum(n)::BIGINT AS n_edges, max(n) AS most_dependents, count(*) AS imported FROM (SELECT project_id, dst, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1)
SELECT project_id, count(*) AS n_files, coalesce(any_value(total_issues), 0) AS total_issues, coalesce(any_value(files_with_issues), 0) AS files_with_issues,
  coalesce(any_value(n_edges), 0) AS n_edges, coalesce(any_value(most_dependents), 0) AS most_dependents, count(*) - coalesce(any_value(imported), 0) AS not_imported
FROM f LEFT JOIN i USING (project_id) LEFT JOIN d USING (project_id) GROUP BY 1""")
def context_totals(t):
    """Top folders of the repository as projects."""
    files, found = _placed(t)
    edges = _edges(t).withColumn("project_id", _folder_of("src")).where(F.col("project_id") == _folder_of("dst"))
    return context.project_context(
        files.withColumn("project_id", _folder_of("path")), found.withColumn("project_id", _folder_of("file_path")), edges)


@query("J11_fix_context", "SELECT issue_id, first_line, context FROM {{contexts}}")
def fix_context(t):
    files, found = _placed(t)
    return context.fix_context(files, found).select("issue_id", "first_line", "context")


@query("J12_issues_in_spans", """
SELECT issue_id, kind, name, b.line_start AS span_start, b.line_end AS span_end FROM {{placed}} p
JOIN {{blocks}} b ON b.path = p.file_path AND p.line_start BETWEEN b.line_start AND b.line_end WHERE kind IN ('function', 'method', 'loop')""")
def in_spans(t):
    files, found = _placed(t)
    blocks = spans.block_spans(files, "function", "method", "loop")
    return context.issues_in_spans(found, blocks).select("issue_id", "kind", "name", "span_start", "span_end")


relation("related_heads", """
WITH pairs AS (SELECT path, resolved AS related, 0 AS side, position AS place, '' AS name FROM {{resolved}} WHERE resolved <> path
  UNION ALL SELECT resolved, path, 1, 0, path FROM {{resolved}} WHERE resolved <> path),
best AS (SELECT path, related, min((side, place, name)) AS r FROM pairs GROUP BY 1, 2),
near AS (SELECT path, related, row_number() OVER (PARTITION BY path ORDER BY r, related) AS rank FROM best QUALIFY rank <= 2)
SELECT n.path, list({'path': related, 'head': left(content, 500)} ORDER BY rank) AS related FROM near n JOIN {{code_files}} f ON f.path = related GROUP BY 1""")


@query("M15_fix_prompt", f"""
SELECT issue_id, to_json({{'task': 'fix_issue', 'issue_id': issue_id, 'title': 'Magic number detected', 'description': 'At line ' || line_start, 'category': 'maintainability', 'severity': 'INFO',
  'file': file_path, 'lines': (line_start + 1) || '-' || (line_end + 1), 'code_snippet': 'n = ' || line_start, 'code': context,
  'related': coalesce(related, []), 'guidance': {sql_text(context.CATEGORY_GUIDANCE['maintainability'])}}})::VARCHAR AS prompt
FROM {{{{contexts}}}} LEFT JOIN {{{{related_heads}}}} r ON r.path = file_path""")
def fix_prompt(t):
    files, found = _placed(t)
    found = found.withColumns({"description": F.concat(F.lit("At line "), F.col("line_start").cast("string")),
                               "code_snippet": F.concat(F.lit("n = "), F.col("line_start").cast("string"))})
    near = context.related_files(context.resolve_imports(files, symbols.imports(files)), keep=context.RELATED_FILES)
    return context.fix_prompt(context.fix_context(files, found), context.related_heads(files, near)).select("issue_id", "prompt")


@query("M15_analysis_request", """
SELECT f.path, part, to_json({'task': 'analyze_code', 'file': {'path': f.path, 'part': part + 1, 'parts': greatest((length(content) - 1) // 5000, 0) + 1},
  'context': {'symbols': CASE WHEN part = 0 THEN coalesce(s.names, []::VARCHAR[]) ELSE [] END, 'imports': CASE WHEN part = 0 THEN coalesce(i.modules, []::VARCHAR[]) ELSE [] END},
  'code': substr(content, part * 5000 + 1, 5000)})::VARCHAR AS request
FROM (SELECT path, content, unnest(range(0, greatest((length(content) - 1) // 5000, 0) + 1)) AS part
      FROM (SELECT path, content FROM {{code_files}} UNION ALL SELECT path, content FROM {{files}})) f
LEFT JOIN (SELECT path, list(name ORDER BY line_start, name, kind) AS names FROM {{symbols}} WHERE starts_with(path, 'repo/') GROUP BY 1) s USING (path)
LEFT JOIN (SELECT path, list(module ORDER BY position) AS modules FROM {{repo_imports}} GROUP BY 1) i USING (path)""")
def analysis_request(t):
    """The source files, and the documents as files without symbols whose long texts take several parts."""
    code = one_repo(t)
    every = code.unionByName(documents_as_files(t).withColumn("project_id", F.lit("repo")))
    return context.analysis_request(every, symbols.symbols(code), symbols.imports(code)).select("path", "part", "request")


# ------------------------------------------------------------------ suggestions
def _suggestions(t):
    return issues(t).where("severity IN ('BLOCKER', 'MAJOR')").select(
        F.concat(F.lit("s-"), "issue_id").alias("suggestion_id"), "issue_id", F.concat(F.lit("fix "), "title").alias("fix"))


relation("suggestions", """
SELECT 's-' || issue_id AS suggestion_id, issue_id, 'fix ' || title AS fix FROM {{issues}} WHERE severity IN ('BLOCKER', 'MAJOR')""")


@query("J14_suggestions_for_file", """
SELECT issue_id, file_path, suggestion_id, fix FROM {{issues}} JOIN {{suggestions}} USING (issue_id)""")
def suggestions_for(t):
    return context.suggestions_for(_suggestions(t), issues(t))


@query("J15_suggestion_cache_split", """
SELECT issue_id, severity IN ('BLOCKER', 'MAJOR') AS cached FROM {{issues}}""")
def cache_split(t):
    hit, miss = context.suggestion_cache_split(issues(t), _suggestions(t))
    return hit.select("issue_id", F.lit(True).alias("cached")).unionByName(miss.select("issue_id", F.lit(False).alias("cached")))


_named = "coalesce(nullif(regexp_extract(title, '[''\"]([^''\"]+)[''\"]', 1), ''), 'targetFunction')"


@query("J17_fix_template", f"""
SELECT issue_id, kind, CASE kind WHEN 'too-long' THEN 'Refactor ''' || n || ''' into smaller functions' WHEN 'deep-nesting' THEN 'Flatten nesting in ''' || n || ''''
  WHEN 'unused-variable' THEN 'Remove or use ''' || n || '''' WHEN 'complexity' THEN 'Reduce code complexity' ELSE 'Fix: ' || title END AS fix_title,
  category || ',' || severity || ',manual-guidance' AS tags
FROM (SELECT *, {_named} AS n, CASE WHEN contains(lower(title), 'too long') OR contains(lower(title), 'function length') THEN 'too-long'
  WHEN contains(lower(title), 'deep nesting') OR contains(lower(title), 'nesting depth') THEN 'deep-nesting'
  WHEN contains(lower(title), 'unused') AND contains(lower(title), 'variable') THEN 'unused-variable'
  WHEN contains(lower(title), 'complexity') THEN 'complexity' ELSE 'other' END AS kind FROM {{{{issues}}}})""")
def fix_template(t):
    return context.fix_template(issues(t)).select("issue_id", "kind", "fix_title", F.array_join("tags", ",").alias("tags"))


@query("M12_parse_fix_response", r"""
SELECT conv_id, turn, 'fix-' || turn AS id, text AS code FROM conversations
WHERE role = 'assistant' AND (conv_id + turn) % 5 < 4 AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 10""")
def parse_response(t):
    """Answers wrapped as a fenced array, a wrapped object, a bare array, prose around JSON, and broken JSON."""
    answers = t.conversations.where("role = 'assistant'")
    one = F.struct(F.concat(F.lit("fix-"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("suggestedCode"),
                   F.lit(85).alias("confidence"))
    array, wrapped = F.to_json(F.array(one)), F.to_json(F.struct(F.array(one).alias("suggestions")))
    shape = (F.col("conv_id") + F.col("turn")) % 5
    body = (
        F.when(shape == 0, F.concat(F.lit("```json\n"), array, F.lit("\n```")))
        .when(shape == 1, wrapped)
        .when(shape == 2, F.concat(F.lit("\ufeff"), array))
        .when(shape == 3, F.concat(F.lit("Here is the fix: "), wrapped, F.lit(" Done.")))
        .otherwise(F.substr(array, F.lit(1), F.length(array) - 3))
    )
    parsed = context.parse_fix_response(answers.select("conv_id", "turn", body.alias("text")))
    return parsed.select("conv_id", "turn", "id", F.col("suggestedCode").alias("code"))


# ------------------------------------------------------------------ look-ahead and n-th occurrence
@query("W10_lookahead_until", r"""
SELECT path, i - 1 AS line_no, regexp_matches(array_to_string(lines[i:i + 4], chr(10)), '^(?:[^;\n]*\n)*[^\n]*\bhelper') AS found
FROM (SELECT path, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT path, string_split(content, chr(10)) AS lines FROM {{code_files}}))""")
def lookahead(t):
    from lintlake.operators.sequence import lookahead_until

    return lookahead_until(code_files(t), 5, r"\bhelper", ";").select("path", "line_no", "found")


@query("W11_nth_occurrence", """
SELECT project_id, title, event_id FROM {{issues}} QUALIFY row_number() OVER (PARTITION BY project_id, title ORDER BY event_id) = 3""")
def nth(t):
    from lintlake.operators.sequence import nth_occurrence

    return nth_occurrence(issues(t), 3, ["project_id", "title"], ["event_id"]).select("project_id", "title", "event_id")

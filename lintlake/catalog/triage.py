"""Queries of the triage and view operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.catalog.bindings import code_files, issues, projects, scans
from lintlake.catalog.core import query, relation, sql_case, sql_list
from lintlake.operators import ingest, triage, views
from lintlake.schema import CATEGORIES, OLD_SEVERITY, PRIORITY_CATEGORY, PRIORITY_SEVERITY, SEVERITIES
from lintlake.sources import store

RANK = sql_case("severity", {s: i for i, s in enumerate(SEVERITIES)})
FLAT = ("issue_id", "file_path", "line_start", "col_start", "line_end", "col_end", "severity", "category")


def _dedupe(key: str, partition: str, run) -> None:
    @query(key, f"""
SELECT issue_id FROM {{{{issues}}}} QUALIFY row_number() OVER (PARTITION BY {partition} ORDER BY event_id) = 1""")
    def fn(t):
        return run(issues(t)).select("issue_id")


_order = ("event_id",)
_dedupe("W07_dedupe_scan", "project_id, file_path, line_start, col_start, category, severity, title",
        lambda i: triage.dedupe_scan(i, _order))
_dedupe("W07_dedupe_tools", "project_id, file_path, line_start, category, lower(title)[1:30]",
        lambda i: triage.dedupe_tools(i, _order))
_dedupe("W07_dedupe_merge", "project_id, file_path, line_start, category, lower(title)[1:20]",
        lambda i: triage.keep_first(i, ["project_id", "file_path", "line_start", "category", triage.title_key(20)], _order))

_external = "regexp_matches(issue_id, '^(semgrep|biome|ruff|tflint|checkov)-')"


@query("J06_merge_sources", f"""
WITH tool AS (SELECT * FROM {{{{issues}}}} WHERE {_external}),
own AS (SELECT * FROM {{{{issues}}}} WHERE NOT {_external})
SELECT issue_id, 'external' AS source FROM tool
UNION ALL
SELECT issue_id, 'static' FROM (
  SELECT * FROM own o WHERE NOT EXISTS (SELECT 1 FROM tool t WHERE t.project_id = o.project_id AND t.file_path = o.file_path
    AND t.line_start = o.line_start AND t.category = o.category AND lower(t.title)[1:20] = lower(o.title)[1:20])
  QUALIFY row_number() OVER (PARTITION BY project_id, file_path, line_start, category, lower(title)[1:20]
                             ORDER BY event_id) = 1)""")
def merge(t):
    from lintlake.functions.text import issue_source

    tagged = issues(t).withColumn("source", issue_source(F.col("issue_id")))
    merged = triage.merge_sources(
        triage.select_sources(tagged, "external"), triage.select_sources(tagged, "internal"), _order
    )
    return merged.select("issue_id", "source")


@query("P17_analysis_mode", f"""
SELECT 'external' AS mode, count(*) AS n FROM {{{{issues}}}} WHERE {_external}
UNION ALL SELECT 'internal', count(*) FROM {{{{issues}}}} WHERE NOT {_external}
UNION ALL SELECT 'both', count(*) FROM {{{{issues}}}}""")
def modes(t):
    from lintlake.functions.text import issue_source

    tagged = issues(t).withColumn("source", issue_source(F.col("issue_id")))
    parts = [
        triage.select_sources(tagged, m).agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("mode"), "n")
        for m in ("external", "internal", "both")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ------------------------------------------------------------------ suppression
# Source lines with directives, one file per project and path of the issues.
def _annotated(t):
    mark = (
        F.when(F.col("event_id") % 4 == 0, F.lit("x(); // lint-ignore: security-eval, unused"))
        .when(F.col("event_id") % 4 == 1, F.lit("// lint-ignore-next-line: cyclomatic , nesting"))
        .when(F.col("event_id") % 4 == 2, F.lit("/* lint-ignore-file: semgrep-xss */"))
        .otherwise(F.lit("y(); // lint-ignore: *"))
    )
    first = issues(t).groupBy("project_id", "file_path").agg(F.min("event_id").alias("event_id"))
    return first.select(
        "project_id", F.col("file_path").alias("path"),
        F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("a\nb\nc\n"), mark, F.lit("\nd")))
        .otherwise(F.concat(F.lit("a\nb\nc\nd\n"), mark)).alias("content"),
    )


relation("directives", """
WITH f AS (SELECT project_id, file_path, min(event_id) AS event_id FROM {{issues}} GROUP BY 1, 2)
SELECT project_id, file_path, unnest(['security-eval', 'unused']) AS rule, 4 AS line FROM f WHERE event_id % 4 = 0
UNION ALL SELECT project_id, file_path, unnest(['cyclomatic', 'nesting']), 4 FROM f WHERE event_id % 4 = 1
UNION ALL SELECT project_id, file_path, 'semgrep-xss', -1 FROM f WHERE event_id % 4 = 2
UNION ALL SELECT project_id, file_path, '*', 4 FROM f WHERE event_id % 4 = 3""")


@query("J07_directives", "SELECT project_id, file_path, rule, line FROM {{directives}}")
def directive_rows(t):
    return triage.directives(_annotated(t))


@query("J07_suppress", r"""
SELECT issue_id FROM {{issues}} i WHERE NOT EXISTS (
  SELECT 1 FROM {{directives}} d WHERE d.project_id = i.project_id AND d.file_path = i.file_path
    AND (d.rule = '*' OR d.rule = regexp_replace(i.issue_id, '-\d+$', '')) AND (d.line = -1 OR d.line = i.line_start))""")
def suppressed(t):
    return triage.suppress(issues(t), triage.directives(_annotated(t))).select("issue_id")


# ------------------------------------------------------------------ remapping
_arms = " ".join(
    "WHEN (regexp_matches(issue_id, '(?i){p}') OR regexp_matches(title, '(?i){p}')){extra} THEN '{s}'".format(
        p=p, s=s, extra=" AND NOT (contains(code_snippet, 'eslint-disable') OR contains(lower(description), 'justified'))"
        if p == triage.JUSTIFIABLE else "")
    for p, s in triage.REMAP_RULES
)
_paths = " OR ".join(f"contains(lower(file_path), '{p}')" for p in triage.CRITICAL_PATHS)
for _mode, _up in (
    ("observed", "CASE mapped WHEN 'CRITICAL' THEN 'MAJOR' WHEN 'MAJOR' THEN 'MINOR' WHEN 'MINOR' THEN 'INFO' ELSE mapped END"),
    ("intended", "CASE mapped WHEN 'MAJOR' THEN 'CRITICAL' WHEN 'MINOR' THEN 'MAJOR' WHEN 'INFO' THEN 'MINOR' ELSE mapped END"),
):
    relation(f"remapped_{_mode}", rf"""
SELECT *, coalesce(CASE WHEN confidence < 85 AND impact < 70 AND category = 'maintainability' THEN
    CASE mapped WHEN 'BLOCKER' THEN 'CRITICAL' WHEN 'CRITICAL' THEN 'MAJOR' WHEN 'MAJOR' THEN 'MINOR' ELSE
      CASE WHEN mapped IS NOT NULL THEN 'INFO' END END
  WHEN ({_paths}) OR (confidence >= 95 AND impact >= 90) THEN {_up} ELSE mapped END, severity) AS new_severity
FROM (SELECT *, CASE {_arms}
        WHEN regexp_matches(title, '(?i)complexity|cyclomatic|cognitive') OR regexp_matches(issue_id, '(?i)complexity|cyclomatic|cognitive')
        THEN CASE WHEN value >= 40 THEN 'CRITICAL' WHEN value >= 25 THEN 'MAJOR' ELSE 'MINOR' END END AS mapped
      FROM (SELECT *, coalesce(nullif(regexp_extract(description, '(?i)complexity[:\s]+(\d+)', 1), ''),
              nullif(regexp_extract(title, '(?i)complexity[:\s]+(\d+)', 1), ''),
              nullif(regexp_extract(description, '(\d+)[^\d]*$', 1), ''),
              nullif(regexp_extract(title, '(\d+)[^\d]*$', 1), ''), '0')::BIGINT AS value FROM {{{{issues}}}}))""")

    def _register(mode=_mode):
        @query(f"M01_remap_{mode}", f"""
SELECT issue_id, new_severity AS severity, {sql_case('new_severity', OLD_SEVERITY)} AS old_severity
FROM {{{{remapped_{mode}}}}}""")
        def run(t):
            return triage.remap(issues(t), mode).select("issue_id", "severity", "old_severity")

    _register()

_up_down = "CASE {c} WHEN 'BLOCKER' THEN 0 WHEN 'CRITICAL' THEN 1 WHEN 'MAJOR' THEN 2 WHEN 'MINOR' THEN 3 ELSE 4 END"


@query("A19_remap_stats", f"""
SELECT project_id, count(*) AS total, count(*) FILTER (new_severity <> severity) AS remapped,
  count(*) FILTER (mapped IS NOT NULL AND {_up_down.format(c='new_severity')} < {_up_down.format(c='mapped')}) AS upgraded,
  count(*) FILTER (mapped IS NOT NULL AND {_up_down.format(c='new_severity')} > {_up_down.format(c='mapped')}) AS downgraded
FROM {{{{remapped_observed}}}} GROUP BY 1""")
def remap_stats(t):
    return triage.remap_stats(triage.remap(issues(t)), ["project_id"])


_counts = ", ".join(f"count(*) FILTER (new_severity = '{s}') AS {s.lower()}" for s in SEVERITIES)


@query("A18_severity_distribution", f"SELECT project_id, {_counts} FROM {{{{remapped_observed}}}} GROUP BY 1")
def distribution(t):
    from lintlake.operators.metrics import issues_by_severity

    return issues_by_severity(triage.remap(issues(t)), ["project_id"])


# Settings by rule, as a project configuration gives them: derived from the rules seen in the issues.
_setting = "CASE length(rule) % 5 WHEN 0 THEN 'off' WHEN 1 THEN 'warn' WHEN 2 THEN 'error' WHEN 3 THEN 'loud' ELSE '{\"severity\": \"blocker\"}' END"


@query("P09_apply_rule_overrides", rf"""
SELECT issue_id, CASE upper(setting) WHEN 'WARN' THEN 'MINOR' WHEN 'ERROR' THEN 'MAJOR' WHEN '{{"SEVERITY": "BLOCKER"}}' THEN 'BLOCKER' ELSE severity END AS severity
FROM (SELECT *, CASE WHEN rule <> 'unused' THEN {_setting} END AS setting
      FROM (SELECT *, regexp_replace(issue_id, '-\d+$', '') AS rule FROM {{{{issues}}}}))
WHERE setting IS DISTINCT FROM 'off'""")
def overrides(t):
    from lintlake.functions.text import base_rule_id

    rules = issues(t).select(base_rule_id(F.col("issue_id")).alias("rule")).distinct().where("rule <> 'unused'")
    setting = F.element_at(F.array(*[F.lit(s) for s in ("off", "warn", "error", "loud", '{"severity": "blocker"}')]),
                           F.length("rule") % 5 + 1)
    return triage.apply_rule_overrides(issues(t), rules.withColumn("setting", setting)).select("issue_id", "severity")


_prio = (
    f"round({sql_case('severity', PRIORITY_SEVERITY, '0')} * 0.4 + {sql_case('category', PRIORITY_CATEGORY, '0')} * 0.2 "
    "+ confidence * 0.2 + impact * 0.2, 6)::DOUBLE"
)


@query("M02_priority", f"SELECT issue_id, {_prio} AS priority FROM {{{{issues}}}}")
def priority(t):
    return issues(t).select("issue_id", F.round(triage.priority(), 6).alias("priority"))


@query("T03_priority_rank", f"""
SELECT issue_id, {_prio} AS priority FROM {{{{issues}}}}""")
def priority_rank(t):
    ranked = issues(t).withColumn("priority", F.round(triage.priority(), 6))
    return ranked.select("issue_id", "event_id", "priority").orderBy(F.desc("priority"), "event_id").drop("event_id")


# ------------------------------------------------------------------ views
@query("P01_issue_round_trip", f"SELECT {', '.join(FLAT)} FROM {{{{issues}}}}")
def round_trip(t):
    return views.issue_flat(views.issue_nested(issues(t))).select(*FLAT)


@query("P02_normalize_severity", f"""
SELECT event_type AS raw, coalesce(CASE WHEN upper(raw2) IN ({sql_list(SEVERITIES)}) THEN upper(raw2) END, 'INFO') AS severity,
  count(*) AS n FROM (SELECT event_type, CASE event_type WHEN 'error' THEN 'Blocker' WHEN 'click' THEN 'minor'
  WHEN 'view' THEN 'MAJOR' ELSE event_type END AS raw2 FROM events) GROUP BY 1, 2""")
def severities(t):
    from lintlake.schema import lookup

    raw = F.coalesce(
        lookup({"error": "Blocker", "click": "minor", "view": "MAJOR"}, F.col("event_type")), F.col("event_type")
    )
    return t.events.groupBy(
        F.col("event_type").alias("raw"), views.normalize_severity(raw).alias("severity")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("P03_normalize_category", f"""
SELECT issue_id, CASE WHEN c IN ({sql_list(CATEGORIES)}) THEN c ELSE 'code-smell' END AS category
FROM (SELECT issue_id, CASE WHEN event_id % 3 = 0 THEN upper(category) ELSE category END AS c FROM {{{{issues}}}})""")
def categories(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.upper("category")).otherwise(F.col("category"))
    return issues(t).select("issue_id", views.normalize_category(raw).alias("category"))


_sev_cols = ", ".join(s.lower() for s in SEVERITIES)
_cat_cols = ", ".join(c.replace("-", "_") for c in CATEGORIES)


@query("P04_scan_metrics", f"""
SELECT scan_id, overall_score::DOUBLE AS overall_score, {_sev_cols}, {_cat_cols} FROM {{{{scans}}}}""")
def scan_metrics(t):
    s = scans(t)
    stored = lambda names: F.to_json(F.map_filter(
        F.create_map(*[x for n in names for x in (F.lit(n), F.col(n.lower().replace("-", "_")).cast("int"))]),
        lambda k, v: v > 0,
    ))
    s = s.withColumns({"issues_by_severity": stored(SEVERITIES), "issues_by_category": stored(CATEGORIES)})
    return views.scan_metrics_view(s.select("scan_id", "overall_score", "issues_by_severity", "issues_by_category"))


@query("P05_suggestion_view", """
SELECT issue_id, CASE WHEN event_id % 2 = 0 THEN code_snippet ELSE '' END AS original_code,
  CASE WHEN event_id % 3 = 0 THEN confidence ELSE 0 END AS confidence, category || ',' || severity AS tags,
  CASE WHEN event_id % 4 = 0 THEN file_path ELSE '' END AS at FROM {{issues}}""")
def suggestions(t):
    rows = issues(t).select(
        "issue_id",
        F.when(F.col("event_id") % 2 == 0, F.col("code_snippet")).alias("original_code"),
        F.lit(None).cast("string").alias("suggested_code"),
        F.lit(None).cast("string").alias("diff"),
        F.when(F.col("event_id") % 3 == 0, F.col("confidence")).alias("confidence"),
        F.lit(None).cast("int").alias("impact"),
        F.concat(F.lit('["'), "category", F.lit('", 7, "'), "severity", F.lit('", null]')).alias("tags"),
        F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct(F.col("file_path").alias("filePath")))).alias("location"),
    )
    view = views.suggestion_view(rows)
    return view.select("issue_id", "original_code", "confidence", F.array_join("tags", ",").alias("tags"),
                       F.coalesce("location.filePath", F.lit("")).alias("at"))


@query("P05_scan_job_view", """
SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END AS files_discovered,
  coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'failed' END, '-') AS error_message FROM orders""")
def jobs(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("files_discovered"),
        F.lit(None).cast("int").alias("files_analyzed"),
        F.lit(None).cast("int").alias("issue_count"),
        F.when(F.col("o_orderkey") % 3 == 0, "failed").otherwise("").alias("error_message"),
    )
    return views.scan_job_view(rows).select("job_id", "files_discovered",
                                            F.coalesce("error_message", F.lit("-")).alias("error_message"))


@query("P06_search_issues", """
SELECT issue_id FROM {{issues}} WHERE (contains(lower(title), 'unused') OR contains(lower(description), 'unused')
  OR contains(lower(file_path), 'unused')) AND severity IN ('BLOCKER', 'MINOR') AND category IN ('bug', 'security')""")
def search(t):
    return views.search_issues(issues(t), "UNUSED", ["BLOCKER", "MINOR"], ["bug", "security"]).select("issue_id")


@query("P07_scan_issues_page", """
SELECT issue_id, severity FROM {{issues}} WHERE scan_id = '3-2024-01-09' ORDER BY severity, created_at, issue_id LIMIT 5 OFFSET 2""")
def page(t):
    return views.scan_issues_page(issues(t), "3-2024-01-09", offset=2, limit=5).select("issue_id", "severity")


@query("P11_validate_external", """
SELECT issue_id, (raw_title <> '' AND old IN ('error', 'warning', 'info', 'hint') AND category <> 'accessibility') AS valid
FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN '' ELSE title END AS raw_title,
  CASE WHEN event_id % 7 = 3 THEN 'fatal' WHEN severity = 'BLOCKER' THEN 'error' WHEN severity = 'CRITICAL' THEN 'error'
       WHEN severity = 'MAJOR' THEN 'warning' WHEN severity = 'MINOR' THEN 'info' ELSE 'hint' END AS old FROM {{issues}})""")
def external(t):
    from lintlake.schema import lookup

    rows = issues(t).withColumns({
        "title": F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("title")),
        "severity": F.when(F.col("event_id") % 7 == 3, "fatal").otherwise(lookup(OLD_SEVERITY, F.col("severity"))),
    })
    return views.validate_external(rows).select("issue_id", "valid")


@query("P12_validate_suggestions", r"""
SELECT conv_id, turn, (role = 'assistant' AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 10) AS valid FROM conversations""")
def suggestion_validity(t):
    identifier = F.when(F.col("role") == "assistant", "fix-1").otherwise("")
    return t.conversations.select("conv_id", "turn", views.valid_suggestion(identifier, F.col("text")).alias("valid"))


@query("P14_input_validation", r"""
SELECT project_id, len(e) = 0 AS valid, array_to_string(e, '; ') AS errors FROM (
  SELECT project_id, list_filter([CASE WHEN length(name) < 1 THEN 'name is required' END,
    CASE WHEN length(name) > 100 THEN 'name is too long' END,
    CASE WHEN NOT regexp_matches(name, '^[\w\s\-.]+$') THEN 'name has other characters' END,
    CASE WHEN source NOT IN ('upload', 'github') THEN 'source is unknown' END,
    CASE WHEN NOT regexp_matches(repo, '^[\w.-]+/[\w.-]+$') THEN 'repository is not owner/name' END], lambda x: x IS NOT NULL) AS e
  FROM (SELECT project_id, CASE project_id % 4 WHEN 0 THEN name WHEN 1 THEN replace(name, '#', ' ') || repeat('x', 90) WHEN 2 THEN '' ELSE replace(name, '#', '-') END AS name,
               CASE WHEN project_id % 5 = 0 THEN 'svn' ELSE source END AS source,
               CASE WHEN project_id % 6 = 0 THEN replace(repo_full_name, '/', ':') ELSE repo_full_name END AS repo FROM {{projects}}))""")
def project_validity(t):
    k = F.col("project_id")
    rows = projects(t).withColumns({
        "name": F.when(k % 4 == 0, F.col("name")).when(
            k % 4 == 1, F.concat(F.replace("name", F.lit("#"), F.lit(" ")), F.repeat(F.lit("x"), 90))
        ).when(k % 4 == 2, "").otherwise(F.replace("name", F.lit("#"), F.lit("-"))),
        "source": F.when(k % 5 == 0, "svn").otherwise(F.col("source")),
        "repo_full_name": F.when(k % 6 == 0, F.replace("repo_full_name", F.lit("/"), F.lit(":"))).otherwise(
            F.col("repo_full_name")),
    })
    return views.validate_projects(rows).select("project_id", "valid", F.array_join("errors", "; ").alias("errors"))


_hash = lambda sql: f"substr({sql}, 1, 8) || '-' || substr({sql}, 9, 4) || '-' || substr({sql}, 13, 4) || '-' || substr({sql}, 17, 4) || '-' || substr({sql}, 21, 12)"


@query("P14_uuid", rf"""
SELECT project_id, regexp_matches(id, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-8][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$') AS valid
FROM (SELECT project_id, CASE WHEN project_id % 9 = 0 THEN name WHEN project_id % 2 = 0 THEN upper({_hash('md5(name)')}) ELSE {_hash('md5(name)')} END AS id FROM {{{{projects}}}})""")
def uuid_validity(t):
    digest = F.expr(_hash("md5(name)"))
    k = F.col("project_id")
    rows = projects(t).withColumn("id", F.when(k % 9 == 0, F.col("name")).when(k % 2 == 0, F.upper(digest)).otherwise(digest))
    return views.validate_ids(rows, "id").select("project_id", "valid")


@query("P16_tenant_scope", """
SELECT issue_id FROM {{issues}} WHERE project_id IN (
  SELECT project_id FROM {{projects}} WHERE lower(user_email) = 'building1@example.com')""")
def tenant(t):
    return views.tenant_scope(issues(t), projects(t), "BUILDING1@example.com").select("issue_id")


# ------------------------------------------------------------------ orders
@query("T01_issue_order", f"SELECT issue_id, severity, line_start FROM {{{{issues}}}} ORDER BY {RANK}, line_start, issue_id")
def issue_order(t):
    return issues(t).orderBy(*views.issue_order()).select("issue_id", "severity", "line_start")


for _by, _sql in (("severity", RANK), ("category", "category"), ("file", "file_path"), ("date", "created_at DESC")):
    def _register_sort(by=_by, sql=_sql):
        @query(f"T02_sort_by_{by}", f"SELECT issue_id FROM {{{{issues}}}} ORDER BY {sql}, issue_id")
        def run(t):
            return views.sort_issues(issues(t), by).select("issue_id")

    _register_sort()


@query("T04_top_issues", f"SELECT issue_id, severity FROM {{{{issues}}}} ORDER BY {RANK}, line_start, issue_id LIMIT 5")
def top_issues(t):
    return views.top_issues(issues(t)).select("issue_id", "severity")


@query("T06_projects_newest", """
SELECT p.project_id, strftime(s.updated, '%Y-%m-%d %H:%M:%S') AS updated FROM {{projects}} p
JOIN (SELECT project_id, max(created_at) AS updated FROM {{issues}} GROUP BY 1) s USING (project_id)
ORDER BY s.updated DESC, p.project_id""")
def newest_projects(t):
    """Projects that a scan has touched, by their newest scan."""
    rows = projects(t).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    scanned = issues(t).select("project_id", F.col("created_at").cast("timestamp_ntz").alias("scanned_at"))
    touched = store.touched_projects(rows, scanned).where("updated_at IS NOT NULL")
    return views.newest_first(touched).select("project_id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@query("T07_file_order", """
SELECT path, size FROM {{code_files}} ORDER BY length(path), path""")
def file_order(t):
    from lintlake.operators.ingest import path_order

    return code_files(t).select("path", "size").orderBy(*path_order())


@query("U02_union_ignores", """
SELECT DISTINCT pattern FROM (SELECT lower(p_type) AS pattern FROM part UNION ALL SELECT split_part(p_name, ' ', 2) FROM part)""")
def ignores(t):
    user = t.part.select(F.lower("p_type").alias("pattern"))
    project = t.part.select(F.element_at(F.split("p_name", " "), 2).alias("pattern"))
    return ingest.union_patterns(user, project)

"""Queries of the ingest operators and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lintlake.catalog.bindings import code_files, corpus, issues
from lintlake.catalog.core import query, relation, sql_case, sql_list, sql_text
from lintlake.catalog.rule_sql import DAEMON_CONTEXT, EXT, LANGUAGE, WEB_CONTEXT
from lintlake.functions import dates, paths, text
from lintlake.operators import ingest
from lintlake.schema import OLD_SEVERITY, SARIF_LEVEL, lookup
from lintlake.session import checkpoint_dir
from lintlake.sources import files as file_sources

# Paths as uploads bring them: back slashes, leading slashes, climbing and vendor folders.
MESSY = ("", "/", "\\", "../", "node_modules/", "a\\..\\", "Build/", "vendor/x/")


def messy(t):
    prefix = F.element_at(F.array(*[F.lit(m) for m in MESSY]), (F.col("file_id") % len(MESSY)).cast("int") + 1)
    return corpus(t).withColumn("path", F.concat(prefix, "path"))


relation("messy", f"""
SELECT project_id, ([{sql_list(MESSY)}])[(file_id % {len(MESSY)})::INT + 1] || path AS path, content, size, file_id
FROM {{{{corpus}}}}""")
_norm = "regexp_replace(replace(path, chr(92), '/'), '^/+', '')"
relation("normalized", f"""
SELECT project_id, {_norm} AS path, content, size, file_id FROM {{{{messy}}}}
WHERE NOT (contains({_norm}, '../') OR {_norm} = '..')""")


@query("S01_read_files", "SELECT project_id, path, md5(content) AS digest, size FROM {{corpus}}")
def read_files(t):
    return corpus(t).select("project_id", "path", F.md5("content").alias("digest"), "size")


@query("S01_read_folder", """
SELECT file_id, md5(content || chr(10)) AS digest, strlen(content) + 1 AS size FROM {{code_files}} WHERE strlen(content) < 4096""")
def read_folder(t):
    """The source files written to a folder, one file each, and read from there; those above a size limit are not opened."""
    root = f"{checkpoint_dir(t.spark)}/folder-{uuid.uuid4().hex}"
    file_sources.write_files(code_files(t), root)
    read = file_sources.read_files(t.spark, root, glob="part-*", max_bytes=4096)
    return read.select(file_sources.file_id_of(F.col("path")).alias("file_id"), F.md5("content").alias("digest"), "size")


@query("S02_normalize_path", """
SELECT path, FALSE AS rejected FROM {{normalized}}
UNION ALL SELECT path, TRUE FROM {{messy}} WHERE file_id % 8 IN (3, 5)""")
def normalize(t):
    m = messy(t)
    good = ingest.normalized(m).select("path", F.lit(False).alias("rejected"))
    return good.unionByName(ingest.quarantined(m).select("path", F.lit(True).alias("rejected")))


@query("S03_language_of", f"SELECT path, {LANGUAGE} AS language FROM {{{{corpus}}}}")
def language(t):
    return corpus(t).select("path", paths.language_of(F.col("path")).alias("language"))


_key = f"CASE WHEN {EXT} <> '' THEN {EXT} ELSE lower(split_part(path, '/', -1)) END"
CATEGORY = (
    f"coalesce({sql_case(_key, paths.CATEGORY_LABELS)}, "
    f"nullif(upper(regexp_replace({_key}, '\\.', '')), ''), 'Other')"
)


@query("S04_file_category", f"SELECT path, {CATEGORY} AS category FROM {{{{corpus}}}}")
def category(t):
    return corpus(t).select("path", paths.file_category(F.col("path")).alias("category"))


_iext = "CASE WHEN ends_with(lower(path), 'dockerfile') THEN 'dockerfile' ELSE split_part(lower(path), '.', -1) END"
_excluded = " OR ".join(f"contains(lower(path), {sql_text(s)})" for s in ingest.EXCLUDED_SEGMENTS)
relation("supported", f"""
SELECT *, size > 20000 AS too_large FROM {{{{normalized}}}} WHERE size > 0 AND content <> ''
  AND {_iext} IN ({sql_list(ingest.SUPPORTED_EXTENSIONS)}, 'dockerfile') AND NOT ({_excluded})""")


@query("S05_filter_supported", "SELECT project_id, path, size, too_large FROM {{supported}}")
def supported(t):
    return ingest.filter_supported(messy(t), large_bytes=20000).select("project_id", "path", "size", "too_large")


_wexts = sql_list(ingest.WATCHED_EXTENSIONS)
@query("S05_discover", f"""
SELECT project_id, path, size, size > 4096 AS too_large FROM {{{{corpus}}}}
WHERE ({EXT} IN ({_wexts}) OR lower(split_part(path, '/', -1)) IN ({sql_list(ingest.WATCHED_NAMES)}))""")
def discover(t):
    return ingest.discover(corpus(t), large_kilobytes=4).select("project_id", "path", "size", "too_large")


@query("S06_exclude_globs", """
SELECT project_id, path FROM {{corpus}}
WHERE NOT regexp_matches(path, '^(?:.*/)?scripts/.*$') AND NOT regexp_matches(path, '^[^/]*\\.html$')
  AND NOT regexp_matches(path, '^src1?/.*/[^/]*\\.(?:ts|js)$')
  AND NOT regexp_matches(path, '/components(?:/|$)') AND NOT regexp_matches(path, '^.*\\.java$')""")
def exclude(t):
    globs = ["**/scripts/**", "*.html", "src1/**/*.{ts,js}", "src/**/*.{ts,js}"]
    return ingest.exclude_globs(corpus(t), globs, ["components", "*.java"]).select("project_id", "path")


def _copies(t):
    """Every file up to three times, copies in a fixed order."""
    c = corpus(t).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("file_id") % 3)))
    return c.withColumn("content", F.concat("content", F.lit(" copy "), F.col("copy").cast("string")))


@query("S07_dedupe_paths", "SELECT project_id, path, 0::BIGINT AS copy, md5(content || ' copy 0') AS digest FROM {{corpus}}")
def dedupe_paths(t):
    kept = ingest.dedupe_paths(_copies(t), [F.col("copy")])
    return kept.select("project_id", "path", "copy", F.md5("content").alias("digest"))


@query("S08_corpus_budget", """
SELECT project_id, path, size, CASE WHEN fits THEN position END AS position, CASE WHEN fits THEN running_bytes END AS running_bytes,
  fits AS within_budget
FROM (SELECT *, position <= 40 AND running_bytes <= 60000 AS fits FROM (SELECT *, (sum(size) OVER w)::BIGINT AS running_bytes, row_number() OVER w AS position FROM {{corpus}}
  WINDOW w AS (PARTITION BY project_id ORDER BY length(path), path ROWS UNBOUNDED PRECEDING)))""")
def budget(t):
    kept = ingest.corpus_budget(corpus(t), max_files=40, max_bytes=60000)
    return kept.select("project_id", "path", "size", "position", "running_bytes", "within_budget")


_tools = (
    f"coalesce(CASE split_part(path, '/', -1) WHEN 'Dockerfile' THEN ['checkov', 'semgrep'] END, CASE {EXT} "
    + " ".join(f"WHEN {sql_text(e)} THEN [{sql_list(v)}]" for e, v in ingest.TOOLS.items())
    + " END)"
)


@query("S15_tool_routing", f"SELECT project_id, path, unnest({_tools}) AS tool FROM {{{{corpus}}}}")
def routing(t):
    return ingest.tool_routing(corpus(t))


@query("P13_file_context_kind", f"SELECT path, {WEB_CONTEXT} AS web_context, {DAEMON_CONTEXT} AS daemon_context FROM {{{{corpus}}}}")
def contexts(t):
    return corpus(t).select(
        "path", paths.web_context(F.col("path")).alias("web_context"),
        paths.daemon_context(F.col("path")).alias("daemon_context"),
    )


relation("line_counts", r"""
SELECT project_id, path, len(string_split(content, chr(10))) AS raw_lines,
       len(list_filter(string_split_regex(content, '\r?\n'), lambda x: regexp_matches(x, '\S'))) AS code_lines
FROM {{corpus}}""")


@query("P19_line_counts", "SELECT * FROM {{line_counts}}")
def line_counts(t):
    return corpus(t).select(
        "project_id", "path", text.raw_lines(F.col("content")).alias("raw_lines"),
        text.meaningful_lines(F.col("content")).alias("code_lines"),
    )


# ------------------------------------------------------------------ scalar functions
@query("M03_impact_for_severity", """
SELECT issue_id, CASE severity WHEN 'BLOCKER' THEN 100 WHEN 'CRITICAL' THEN 90 WHEN 'MAJOR' THEN 60
  WHEN 'MINOR' THEN 40 ELSE 20 END AS impact_value FROM {{issues}}""")
def impact(t):
    from lintlake.schema import IMPACT

    return issues(t).select("issue_id", lookup(IMPACT, F.col("severity")).alias("impact_value"))


@query("M04_severity_names", f"""
SELECT issue_id, {sql_case('severity', OLD_SEVERITY)} AS old_severity, {sql_case('severity', SARIF_LEVEL)} AS sarif_level
FROM {{{{issues}}}}""")
def severity_names(t):
    return issues(t).select(
        "issue_id", lookup(OLD_SEVERITY, F.col("severity")).alias("old_severity"),
        lookup(SARIF_LEVEL, F.col("severity")).alias("sarif_level"),
    )


@query("M05_debt_label", """
SELECT project_id, minutes, CASE WHEN minutes < 60 THEN minutes || 'm'
  WHEN minutes < 480 THEN floor(minutes / 60 + 0.5)::BIGINT || 'h' ELSE floor(minutes / 480 + 0.5)::BIGINT || 'd' END AS label
FROM (SELECT project_id, file_path, sum(confidence)::BIGINT AS minutes FROM {{issues}} GROUP BY 1, 2)""")
def debt_label(t):
    sums = issues(t).groupBy("project_id", "file_path").agg(F.sum("confidence").alias("minutes"))
    return sums.select("project_id", "minutes", text.debt_label(F.col("minutes")).alias("label"))


@query("M07_badge", """
SELECT issue_id, CASE WHEN score IS NULL THEN 'N/A' ELSE floor(score + 0.5)::BIGINT || '/100' END AS label,
  CASE WHEN score IS NULL THEN '#9e9e9e' WHEN floor(score + 0.5) >= 80 THEN '#4caf50'
       WHEN floor(score + 0.5) >= 60 THEN '#ff9800' ELSE '#f44336' END AS colour
FROM (SELECT issue_id, CASE WHEN event_id % 9 > 0 THEN impact - 0.5 END AS score FROM {{issues}} WHERE impact <= 100)""")
def badge(t):
    score = F.when(F.col("event_id") % 9 > 0, F.col("impact") - 0.5)
    scored = issues(t).where("impact <= 100").select("issue_id", score.alias("score"))
    return scored.select("issue_id", text.badge_text(F.col("score")).alias("label"),
                         text.badge_colour(F.col("score")).alias("colour"))


@query("M08_content_hash16", """
SELECT path, sha256(content)[1:16] AS hash16, path || ':' || sha256(content)[1:16] || ':v1' AS cache_key FROM {{corpus}}""")
def content_hash(t):
    return corpus(t).select("path", text.content_hash16(F.col("content")).alias("hash16"),
                            text.cache_key(F.col("path"), F.col("content"), "v1").alias("cache_key"))


@query("M09_base_rule_id", r"""
SELECT issue_id, regexp_replace(issue_id, '-\d+$', '') AS rule
  FROM {{issues}}""")
def base_rule(t):
    return issues(t).select("issue_id", text.base_rule_id(F.col("issue_id")).alias("rule"))


@query("M13_issue_source", """
SELECT issue_id, CASE WHEN regexp_matches(issue_id, '^(semgrep|biome|ruff|tflint|checkov)-') THEN 'external' ELSE 'static' END AS source
FROM {{issues}}""")
def issue_source(t):
    return issues(t).select("issue_id", text.issue_source(F.col("issue_id")).alias("source"))


@query("M10_path_parts", rf"""
SELECT path, split_part(path, '/', -1) AS base, {EXT} AS ext, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir,
  regexp_extract(path, '^(?:.*/)?([^/]+/)[^/]*$', 1) || 'up/../x/./' || split_part(path, '/', -1) AS odd,
  regexp_extract(path, '^(?:.*/)?([^/]+/)[^/]*$', 1) || 'x/' || split_part(path, '/', -1) AS resolved
FROM {{{{corpus}}}}""")
def path_parts(t):
    parent = F.regexp_extract("path", r"^(?:.*/)?([^/]+/)[^/]*$", 1)
    rows = corpus(t).select(
        "path", paths.basename(F.col("path")).alias("base"), paths.dot_extension(F.col("path")).alias("ext"),
        paths.dirname(F.col("path")).alias("dir"),
        F.concat(parent, F.lit("up/../x/./"), paths.basename(F.col("path"))).alias("odd"),
    )
    return rows.withColumn("resolved", paths.collapse_dots(F.col("odd")))


@query("M11_extract_quoted", r"""
SELECT issue_id, q AS name, upper(q[1]) || q[2:] AS capitalized
FROM (SELECT issue_id, coalesce(nullif(regexp_extract(title, '[''"]([^''"]+)[''"]', 1), ''), 'targetFunction') AS q FROM {{issues}})""")
def quoted(t):
    name = text.extract_quoted(F.col("title"), "targetFunction")
    return issues(t).select("issue_id", name.alias("name"), text.capitalize(name).alias("capitalized"))


@query("M16_month_bounds", """
SELECT DISTINCT strftime(created_at, '%Y-%m-%d') AS day, strftime(date_trunc('month', created_at), '%Y-%m-%d') AS first_day,
  strftime(last_day(created_at::DATE), '%Y-%m-%d') AS last_day, strftime(created_at::DATE - INTERVAL 7 DAY, '%Y-%m-%d') AS cutoff
FROM {{issues}}""")
def month_bounds(t):
    day = F.to_date("created_at")
    first, last = dates.month_bounds(day)
    return issues(t).select(
        dates.iso(day).alias("day"), dates.iso(first).alias("first_day"), dates.iso(last).alias("last_day"),
        dates.iso(dates.cutoff(day, 7)).alias("cutoff"),
    ).distinct()

"""Bindings of the given tables to the domain tables, each with its SQL twin.

Every binding is a narrow plan over one given table (or an aggregate of such a plan), so its
size and cost grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.catalog.core import Tables, relation, sql_case, sql_list, sql_text
from lintlake.catalog.snippets import FILE_KINDS, FOLDERS
from lintlake.operators.metrics import project_metrics
from lintlake.plans.scan import spread
from lintlake.schema import CATEGORIES, SEVERITIES, constant, lookup

DOCUMENT_EXTS = ("ts", "js", "py", "md", "txt", "java", "html", "go")


def _pick(values, index: Column) -> Column:
    return F.element_at(constant(list(values), "array<string>"), index.cast("int") + 1)


def _sql_pick(values, index: str) -> str:
    return f"([{sql_list(values)}])[({index})::INT + 1]"


# ------------------------------------------------------------------ B1 documents as files
def files(t: Tables) -> DataFrame:
    ext = _pick(DOCUMENT_EXTS, F.col("doc_id") % 8)
    return spread(t.documents).select(
        F.col("source").alias("project_id"),
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("."), ext)).alias("path"),
        F.col("text").alias("content"),
        F.col("n_chars").alias("size"),
        F.col("doc_id").alias("file_id"),
    )


relation("files", f"""
SELECT source AS project_id,
       source || '/' || lang || '/' || doc_id || '.' || {_sql_pick(DOCUMENT_EXTS, 'doc_id % 8')} AS path,
       text AS content, n_chars AS size, doc_id AS file_id
FROM documents""")


# ------------------------------------------------------------------ B2 pages as files
def html_files(t: Tables) -> DataFrame:
    return spread(t.pages).select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("project_id"),
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("html").alias("content"),
        F.length("html").cast("long").alias("size"),
        F.col("page_id").alias("file_id"),
    )


relation("html_files", r"""
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS project_id, page_id || '.html' AS path,
       html AS content, length(html) AS size, page_id AS file_id
FROM pages""")


# ------------------------------------------------------------------ parts as source files
def _render(kind: int, key: Column) -> Column:
    _, blocks, count = FILE_KINDS[kind]
    pool = constant(list(blocks), "array<string>")
    word = lambda i: F.concat(
        F.element_at(F.split("p_name", " "), (i % 2 + 1).cast("int")), i.cast("string")
    )
    number = lambda i: ((F.col("p_size") * 37 + i * 101 + key) % 1000 + 3).cast("string")

    def block(i: Column) -> Column:
        text = F.element_at(pool, ((key * 3 + F.col("p_size") * 5 + i * 7) % len(blocks) + 1).cast("int"))
        for mark, value in (
            ("{w}", word(i)),
            ("{n}", number(i)),
            ("{p}", key.cast("string")),
            ("{next}", (key + 96).cast("string")),
        ):
            text = F.replace(text, F.lit(mark), value)
        return text

    return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")), block), "\n")


def code_files(t: Tables) -> DataFrame:
    """Every part as a source file. Its rows are few bytes, and a large file of them is one split: they are spread before they are rendered."""
    key = F.col("p_partkey")
    kind = key % len(FILE_KINDS)
    stem = F.concat(
        _pick(FOLDERS, F.floor(key / 16) % len(FOLDERS)), F.lit("/f"), key.cast("string")
    )
    ext = _pick([e for e, _, _ in FILE_KINDS], kind)
    content = None
    for k in range(len(FILE_KINDS)):
        content = F.when(kind == k, _render(k, key)) if content is None else content.when(kind == k, _render(k, key))
    return spread(t.part, 4).select(
        F.lower(F.translate("p_brand", "#", "-")).alias("project_id"),
        F.concat(F.lit("repo/"), stem, F.when(ext == "Dockerfile", "/").otherwise("."), ext).alias("path"),
        content.alias("content"),
        key.alias("file_id"),
    ).withColumn("size", F.length("content").cast("long"))


def _sql_render(kind: int) -> str:
    _, blocks, count = FILE_KINDS[kind]
    pool = "[" + ", ".join(sql_text(b) for b in blocks) + "]"
    text = f"({pool})[((p_partkey * 3 + p_size * 5 + i * 7) % {len(blocks)} + 1)::INT]"
    for mark, value in (
        ("{w}", "split_part(p_name, ' ', (i % 2 + 1)::INT) || i"),
        ("{n}", "((p_size * 37 + i * 101 + p_partkey) % 1000 + 3)::VARCHAR"),
        ("{p}", "p_partkey::VARCHAR"),
        ("{next}", "(p_partkey + 96)::VARCHAR"),
    ):
        text = f"replace({text}, '{mark}', {value})"
    return f"array_to_string(list_transform(range(0, {count}), lambda i: {text}), chr(10))"


_kinds = " ".join(f"WHEN {k} THEN {_sql_render(k)}" for k in range(len(FILE_KINDS)))
relation("code_files", f"""
SELECT project_id, 'repo/' || stem || CASE WHEN ext = 'Dockerfile' THEN '/' ELSE '.' END || ext AS path,
       content, length(content) AS size, file_id
FROM (SELECT lower(replace(p_brand, '#', '-')) AS project_id,
             {_sql_pick(FOLDERS, f'(p_partkey // 16) % {len(FOLDERS)}')} || '/f' || p_partkey AS stem,
             {_sql_pick([e for e, _, _ in FILE_KINDS], f'p_partkey % {len(FILE_KINDS)}')} AS ext,
             CASE p_partkey % {len(FILE_KINDS)} {_kinds} END AS content,
             p_partkey AS file_id
      FROM part)""")


def corpus(t: Tables) -> DataFrame:
    """All three file bindings: prose, web pages and source code."""
    return files(t).unionByName(html_files(t)).unionByName(code_files(t))


relation("corpus", """
SELECT project_id, path, content, size, file_id FROM {{files}}
UNION ALL SELECT project_id, path, content, size, file_id FROM {{html_files}}
UNION ALL SELECT project_id, path, content, size, file_id FROM {{code_files}}""")


# ------------------------------------------------------------------ B3 events as issues
# Rule ids and titles that the post-processing rules react to.
ISSUE_RULES = (
    "sql-delete-no-where", "cyclomatic", "style-console", "security-eval", "semgrep-xss",
    "biome-lint/style/useTemplate", "ruff-F401", "unused", "nesting", "biome-lint/suspicious/noDoubleEquals",
    "useExhaustiveDependencies", "noExplicitAny", "checkov-CKV_1",
)
ISSUE_TITLES = (
    "Unused variable", "Deep nesting in", "High cyclomatic complexity in", "Line exceeds maximum length",
    "Inline function in JSX prop", "Explicit any type", "Unused import", "Function too long:", "Use strict equality",
)
ISSUE_FOLDERS = ("src", "app/services", "db/migrations", "web/src/app", "lib")
ISSUE_EXTS = ("ts", "py", "sql")


def issues(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    eid, uid = F.col("event_id"), F.col("user_id")
    start = (k * 4).cast("int")
    quoted = F.concat(F.lit(" '"), F.lit("fn"), (uid % 5).cast("string"), F.lit("'"))
    return t.events.select(
        eid.alias("event_id"),
        F.concat(_pick(ISSUE_RULES, eid % len(ISSUE_RULES)), F.lit("-"), eid.cast("string")).alias("issue_id"),
        (uid % 40).alias("project_id"),
        F.concat((uid % 40).cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("scan_id"),
        F.concat(
            F.lit("repo/"), _pick(ISSUE_FOLDERS, uid % 5), F.lit("/f"), uid.cast("string"), F.lit("."),
            _pick(ISSUE_EXTS, uid % 3),
        ).alias("file_path"),
        start.alias("line_start"),
        (k % 10).cast("int").alias("col_start"),
        (start + eid % 4).cast("int").alias("line_end"),
        (k % 10 + 5).cast("int").alias("col_end"),
        F.concat(_pick(ISSUE_TITLES, eid % len(ISSUE_TITLES)), quoted).alias("title"),
        F.concat(F.lit("Value is "), k.cast("string"), F.lit(" (threshold: "), (eid % 50).cast("string"),
                 F.lit(").")).alias("description"),
        _pick(CATEGORIES, eid % 7).alias("category"),
        lookup({"error": "BLOCKER", "purchase": "CRITICAL", "signup": "MAJOR", "click": "MINOR", "view": "INFO"},
               F.col("event_type"), "INFO").alias("severity"),
        (50 + eid % 51).cast("int").alias("confidence"),
        (eid % 101).cast("int").alias("impact"),
        F.concat(F.lit("code "), F.col("event_type")).alias("code_snippet"),
        F.col("ts").alias("created_at"),
    )


relation("issues", f"""
SELECT event_id, {_sql_pick(ISSUE_RULES, f'event_id % {len(ISSUE_RULES)}')} || '-' || event_id AS issue_id,
       user_id % 40 AS project_id, (user_id % 40) || '-' || strftime(ts, '%Y-%m-%d') AS scan_id,
       'repo/' || {_sql_pick(ISSUE_FOLDERS, 'user_id % 5')} || '/f' || user_id || '.' ||
         {_sql_pick(ISSUE_EXTS, 'user_id % 3')} AS file_path,
       k * 4 AS line_start, k % 10 AS col_start, (k * 4 + event_id % 4)::INT AS line_end,
       k % 10 + 5 AS col_end,
       {_sql_pick(ISSUE_TITLES, f'event_id % {len(ISSUE_TITLES)}')} || ' ''fn' || (user_id % 5) || '''' AS title,
       'Value is ' || k || ' (threshold: ' || (event_id % 50) || ').' AS description,
       {_sql_pick(CATEGORIES, 'event_id % 7')} AS category,
       {sql_case('event_type', {'error': 'BLOCKER', 'purchase': 'CRITICAL', 'signup': 'MAJOR', 'click': 'MINOR',
                                'view': 'INFO'}, "'INFO'")} AS severity,
       (50 + event_id % 51)::INT AS confidence, (event_id % 101)::INT AS impact,
       'code ' || event_type AS code_snippet, ts AS created_at
FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)""")


# ------------------------------------------------------------------ B4 scans and snapshots
def scans(t: Tables) -> DataFrame:
    """One scan per project and day, with counts, scores and debt."""
    i = issues(t)
    keys = ("project_id", "scan_id")
    seen = i.groupBy(*keys).agg(
        F.max("created_at").alias("scanned_at"), F.countDistinct("file_path").alias("files_analyzed")
    )
    return project_metrics(i, seen, keys).withColumnRenamed("score_totals", "overall_score")


_counts = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in SEVERITIES)
_cats = ", ".join(f"count(*) FILTER (category = '{c}') AS {c.replace('-', '_')}" for c in CATEGORIES)
_ceil = " - ".join(
    f"ceil({s.lower()} / files_analyzed::DOUBLE) * {w}"
    for s, w in (("BLOCKER", 15), ("CRITICAL", 10), ("MAJOR", 5), ("MINOR", 2), ("INFO", 0.5))
)
relation("scans", f"""
SELECT *, greatest(0, least(100, floor(100 - {_ceil} + 0.5)))::BIGINT AS overall_score,
       blocker * 120 + critical * 60 + major * 30 + minor * 10 + info * 5 AS tech_debt_minutes
FROM (SELECT project_id, scan_id, max(created_at) AS scanned_at, count(DISTINCT file_path) AS files_analyzed,
             count(*) AS total_issues, {_counts}, {_cats}
      FROM {{{{issues}}}} GROUP BY 1, 2)""")


# ------------------------------------------------------------------ projects, jobs, usage
def projects(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    return t.customer.select(
        key.alias("project_id"),
        F.col("c_name").alias("name"),
        F.concat(F.initcap("c_mktsegment"), (key % 7).cast("string"), F.lit("@Example.com")).alias("user_email"),
        F.concat(F.lower("c_mktsegment"), F.lit("/repo"), (key % 50).cast("string")).alias("repo_full_name"),
        F.when(key % 2 == 0, "github").otherwise("upload").alias("source"),
        F.col("c_acctbal").alias("balance"),
    )


relation("projects", """
SELECT c_custkey AS project_id, c_name AS name,
       upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || (c_custkey % 7) || '@Example.com' AS user_email,
       lower(c_mktsegment) || '/repo' || (c_custkey % 50) AS repo_full_name,
       CASE WHEN c_custkey % 2 = 0 THEN 'github' ELSE 'upload' END AS source, c_acctbal AS balance
FROM customer""")

MODELS = (
    "gpt-4o", "gpt-4o-mini", "gpt-4-turbo", "gpt-4", "claude-3-5-sonnet", "claude-3-haiku", "claude-3-opus",
    "gemini-1.5-pro", "gemini-1.5-flash", "unknown-model",
)


def ai_usage(t: Tables) -> DataFrame:
    prompt = F.floor("o_totalprice").cast("int")
    return t.orders.select(
        F.col("o_orderkey").alias("call_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("provider"),
        _pick(MODELS, F.col("o_orderkey") % len(MODELS)).alias("model"),
        prompt.alias("prompt_tokens"),
        F.floor(prompt / 4).cast("int").alias("completion_tokens"),
        (F.col("o_orderstatus") != "F").alias("success"),
        F.col("o_orderdate").alias("created_at"),
    )


relation("ai_usage", f"""
SELECT o_orderkey AS call_id, o_custkey AS user_id, o_orderpriority AS provider,
       {_sql_pick(MODELS, f'o_orderkey % {len(MODELS)}')} AS model,
       floor(o_totalprice)::INT AS prompt_tokens, floor(o_totalprice)::INT // 4 AS completion_tokens,
       o_orderstatus <> 'F' AS success, o_orderdate AS created_at
FROM orders""")


def issues_large(t: Tables) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    severity = (
        F.when((flag == "A") & (status == "F"), "BLOCKER")
        .when(flag == "A", "CRITICAL")
        .when((flag == "R") & (status == "F"), "MAJOR")
        .when(flag == "R", "MINOR")
        .otherwise("INFO")
    )
    return t.lineitem.select(
        F.col("l_suppkey").alias("project_id"),
        F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file_path"),
        F.col("l_linenumber").alias("line_start"),
        severity.alias("severity"),
        _pick(CATEGORIES, F.col("l_orderkey") % 7).alias("category"),
        F.col("l_orderkey").alias("issue_id"),
        F.col("l_shipdate").alias("created_at"),
    )


relation("issues_large", f"""
SELECT l_suppkey AS project_id, 'f' || l_partkey AS file_path, l_linenumber AS line_start,
       CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'BLOCKER' WHEN l_returnflag = 'A' THEN 'CRITICAL'
            WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'MAJOR' WHEN l_returnflag = 'R' THEN 'MINOR'
            ELSE 'INFO' END AS severity,
       {_sql_pick(CATEGORIES, 'l_orderkey % 7')} AS category, l_orderkey AS issue_id, l_shipdate AS created_at
FROM lineitem""")

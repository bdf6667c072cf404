"""Queries of the rules that need blocks, token sets or whole-file counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.catalog.bindings import corpus
from lintlake.catalog.core import query, relation, sql_list, sql_text
from lintlake.catalog.rule_sql import (
    DAEMON_CONTEXT, LANGUAGE, _prefix_col, _prefix_line, family_sql, located_hits, match_rule_sql, matches, pattern_text,
)
from lintlake.catalog.rules import show
from lintlake.functions.paths import language_of
from lintlake.rules import spans, structural, symbols
from lintlake.rules.lines import FAMILY_EXTENSIONS, family_of
from lintlake.rules.spec import REACT, WEB_JS, MatchRule

S = spans
_net = "regexp_replace(line, '[^{}]', '', 'g')"
# Depth after the first i braces of a line; the lowest one, 0 included, is what closes blocks of earlier lines.
_low = "list_min([2 * length(replace(left(net, i), '}', '')) - i FOR i IN range(0, length(net) + 1)])"

relation("script_lines", f"""
SELECT *, before - closes AS base
FROM (SELECT *, (sum(opens - closes) OVER (PARTITION BY project_id, path ORDER BY line_no))::BIGINT
                - (opens - closes) AS before
      FROM (SELECT *, -low AS closes, 2 * length(replace(net, '}}', '')) - length(net) - low AS opens
            FROM (SELECT *, {_low} AS low FROM (SELECT *, {_net} AS net
                  FROM (SELECT project_id, path, ext, i - 1 AS line_no, lines[i] AS line, len(lines) AS n
                        FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i
                              FROM (SELECT project_id, path, ext, string_split(code, chr(10)) AS lines
                                    FROM {{{{script_code}}}})))))))""")

_fname = (
    f"coalesce(nullif(regexp_extract(line, {pattern_text(S.FUNCTION)}, 1), ''), "
    f"regexp_extract(line, {pattern_text(S.FUNCTION)}, 2))"
)
_is_function = matches("line", S.FUNCTION)
_kinds = (
    ("function", _is_function, _fname),
    ("method", f"NOT {_is_function} AND {matches('line', S.METHOD)} AND NOT {matches('line', S.NOT_METHOD)}",
     f"regexp_extract(line, {pattern_text(S.METHOD)}, 1)"),
    ("loop", f"{matches('line', S.LOOP)} AND NOT {matches('line', S.LOOP_TAIL)}", "''"),
    ("if", matches("line", S.IF), "''"),
    ("switch", matches("line", S.SWITCH), "''"),
    ("try", matches("line", S.TRY), "''"),
    ("catch", matches("line", S.CATCH), "''"),
    ("effect", matches("line", S.EFFECT), "''"),
    ("class", matches("line", S.CLASS), f"regexp_extract(line, {pattern_text(S.CLASS)}, 1)"),
    ("interface", matches("line", S.INTERFACE), f"regexp_extract(line, {pattern_text(S.INTERFACE)}, 1)"),
    ("enum", matches("line", S.ENUM), f"regexp_extract(line, {pattern_text(S.ENUM)}, 1)"),
)
_starts = "\nUNION ALL ".join(
    f"SELECT *, '{k}' AS kind, {name} AS name FROM {{{{script_lines}}}} WHERE {test}" for k, test, name in _kinds
)
relation("block_starts", f"SELECT *, row_number() OVER () AS bid FROM ({_starts})")
relation("blocks", rf"""
SELECT s.project_id, s.path, s.ext, s.kind, s.name, s.line_no AS line_start, s.base AS depth, s.line,
       CASE WHEN s.opens > 0 THEN coalesce(min(l.line_no), any_value(s.n) - 1)
            WHEN s.kind IN ('loop', 'if') AND NOT contains(s.line, '{{') THEN least(s.line_no + 1, any_value(s.n) - 1)
            ELSE s.line_no END AS line_end,
       regexp_matches(s.line, '\basync\b') AS is_async, regexp_matches(s.line, '^\s*export\b') AS exported,
       CASE WHEN trim(regexp_extract(s.line, '\(([^()]*)\)', 1)) = '' THEN 0
            ELSE len(string_split(regexp_extract(s.line, '\(([^()]*)\)', 1), ',')) END AS params
FROM {{{{block_starts}}}} s LEFT JOIN {{{{script_lines}}}} l
  ON l.project_id = s.project_id AND l.path = s.path AND l.line_no > s.line_no AND l.base <= s.base
GROUP BY s.bid, s.project_id, s.path, s.ext, s.kind, s.name, s.line_no, s.base, s.line, s.opens""")
relation("loops", "SELECT * FROM {{blocks}} WHERE kind = 'loop'")


@query("W08_function_spans", """
SELECT project_id, path, kind, name, line_start, line_end, depth, is_async, exported, params
FROM {{blocks}} WHERE kind IN ('function', 'method')""")
def function_spans(t):
    return spans.function_spans(corpus(t))


@query("R18_long_func", f"""
SELECT project_id, path AS file_path, line_start, 0 AS col_start,
       'Function ''' || name || ''' is ' || (line_end - line_start) || ' lines long' AS title,
       'long-func' AS rule_id, CASE WHEN line_end - line_start > 100 THEN 'CRITICAL' ELSE 'MAJOR' END AS severity,
       85 AS confidence, CASE WHEN line_end - line_start > 100 THEN 75 ELSE 50 END AS impact
FROM {{{{blocks}}}} WHERE kind = 'function' AND line_end - line_start > 50
  AND ext IN ({sql_list('.' + e for e in WEB_JS)})""")
def long_func(t):
    return show(structural.long_function_issues(corpus(t)))


_count = lambda p: f"len(regexp_extract_all(line, {sql_text(p)}))"
relation("function_metrics", f"""
WITH tokens AS (
  SELECT project_id, path, line_no, {_count(S.BRANCHES)} AS branches,
         {_count(S.CONTROL)} - {_count(S.NULLISH)} AS controls, {_count(S.LOGICAL)} AS logical
  FROM {{{{script_lines}}}}),
busy AS (SELECT * FROM tokens WHERE branches + controls + logical > 0),
depths AS (
  SELECT b.project_id, b.path, b.line_no, any_value(b.branches) AS branches, any_value(b.controls) AS controls,
         any_value(b.logical) AS logical, count(n.line_start) AS d
  FROM busy b LEFT JOIN {{{{blocks}}}} n ON n.project_id = b.project_id AND n.path = b.path
    AND n.kind IN ('if', 'loop', 'switch', 'catch') AND n.line_start < b.line_no AND b.line_no <= n.line_end
  GROUP BY 1, 2, 3),
funcs AS (SELECT *, row_number() OVER () AS fid FROM {{{{blocks}}}} WHERE kind IN ('function', 'method')),
around AS (
  SELECT f.fid, count(*) FILTER (n.kind IN ('if', 'loop', 'switch', 'catch')) AS nest,
         count(*) FILTER (n.kind IN ('if', 'loop', 'switch', 'try')) AS deep
  FROM funcs f LEFT JOIN {{{{blocks}}}} n ON n.project_id = f.project_id AND n.path = f.path
    AND n.line_start < f.line_start AND f.line_start <= n.line_end GROUP BY 1),
levels AS (
  SELECT d.project_id, d.path, d.line_start, 1 + count(n.line_start) AS level
  FROM (SELECT DISTINCT project_id, path, line_start FROM {{{{blocks}}}} WHERE kind IN ('if', 'loop', 'switch', 'try')) d
  LEFT JOIN {{{{blocks}}}} n ON n.project_id = d.project_id AND n.path = d.path
    AND n.kind IN ('if', 'loop', 'switch', 'try') AND n.line_start < d.line_start AND d.line_start <= n.line_end
  GROUP BY 1, 2, 3),
sums AS (
  SELECT f.fid, (1 + coalesce(sum(d.branches), 0))::BIGINT AS cyclomatic,
         coalesce(sum(d.controls * (1 + greatest(0, d.d - a.nest)) + d.logical), 0)::BIGINT AS cognitive
  FROM funcs f JOIN around a USING (fid) LEFT JOIN depths d ON d.project_id = f.project_id AND d.path = f.path
    AND d.line_no BETWEEN f.line_start AND f.line_end GROUP BY 1),
nestings AS (
  SELECT f.fid, coalesce(max(l.level) - any_value(a.deep), 0) AS nesting
  FROM funcs f JOIN around a USING (fid) LEFT JOIN levels l ON l.project_id = f.project_id AND l.path = f.path
    AND l.line_start BETWEEN f.line_start AND f.line_end GROUP BY 1)
SELECT f.project_id, f.path, f.kind, f.name, f.line_start, f.line_end, f.params, f.line_end - f.line_start AS length,
       s.cyclomatic, s.cognitive, n.nesting
FROM funcs f JOIN sums s USING (fid) JOIN nestings n USING (fid)""")


@query("J12_function_metrics", "SELECT * FROM {{function_metrics}}")
def function_metrics(t):
    return spans.function_metrics(corpus(t))


def _complexity(key, rule_id, test, title, severity, confidence, impact):
    @query(key, f"""
SELECT project_id, path AS file_path, line_start, 0 AS col_start, {title} AS title, '{rule_id}' AS rule_id,
       {severity} AS severity, {confidence} AS confidence, {impact} AS impact
FROM {{{{function_metrics}}}} WHERE {test}""")
    def run(t):
        return show(structural.script_issues(corpus(t), ["complexity"], complexity=[rule_id]))


_complexity("R45_cyclomatic", "cyclomatic", "cyclomatic > 10",
            "'High cyclomatic complexity in ''' || name || ''''",
            "CASE WHEN cyclomatic > 20 THEN 'CRITICAL' ELSE 'MAJOR' END", 95,
            "CASE WHEN cyclomatic > 20 THEN 90 ELSE 60 END")
_complexity("R46_cognitive", "cognitive", "cognitive > 15", "'High cognitive complexity in ''' || name || ''''",
            "'MAJOR'", 90, 60)
_complexity("R47_nesting", "nesting", "nesting > 4", "'Deep nesting in ''' || name || ''''", "'MAJOR'", 90, 60)
_complexity("R48_params", "params", "params > 5", "'Too many parameters in ''' || name || ''''", "'INFO'", 85, 20)
_complexity("R49_func_length", "func-length", "length > 50", "'Function ''' || name || ''' is too long'",
            "'MAJOR'", 90, 60)


# ------------------------------------------------------------------ loops
def _loop_sql(rule_id, title, confidence, pattern, group):
    name = f"regexp_extract(hit, {sql_text(pattern)}, {group})" if group else "''"
    return f"""
SELECT project_id, path AS file_path, line AS line_start, col AS col_start,
       replace({sql_text(title)}, '{{name}}', name) AS title, '{rule_id}' AS rule_id, 'INFO' AS severity,
       {confidence} AS confidence, 20 AS impact
FROM (SELECT project_id, path, {name} AS name, {_prefix_line('off', 'code')} AS line, {_prefix_col('off')} AS col
      FROM ({located_hits('{{script_code}}', 'code', pattern)})) m
WHERE EXISTS (SELECT 1 FROM {{{{loops}}}} l WHERE l.project_id = m.project_id AND l.path = m.path
              AND m.line BETWEEN l.line_start AND l.line_end)"""


for _key, _rule in zip(("R64", "R65", "R67"), structural.LOOP_PATTERNS):
    def _register(key=_key, rule=_rule):
        @query(f"{key}_{rule[0].replace('-', '_')}", _loop_sql(*rule))
        def run(t):
            return show(structural.script_issues(corpus(t), ["loops"]).where(F.col("rule_id") == rule[0]))

    _register()


@query("R63_perf_nested_loop", r"""
SELECT o.project_id, o.path AS file_path, o.line_start,
       length(regexp_split_to_array(o.line, '\b(?:for|while|do)\b')[1]) AS col_start, 'Nested loop detected' AS title,
       'perf-nested-loop' AS rule_id, 'INFO' AS severity, 70 AS confidence, 20 AS impact
FROM {{loops}} o WHERE EXISTS (SELECT 1 FROM {{loops}} i WHERE i.project_id = o.project_id AND i.path = o.path
  AND i.line_start > o.line_start AND i.line_start <= o.line_end)""")
def nested_loop(t):
    return show(structural.script_issues(corpus(t), ["nested-loops"]))


_taken = structural.TAKEN
@query("R68_async_missing_await", f"""
SELECT project_id, path AS file_path, line AS line_start,
       col + length(regexp_extract(hit, '^[^\\w$]')) AS col_start,
       'Possibly missing await on ''' || name || '''' AS title, 'async-missing-await' AS rule_id, 'MAJOR' AS severity,
       CASE WHEN {matches('name', structural.SURE_ASYNC)} THEN 85 ELSE 65 END AS confidence, 60 AS impact
FROM (SELECT project_id, path, hit, name, line, col,
             (SELECT max_by(f.is_async, f.line_start) FROM {{{{blocks}}}} f WHERE f.kind IN ('function', 'method')
                AND f.project_id = m.project_id AND f.path = m.path
                AND m.line BETWEEN f.line_start AND f.line_end) AS waits
      FROM (SELECT *, regexp_extract(hit, {pattern_text(structural.ASYNC_CALL)}, 1) AS name,
                   {_prefix_line('off', 'code')} AS line, {_prefix_col('off')} AS col
            FROM ({located_hits('{{script_code}}', 'code', structural.ASYNC_CALL)})) m
      WHERE NOT {matches('name', structural.SYNC_GUARD)}
        AND lower(name) NOT IN ({sql_list(n.lower() for n in structural.SYNC_NAMES)})
        AND NOT {matches("regexp_replace(left(code, off + length(hit)), '[[:word:]$]+[[:space:]]*[(]$', '')", _taken)})
WHERE waits""")
def missing_await(t):
    return show(structural.script_issues(corpus(t), ["missing-await"]))


@query("R73_react_useeffect_deps", rf"""
SELECT b.project_id, b.path AS file_path, b.line_start, 0 AS col_start, 'useEffect missing dependency array' AS title,
       'react-useeffect-deps' AS rule_id, 'MAJOR' AS severity, 90 AS confidence, 60 AS impact
FROM {{{{blocks}}}} b JOIN {{{{script_lines}}}} l ON l.project_id = b.project_id AND l.path = b.path
  AND l.line_no = b.line_end
WHERE b.kind = 'effect' AND b.ext IN ({sql_list('.' + e for e in REACT)})
  AND CASE WHEN b.line_end > b.line_start THEN regexp_matches(l.line, '^\s*\}}\s*\)')
           ELSE regexp_matches(l.line, '\}}\s*\)') AND NOT regexp_matches(l.line, ',\s*\[') END""")
def effect_deps(t):
    return show(structural.script_issues(corpus(t), ["effects"]))


# In the given files elements stand right behind the arrow.
KEYLESS = MatchRule(
    id="react-missing-key", title="Missing key prop in list rendering", description="", category="bug", severity="MAJOR", confidence=80,
    engine="lexical", exts=REACT, text="code", hit_lacks=structural.KEY,
    pattern=r"\.map\s*\(\s*(?:\([^()]*\)|[\w$]+)\s*=>\s*\(?\s*<[A-Za-z][^>]*>",
)


@query("R72_react_missing_key", match_rule_sql(KEYLESS))
def missing_key(t):
    return show(structural.script_issues(corpus(t), ["missing-keys"]))


_hook = structural.HOOK_CALL
@query("R77_react_conditional_hook", f"""
SELECT project_id, path AS file_path, line AS line_start, col AS col_start,
       'Conditional hook call: ' || name AS title, 'react-conditional-hook' AS rule_id, 'CRITICAL' AS severity,
       95 AS confidence, 90 AS impact
FROM (SELECT project_id, path, regexp_extract(hit, {sql_text(_hook)}, 1) AS name,
             {_prefix_line('off', 'code')} AS line, {_prefix_col('off')} AS col
      FROM ({located_hits('{{script_code}}', 'code', _hook, f"ext IN ({sql_list('.' + e for e in REACT)})")})) m
WHERE EXISTS (SELECT 1 FROM {{{{blocks}}}} l WHERE l.kind = 'if' AND l.project_id = m.project_id AND l.path = m.path
              AND m.line BETWEEN l.line_start AND l.line_end)""")
def conditional_hook(t):
    return show(structural.script_issues(corpus(t), ["conditional-hooks"]))


# ------------------------------------------------------------------ unused names
_ident = pattern_text(S.IDENT)
_decl = pattern_text(structural.DECLARED)
@query("R50_unused", f"""
WITH d AS (
  SELECT *, regexp_extract(hit, {_decl}, 1) AS name FROM ({located_hits('{{script_code}}', 'code', structural.DECLARED)})),
firsts AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY project_id, path, name ORDER BY i) = 1)
SELECT project_id, path AS file_path, {_prefix_line('off + length(hit)', 'code')} AS line_start,
       {_prefix_col('off + length(hit) - length(name)')} AS col_start, 'Unused variable ''' || name || '''' AS title,
       'unused' AS rule_id, 'MAJOR' AS severity, 85 AS confidence, 60 AS impact
FROM firsts WHERE NOT starts_with(name, '_')
  AND NOT list_contains(regexp_extract_all(regexp_replace(code, {_decl}, ' ', 'g'), {_ident}), name)
  AND NOT list_contains(regexp_extract_all(code, {pattern_text(structural.EXPORTED)}, 1), name)""")
def unused(t):
    return show(structural.script_issues(corpus(t), ["unused"]))


_import = pattern_text(structural.IMPORT)
@query("R52_unused_import", f"""
WITH m AS (
  SELECT *, regexp_extract(hit, {_import}, 1) AS clause FROM ({located_hits('{{script_code}}', 'code', structural.IMPORT)})),
n AS (SELECT *, unnest(list_distinct(list_transform(string_split(regexp_replace(clause, '[{{}}*]', ',', 'g'), ','),
        lambda p: regexp_extract(p, '([A-Za-z_$][\\w$]*)\\s*$', 1)))) AS name FROM m)
SELECT project_id, path AS file_path, {_prefix_line('off', 'code')} AS line_start, 0 AS col_start,
       'Unused import ''' || name || '''' AS title, 'unused-import' AS rule_id, 'INFO' AS severity, 80 AS confidence,
       20 AS impact
FROM n WHERE name <> ''
  AND NOT list_contains(regexp_extract_all(regexp_replace(code, {_import}, ' ', 'g'), {_ident}), name)""")
def unused_import(t):
    return show(structural.script_issues(corpus(t), ["unused-imports"]))


# ------------------------------------------------------------------ numbers
_bare = "replace(name, '_', '')"
_v = f"(CASE WHEN regexp_matches(name, '^0[xXbB]') THEN try_cast(lower({_bare}) AS BIGINT)::DOUBLE ELSE try_cast({_bare} AS DOUBLE) END)"
_line_at = lambda pos: (f"split_part(left(code, {pos}), chr(10), -1) || "
                        f"split_part(substring(code, {pos} + 1), chr(10), 1)")
@query("R79_style_magic_number", f"""
SELECT project_id, path AS file_path, {_prefix_line('pos', 'code')} AS line_start, {_prefix_col('pos')} AS col_start,
       'Magic number detected' AS title, 'style-magic-number' AS rule_id, 'INFO' AS severity, 50 AS confidence,
       20 AS impact
FROM (SELECT *, off + length(hit) - length(name) AS pos
      FROM (SELECT *, regexp_extract(hit, {pattern_text(structural.NUMBER)}, 1) AS name
            FROM ({located_hits('{{script_code}}', 'code', structural.NUMBER, f"{DAEMON_CONTEXT} <> 'test'")})))
WHERE {_v} > 50 AND {_v} NOT IN ({', '.join(str(float(n)) for n in structural.PLAIN_NUMBERS)})
  AND NOT ({_v} >= 100 AND {_v} < 1000 AND {_v} % 100 = 0) AND NOT ({_v} >= 1000 AND {_v} < 10000 AND {_v} % 1000 = 0)
  AND NOT ({_v} <= 100 AND {_v} = floor({_v}))
  AND NOT {matches(_line_at('pos'), structural.NAMED_CONTEXT)}""")
def magic_number(t):
    return show(structural.script_issues(corpus(t), ["magic-numbers"]))


relation("literals", f"""
SELECT project_id, path, line_no, line, value FROM (
  SELECT *, unnest(list_filter(list_transform(toks, lambda x, i:
    CASE WHEN regexp_matches(x, '^\\d+\\.\\d+$') THEN x
         WHEN regexp_matches(x, '^\\d{{3,}}$') THEN
           CASE WHEN i > 1 AND toks[i - 1] = '-' AND (i = 2 OR NOT regexp_matches(toks[i - 2], '^[\\w.]+$'))
                THEN '-' || x ELSE x END END), lambda v: v IS NOT NULL AND v <> '100')) AS value
  FROM (SELECT *, regexp_extract_all(line, '[^\\w.]|[\\w.]+') AS toks
        FROM (SELECT *, i - 1 AS line_no, lines[i] AS line
              FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i
                    FROM (SELECT project_id, path, string_split(content, chr(10)) AS lines FROM {{{{corpus}}}}
                          WHERE {LANGUAGE} IN ({sql_list(structural.REPEATED_LANGUAGES)})))
              WHERE NOT {matches('lines[i]', structural.DECLARATION_LINE)}
                AND NOT {matches('lines[i]', structural.CONFIG_LINE)})))""")


@query("R17_smell_magic_number", """
SELECT DISTINCT project_id, path AS file_path, line_no AS line_start, 0 AS col_start, 'Magic number in code' AS title,
       'smell-magic-number' AS rule_id, 'INFO' AS severity, 55 AS confidence, 20 AS impact
FROM (SELECT *, count(*) OVER (PARTITION BY project_id, path, value) AS n FROM {{literals}}) WHERE n >= 2""")
def repeated_number(t):
    return show(structural.repeated_number_issues(corpus(t)))


@query("A28_repeated_literals", """
SELECT project_id, path AS file_path, value, count(*) AS occurrences FROM {{literals}}
GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def repeated_literals(t):
    return structural.repeated_literals(corpus(t))


# ------------------------------------------------------------------ documents
# The SQL test takes a trailing comma for valid JSON, so that fault is named besides.
@query("R25_json_parse_error", f"""
SELECT project_id, path AS file_path, 0 AS line_start, 0 AS col_start, 'Invalid JSON' AS title, 'json-parse-error' AS rule_id,
  'CRITICAL' AS severity, 100 AS confidence, 90 AS impact
FROM {{{{corpus}}}} WHERE {family_sql('json')} AND (NOT json_valid(content) OR regexp_matches(content, ',\\s*[\\]}}]'))""")
def json_parse(t):
    return show(structural.json_parse_issues(corpus(t)))


@query("R38_md_broken_anchor", f"""
SELECT project_id, path AS file_path, line_no AS line_start, instr(line, url) - 1 AS col_start,
       'Potentially broken anchor link' AS title, 'md-broken-anchor' AS rule_id, 'INFO' AS severity, 50 AS confidence,
       20 AS impact
FROM (SELECT *, regexp_extract(hit, {pattern_text(structural.LINK)}, 2) AS url
      FROM (SELECT *, unnest(regexp_extract_all(line, {pattern_text(structural.LINK)})) AS hit
            FROM (SELECT *, i - 1 AS line_no, lines[i] AS line
                  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i
                        FROM (SELECT project_id, path, content, string_split(content, chr(10)) AS lines
                              FROM {{{{corpus}}}} WHERE {family_sql('markdown')})))))
WHERE starts_with(url, '#') AND NOT contains(lower(content), '# ' || lower(url[2:]))""")
def broken_anchor(t):
    return show(structural.broken_anchor_issues(corpus(t)))


@query("P18_large_file_notice", """
SELECT project_id, path AS file_path, 0 AS line_start, 0 AS col_start, 'File too large for analysis' AS title,
       'skip-large-file' AS rule_id, 'INFO' AS severity, 100 AS confidence, 20 AS impact
FROM {{corpus}} WHERE length(content) > 204800
UNION ALL
SELECT project_id, 'copies/' || path, 0, 0, 'File too large for analysis', 'skip-large-file', 'INFO', 100, 20
FROM {{corpus}} WHERE length(content) * 8 + 7 > 204800""")
def large_file(t):
    """The notice over the corpus and over files of eight copies each (the corpus has few large files)."""
    c = corpus(t)
    copies = c.withColumns({
        "path": F.concat(F.lit("copies/"), F.col("path")),
        "content": F.array_join(F.array_repeat(F.col("content"), F.lit(8)), "\n"),
    })
    return show(structural.large_file_issues(c.unionByName(copies)))


# ------------------------------------------------------------------ symbols and dispatch
relation("symbols", f"""
WITH owned AS (
  SELECT b.project_id, b.path, b.kind, b.name, b.line_start, b.line_end, b.exported,
         (SELECT max_by(c.name, c.line_start) FROM {{{{blocks}}}} c WHERE c.kind = 'class' AND c.project_id = b.project_id
            AND c.path = b.path AND c.line_start < b.line_start AND b.line_start <= c.line_end) AS owner
  FROM {{{{blocks}}}} b WHERE kind IN ('class', 'interface', 'enum', 'method')
     OR (kind = 'function' AND {matches('line', symbols.DECLARED_FUNCTION)})),
v AS (SELECT *, regexp_extract(hit, {pattern_text(symbols.VARIABLE)}, 1) AS name
      FROM ({located_hits('{{script_code}}', 'code', symbols.VARIABLE)})),
a AS (SELECT *, regexp_extract(hit, {pattern_text(symbols.TYPE_ALIAS)}, 1) AS name
      FROM ({located_hits('{{script_code}}', 'code', symbols.TYPE_ALIAS)}))
SELECT project_id, path, CASE WHEN kind = 'method' THEN owner || '.' || name ELSE name END AS name,
       CASE WHEN kind = 'method' THEN 'function' ELSE kind END AS kind, line_start, line_end, exported
FROM owned WHERE kind <> 'method' OR owner IS NOT NULL
UNION ALL
SELECT project_id, path, name, CASE WHEN {matches('hit', chr(92) + 'bconst' + chr(92) + 'b')} THEN 'constant' ELSE 'variable' END, line, line,
       {matches('hit', '^' + chr(92) + 's*export' + chr(92) + 'b')}
FROM (SELECT *, {_prefix_line("off + length(regexp_extract(hit, '^[[:space:]]*'))", 'code')} AS line FROM v)
UNION ALL
SELECT project_id, path, name, 'type', line, line, {matches('hit', '^' + chr(92) + 's*export' + chr(92) + 'b')}
FROM (SELECT *, {_prefix_line("off + length(regexp_extract(hit, '^[[:space:]]*'))", 'code')} AS line FROM a)""")


@query("R81_symbols", "SELECT * FROM {{symbols}}")
def symbol_rows(t):
    return symbols.symbols(corpus(t))


_istmt = pattern_text(symbols.IMPORT_STATEMENT)
relation("imports", f"""
SELECT project_id, path, i - 1 AS position, {_prefix_line("off + length(regexp_extract(hit, '^[[:space:]]*'))")} AS line,
       module, starts_with(module, '.') AS is_relative,
       regexp_extract(regexp_replace(clause, '\\{{[^}}]*\\}}|\\*\\s+as\\s+[\\w$]+', '', 'g'), {_ident}) AS default_import,
       regexp_extract(clause, '\\*\\s+as\\s+([A-Za-z_$][\\w$]*)', 1) AS namespace_import,
       list_filter(list_transform(string_split(regexp_extract(clause, '\\{{([^}}]*)\\}}', 1), ','),
         lambda p: regexp_extract(p, '([A-Za-z_$][\\w$]*)\\s*$', 1)), lambda n: n <> '') AS named_imports
FROM (SELECT *, regexp_extract(hit, {_istmt}, 1) AS clause, regexp_extract(hit, {_istmt}, 2) AS module
      FROM ({located_hits('{{plain_text}}', 'content', symbols.IMPORT_STATEMENT,
                          f"ext IN ({sql_list('.' + e for e in FAMILY_EXTENSIONS['style'])})")}))""")


@query("R81_imports", """
SELECT project_id, path, position, line, module, is_relative, default_import, namespace_import,
       array_to_string(named_imports, ',') AS named_imports FROM {{imports}}""")
def import_rows(t):
    return symbols.imports(corpus(t)).withColumn("named_imports", F.array_join("named_imports", ","))


_exp = pattern_text(symbols.EXPORT_DECLARATION)
@query("R81_exports", f"""
WITH h AS (SELECT project_id, path, unnest(regexp_extract_all(code, {_exp})) AS hit FROM {{{{script_code}}}})
SELECT project_id, path, regexp_extract(hit, {_exp}, 3) AS name,
       CASE regexp_extract(hit, {_exp}, 2) WHEN 'const' THEN 'constant' WHEN 'let' THEN 'variable'
            WHEN 'var' THEN 'variable' ELSE regexp_extract(hit, {_exp}, 2) END AS kind,
       regexp_extract(hit, {_exp}, 1) <> '' AS is_default FROM h
UNION ALL
SELECT project_id, path, name, 'variable', FALSE
FROM (SELECT project_id, path, unnest(flatten(list_transform(
        regexp_extract_all(code, {pattern_text(symbols.EXPORT_LIST)}, 1), lambda l: list_transform(string_split(l, ','),
        lambda p: regexp_extract(p, '([A-Za-z_$][\\w$]*)\\s*$', 1))))) AS name FROM {{{{script_code}}}}) WHERE name <> ''
UNION ALL
SELECT project_id, path, unnest(regexp_extract_all(code, {pattern_text(symbols.EXPORT_DEFAULT)}, 1)), 'variable', TRUE
FROM {{{{script_code}}}}""")
def export_rows(t):
    return symbols.exports(corpus(t))


_families = " ".join(
    f"WHEN {family_sql(f)} THEN '{f}'" for f in ("docker", *FAMILY_EXTENSIONS)
)
@query("R82_rule_dispatch", f"""
SELECT coalesce(CASE {_families} END, 'none') AS family, {LANGUAGE} AS language, count(*) AS n_files
FROM {{{{corpus}}}} GROUP BY 1, 2""")
def dispatch(t):
    c = corpus(t)
    family = F.coalesce(family_of(F.col("path"), F.col("content")), F.lit("none"))
    return c.groupBy(family.alias("family"), language_of(F.col("path")).alias("language")).agg(
        F.count(F.lit(1)).alias("n_files")
    )

"""SQL twins of the rule engines, built from the same rule data."""

from __future__ import annotations

from lintlake.catalog.core import relation, sql_list, sql_text
from lintlake.functions.paths import LANGUAGES
from lintlake.rules.lexer import TEMPLATE_PARTS, TOKENS
from lintlake.rules.lines import CONSOLE, DELEGATED, FAMILY_EXTENSIONS, SCRIPT_WORDS, STRINGS
from lintlake.rules.spec import LineRule, MatchRule

LOWER = "lower(replace(path, chr(92), '/'))"


def pattern_text(pattern: str) -> str:
    """A pattern as SQL text; the checking engine matches in linear time and has no possessive marks."""
    return sql_text(pattern.replace("*+", "*"))


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {pattern_text(pattern)})"


def any_of(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, {sql_text(p)})" for p in parts) + ")"


EXT = r"lower(regexp_extract(split_part(path, '/', -1), '^.+(\.[^.]*)$', 1))"
DAEMON_CONTEXT = f"""CASE WHEN {any_of(LOWER, ['/daemon/'])} THEN 'daemon-service'
  WHEN {any_of(LOWER, ['/scripts/', '/bin/'])} THEN 'build-script'
  WHEN {any_of(LOWER, ['.test.', '.spec.', '/__tests__/'])} THEN 'test' ELSE 'production-web' END"""
WEB_CONTEXT = f"""CASE WHEN {any_of(LOWER, ['/web/src/', '/src/app/', '/src/components/'])} THEN 'production-web'
  WHEN {any_of(LOWER, ['/daemon/', '/services/'])} THEN 'daemon-service'
  WHEN {any_of(LOWER, ['/scripts/', '/webpack'])} OR ends_with({LOWER}, '.config.js') THEN 'build-script'
  ELSE 'general' END"""
LANGUAGE = (
    "CASE lower(split_part(path, '.', -1)) "
    + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in LANGUAGES.items())
    + " ELSE coalesce(nullif(lower(split_part(path, '.', -1)), ''), 'unknown') END"
)


def family_sql(family: str) -> str:
    if family == "web-js":
        return f"{LANGUAGE} IN ('javascript', 'typescript')"
    if family == "web-js-py":
        return f"{LANGUAGE} IN ('javascript', 'typescript', 'python')"
    docker = f"(lower(split_part(path, '/', -1)) = 'dockerfile' OR {EXT} = '.dockerfile')"
    if family == "docker":
        return docker
    inside = f"(NOT {docker} AND {EXT} IN ({sql_list('.' + e for e in FAMILY_EXTENSIONS[family])}))"
    if family != "style":
        return inside
    listed = ["." + e for exts in FAMILY_EXTENSIONS.values() for e in exts] + ["." + e for e in DELEGATED] + [""]
    return f"({inside} OR (NOT {docker} AND {EXT} NOT IN ({sql_list(listed)}) AND {any_of('content', SCRIPT_WORDS)}))"


_blank = lambda x: f"regexp_replace({x}, '[^\\n]', ' ', 'g')"
_inner = "t[2:-2]"
BLANKED = f"""array_to_string(list_transform(regexp_extract_all(content, {pattern_text(TOKENS)}), lambda t:
  CASE WHEN starts_with(t, '//') OR starts_with(t, '/*') THEN {_blank('t')}
       WHEN length(t) >= 2 AND t[1] IN ('"', '''') THEN t[1] || {_blank(_inner)} || t[1]
       WHEN length(t) >= 2 AND t[1] = '`' THEN '`' || array_to_string(list_transform(
            regexp_extract_all({_inner}, {sql_text(TEMPLATE_PARTS)}),
            lambda p: CASE WHEN starts_with(p, '${{') THEN p ELSE {_blank('p')} END), '') || '`'
       ELSE t END), '')"""

relation("script_code", f"""
SELECT project_id, path, content, ext, {BLANKED} AS code
FROM (SELECT *, {EXT} AS ext FROM {{{{corpus}}}})
WHERE ext IN ({sql_list('.' + e for e in FAMILY_EXTENSIONS['style'])})""")
relation("plain_text", f"SELECT project_id, path, content, {EXT} AS ext, content AS code FROM {{{{corpus}}}}")

META = "{rule!s} AS rule_id, {sev!s} AS severity, {conf} AS confidence, {impact} AS impact"


def _meta(rule) -> str:
    return META.format(
        rule=sql_text(rule.id), sev=sql_text(rule.severity), conf=rule.confidence, impact=rule.effective_impact
    )


def located_hits(source: str, text: str, pattern: str, where: str = "TRUE") -> str:
    """Rows of ``source`` with one row per match: i, hit and 0-based offset."""
    p = pattern_text(pattern)
    return f"""
  SELECT *, (list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::BIGINT AS off,
         hits[i] AS hit
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT *, regexp_extract_all({text}, {p}) AS hits,
                     list_transform(regexp_split_to_array({text}, {p}), lambda s: length(s)) AS gaps
              FROM {source} WHERE {matches(text, pattern)} AND ({where})))"""


def _prefix_line(off: str, text: str = "content") -> str:
    return f"length(left({text}, {off})) - length(replace(left({text}, {off}), chr(10), ''))"


def _prefix_col(off: str, text: str = "content") -> str:
    return f"length(split_part(left({text}, {off}), chr(10), -1))"


def match_rule_sql(rule: MatchRule) -> str:
    source = "{{script_code}}" if rule.text == "code" else "{{plain_text}}"
    text = "code" if rule.text == "code" else "content"
    where = ["TRUE"]
    if rule.exts:
        where.append(f"ext IN ({sql_list('.' + e for e in rule.exts)})")
    if rule.contexts:
        where.append(f"{DAEMON_CONTEXT} IN ({sql_list(rule.contexts)})")
    name = f"regexp_extract(hit, {pattern_text(rule.pattern)}, {rule.name_group})" if rule.name_group else "''"
    keep = ["TRUE"]
    if rule.hit_lacks:
        keep.append("NOT " + matches("hit", rule.hit_lacks))
    if rule.name_has:
        keep.append(matches("name", rule.name_has))
    if rule.name_lacks:
        keep.append("NOT " + matches("name", rule.name_lacks))
    if rule.raw_has:
        keep.append(matches("substring(content, off + 1, length(hit))", rule.raw_has))
    if rule.raw_lacks:
        keep.append("NOT " + matches("substring(content, off + 1, length(hit))", rule.raw_lacks))
    if rule.before_lacks:
        keep.append("NOT " + matches("left(content, off)", rule.before_lacks))
    if rule.nth:
        keep.append(f"i = {rule.nth}")
    skip = f" + length(regexp_extract(hit, {sql_text(rule.skip)}))" if rule.skip else ""
    return f"""
SELECT project_id, path AS file_path, {_prefix_line('pos')} AS line_start, {_prefix_col('pos')} AS col_start,
       replace({sql_text(rule.title)}, '{{name}}', name) AS title, {_meta(rule)}
FROM (SELECT *, off{skip} AS pos
      FROM (SELECT *, {name} AS name FROM ({located_hits(source, text, rule.pattern, ' AND '.join(where))}))
      WHERE {' AND '.join(keep)})"""


_OVER = "length(line) > 120"
_CONSOLE = matches("line", CONSOLE)
G1 = f"NOT ({_OVER} AND ({matches('trim_', '^(?:import|export)[ {]')} OR {matches('line', '(https?://|www[.])')}))"
_SCRIPT = "(contains(replace(path, chr(92), '/'), '/scripts/') OR ends_with(path, '.config.js') OR ends_with(path, '.config.ts'))"
G2 = f"{G1} AND NOT ({_CONSOLE} AND {_SCRIPT})"
G3 = f"{G2} AND NOT ({_CONSOLE} AND {matches('line', 'console[.]error')} AND {DAEMON_CONTEXT} <> 'production-web')"
G4 = f"{G3} AND NOT ({matches('line', chr(92) + 'bdebugger' + chr(92) + 'b')} AND {matches('trim_', '^(?://|/[*]|[*])')})"
WHERE = {
    "guard1": G1,
    "guard3": G3,
    "guard4": G4,
    "over_length": _OVER,
    "shipped_context": f"{DAEMON_CONTEXT} IN ('production-web', 'test')",
    "tool_context": f"{DAEMON_CONTEXT} IN ('daemon-service', 'build-script')",
    "debugger_outside_strings":
        f"len(list_filter(regexp_extract_all(line, {pattern_text(STRINGS)}), lambda s: contains(s, 'debugger'))) = 0",
    "no_quote_before_equality": "NOT regexp_matches(right(split_part(line, '==', 1), 5), '[''\"`]')",
    "web_production": f"{WEB_CONTEXT} = 'production-web'",
    "not_web_production": f"{WEB_CONTEXT} <> 'production-web'",
    "web_async_context": f"{WEB_CONTEXT} NOT IN ('daemon-service', 'build-script')",
    "first_line": "line_start = 0",
    "docker_code": "trim_ <> '' AND NOT starts_with(trim_, '#')",
    "no_where_ahead": "NOT contains(substring(upper(content), instr(upper(content), upper(line))), 'WHERE')",
}
INPUTS = {
    "line": "line",
    "trim": "trim_",
    "ahead": "array_to_string(lines[line_start + 1:line_start + 5], chr(10))",
    "first_tag": r"regexp_extract(line, '(?i)//\s*(TODO|FIXME|HACK|XXX)', 1)",
    "first_console": r"regexp_extract(line, '\bconsole\.(log|debug|info|warn|error)\s*\(', 1)",
}


def line_rule_sql(rule: LineRule) -> str:
    tests = [matches(INPUTS[n], p) for n, p in rule.has]
    tests += ["NOT " + matches(INPUTS[n], p) for n, p in rule.lacks]
    tests += [f"({WHERE[n]})" for n in rule.where]
    kind, value = rule.column
    column = {
        "regex": f"length(regexp_split_to_array(line, {sql_text(str(value))})[1])",
        "max_length": "120",
    }.get(kind, str(value))
    return f"""
SELECT project_id, path AS file_path, line_start, {column} AS col_start, {sql_text(rule.title)} AS title, {_meta(rule)}
FROM (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS trim_
      FROM (SELECT *, lines[i] AS line, i - 1 AS line_start
            FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i
                  FROM (SELECT project_id, path, content, string_split(content, chr(10)) AS lines
                        FROM {{{{corpus}}}} WHERE {family_sql(rule.family)}))))
WHERE {' AND '.join(tests)}"""

"""Whole-file pattern matches as rows: one pass over the files, no shuffle.

Every rule turns a file into an array of matches with exact offsets; the arrays are
concatenated and exploded once, so any number of rules costs one scan and one generator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lintlake.functions.bind import let, pin
from lintlake.functions.paths import daemon_context, dot_extension
from lintlake.functions.text import running_sums_sql, trimmed
from lintlake.rules.lexer import blank_code
from lintlake.rules.needs import may_match
from lintlake.rules.registry import MATCH_RULES
from lintlake.rules.spec import MatchRule
from lintlake.schema import ISSUE_COLUMNS, constant

MATCH = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("offset", T.IntegerType()),
        T.StructField("hit", T.StringType()),
        T.StructField("name", T.StringType()),
    ]
)


_OFFSETS = """
CASE WHEN regexp_like({text}, {p}) THEN
  transform(array(struct(
      regexp_extract_all({text}, {p}, 0) AS hits,
      transform(split({text}, {p}, -1), x -> {size_x}) AS gaps)), b ->
    transform(array({sums}), starts ->
      transform(b.hits, (h, i) -> named_struct(
        'ord', {ord},
        'offset', starts[i],
        'hit', h,
        'name', {name})))[0])[0]
ELSE CAST(array() AS array<struct<ord:int,offset:int,hit:string,name:string>>) END"""


def sql_literal(text: str) -> str:
    """A SQL string literal of any text, back slashes and quotes included."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def match_offsets(text: str, pattern: str, ordinal: int = 0, name_group: int | None = None) -> Column:
    """All matches in column ``text`` as ``array<struct<ord,offset,hit,name>>`` with 0-based offsets.

    The k-th match starts after k+1 gaps between matches and k earlier matches, so its offset is a running sum
    of lengths. Every match is reported, however many a file has. Each array is bound once. The
    expression is given as SQL text: one call to the JVM instead of dozens per rule.
    """
    return F.expr(offsets_sql(text, pattern, ordinal, name_group))


def offsets_sql(text: str, pattern: str, ordinal: int = 0, name_group: int | None = None, size: str = "length({0})") -> str:
    p = sql_literal(pattern)
    name = f"regexp_extract(h, {p}, {name_group})" if name_group else "''"
    steps = "transform(b.hits, (h, i) -> coalesce(get(b.gaps, i), 0) + CASE WHEN i > 0 THEN " + size.format("b.hits[i - 1]") + " ELSE 0 END)"
    return _OFFSETS.format(text=text, p=p, size_x=size.format("x"), sums=running_sums_sql(steps), ord=ordinal, name=name)


def match_lines(text: str, pattern: str, name_group: int) -> Column:
    """All matches in column ``text`` as ``array<struct<ord,line,hit,name>>`` with the 0-based line each one starts on.

    As :func:`match_offsets`, but what is summed are line breaks.
    """
    return F.expr(offsets_sql(text, pattern, 0, name_group, "length({0}) - length(replace({0}, '\\n', ''))")
                  .replace("'offset'", "'line'").replace("offset:int", "line:int"))


def line_matches(lines: str, pattern: str, name_group: int, has: str, lacks: str) -> Column:
    """Matches line by line as ``array<struct<line,column,name>>`` of the captured names.

    Only lines with ``has`` and without ``lacks`` are searched, and positions are found within the
    line, which is cheaper than offsets into the file where matches are many. A line with one match needs no sums.
    """
    p = sql_literal(pattern)
    return F.expr(
        f"""flatten(transform(
              filter(transform({lines}, (x, i) -> struct(x AS text, i AS line)),
                     s -> regexp_like(s.text, {sql_literal(has)}) AND NOT regexp_like(s.text, {sql_literal(lacks)})),
              s -> transform(array(regexp_extract_all(s.text, {p}, {name_group})), names -> CASE
                WHEN size(names) = 0 THEN CAST(array() AS array<struct<line:int,column:int,name:string>>)
                WHEN size(names) = 1 THEN array(named_struct('line', s.line,
                  'column', regexp_instr(s.text, {p}) - 1 + length(regexp_substr(s.text, {p})) - length(names[0]), 'name', names[0]))
                ELSE transform({offsets_sql('s.text', pattern, 0, name_group)},
                     m -> named_struct('line', s.line, 'column', m.offset + length(m.hit) - length(m.name),
                                       'name', m.name)) END)[0]))"""
    )


_PLACED = """
CASE WHEN size(__hits) > 0 THEN
  transform(array(split(content, '\\n', -1)), lines ->
    transform(array(concat(array(0), {ends})), starts ->
      transform(__hits, m ->
        transform(array(aggregate(sequence(1, CAST(ceil(log2(size(lines) + 1)) AS INT)), named_struct('low', 0, 'high', size(lines) - 1), (a, k) ->
            transform(array(CAST((a.low + a.high + 1) div 2 AS INT)), mid ->
              CASE WHEN a.low >= a.high THEN a WHEN starts[mid] <= m.offset THEN named_struct('low', mid, 'high', a.high)
                   ELSE named_struct('low', a.low, 'high', mid - 1) END)[0], a -> a.low)), line ->
          named_struct('ord', m.ord, 'line', line, 'col', m.offset - starts[line], 'width', length(m.hit), 'name', m.name,
                       'snippet', lines[line]))[0]))[0])[0] END"""


def placed() -> Column:
    """The ``__hits`` in ``content`` with line, column and the text of their line: a binary search each in the starts of the lines."""
    ends = running_sums_sql("transform(lines, x -> length(x) + 1)")
    return F.expr(_PLACED.format(ends=ends))


def line_of(text: Column, offset: Column) -> Column:
    """0-based line of a 0-based offset."""
    prefix = F.substr(text, F.lit(1), offset)
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit("")))


def column_of(text: Column, offset: Column) -> Column:
    return F.length(F.substring_index(F.substr(text, F.lit(1), offset), "\n", -1))


def line_text(text: Column, offset: Column) -> Column:
    before = F.substring_index(F.substr(text, F.lit(1), offset), "\n", -1)
    after = F.substring_index(F.substr(text, offset + 1), "\n", 1)
    return F.concat(before, after)


def with_code(files: DataFrame) -> DataFrame:
    return files.withColumn("code", blank_code(F.col("content")))


def _rule_array(rule: MatchRule, ordinal: int) -> Column:
    found = match_offsets(rule.text, rule.pattern, ordinal, rule.name_group)
    if rule.hit_lacks:
        found = F.filter(found, lambda m: ~m["hit"].rlike(rule.hit_lacks))
    if rule.name_has:
        found = F.filter(found, lambda m: m["name"].rlike(rule.name_has))
    if rule.name_lacks:
        found = F.filter(found, lambda m: ~m["name"].rlike(rule.name_lacks))
    raw = lambda m: F.substr(F.col("content"), m["offset"] + 1, F.length(m["hit"]))
    if rule.raw_has:
        found = F.filter(found, lambda m: raw(m).rlike(rule.raw_has))
    if rule.raw_lacks:
        found = F.filter(found, lambda m: ~raw(m).rlike(rule.raw_lacks))
    if rule.before_lacks:
        found = F.filter(
            found, lambda m: ~F.substr(F.col("content"), F.lit(1), m["offset"]).rlike(rule.before_lacks)
        )
    if rule.nth:
        found = F.slice(found, rule.nth, 1)
    if rule.skip:
        found = F.transform(
            found,
            lambda m: m.withField("offset", m["offset"] + F.length(F.regexp_extract(m["hit"], rule.skip, 0))),
        )
    applies = F.lit(True)
    if rule.exts:
        applies = applies & F.col("ext").isin(*["." + e for e in rule.exts])
    if rule.contexts:
        applies = applies & daemon_context(F.col("path")).isin(*rule.contexts)
    # A short look before the searches: a text without what every match, or every name, holds has none.
    for pattern in (rule.pattern, rule.name_has):
        if pattern and (look := may_match(F.col(rule.text), pattern)) is not None:
            applies = applies & look
    return F.when(applies, found).otherwise(F.array().cast(T.ArrayType(MATCH)))


_META = (
    "array<struct<rule_id:string,title:string,description:string,category:string,severity:string,"
    "confidence:int,impact:int,engine:string>>"
)


def rule_literals(rules: Sequence) -> Column:
    """The rules' metadata as one constant array, indexed by ordinal: no join, no broadcast."""
    return constant(
        [
            {
                "rule_id": r.id,
                "title": r.title,
                "description": r.description,
                "category": r.category,
                "severity": r.severity,
                "confidence": r.confidence,
                "impact": r.effective_impact,
                "engine": r.engine,
            }
            for r in rules
        ],
        _META,
    )


def match_issues(files: DataFrame, rules: Sequence[MatchRule] = MATCH_RULES) -> DataFrame:
    """Issues of all ``rules`` over ``files(project_id, path, content)``."""
    rules = list(rules)
    prepared = files.select("project_id", "path", "content", dot_extension(F.col("path")).alias("ext"))
    if not rules:
        return prepared.where(F.lit(False)).select("project_id", F.col("path").alias("file_path"))
    exts = [r.exts for r in rules]
    if all(exts):
        wanted = sorted({"." + e for group in exts for e in group})
        prepared = prepared.where(F.col("ext").isin(*wanted))
    if any(r.text == "code" for r in rules):
        lexed = F.col("ext").isin(*sorted({"." + e for r in rules if r.text == "code" for e in r.exts}))
        prepared = prepared.withColumn("code", F.when(lexed, blank_code(F.col("content"))).otherwise(F.lit("")))
    arrays = [_rule_array(rule, i) for i, rule in enumerate(rules)]
    found = pin(prepared.select("project_id", "path", "content", *(["code"] if "code" in prepared.columns else []), "ext"),
                __hits=F.concat(*arrays) if len(arrays) > 1 else arrays[0])
    hits = found.where(F.size("__hits") > 0).select("project_id", "path", F.explode(placed()).alias("m"))
    meta = F.get(rule_literals(rules), F.col("m.ord"))
    return hits.select(
        "project_id",
        F.col("path").alias("file_path"),
        meta["rule_id"].alias("rule_id"),
        F.col("m.ord").alias("ord"),
        F.col("m.line").alias("line_start"),
        F.col("m.col").alias("col_start"),
        F.col("m.line").alias("line_end"),
        (F.col("m.col") + F.col("m.width")).alias("col_end"),
        F.replace(meta["title"], F.lit("{name}"), F.col("m.name")).alias("title"),
        meta["description"].alias("description"),
        meta["category"].alias("category"),
        meta["severity"].alias("severity"),
        meta["confidence"].alias("confidence"),
        meta["impact"].alias("impact"),
        trimmed(F.col("m.snippet")).alias("code_snippet"),
        F.lit("static").alias("source"),
        meta["engine"].alias("engine"),
    )


def with_match_hits(coded: DataFrame, rules: Sequence[MatchRule], gates: Sequence[Column | None]) -> tuple[DataFrame, Column]:
    """``coded(path, content, ext, code)`` with the placed hits of ``rules``, and these as an array of structs with ``ord``.

    ``gates`` holds for each rule a test of the file row, or None where the rule applies to all files it names.
    """
    none = F.array().cast(T.ArrayType(MATCH))
    arrays = [_rule_array(rule, i) for i, rule in enumerate(rules)]
    arrays = [a if g is None else F.when(g, a).otherwise(none) for a, g in zip(arrays, gates)]
    base = pin(coded, __hits=F.concat(*arrays) if len(arrays) > 1 else arrays[0])
    base = pin(base, _placed=placed()).drop("__hits")

    def of(m: Column) -> Column:
        def build(meta: Column) -> Column:
            values = {
                "rule_id": meta["rule_id"], "ord": m["ord"], "line_start": m["line"], "col_start": m["col"], "line_end": m["line"],
                "col_end": m["col"] + m["width"], "title": F.replace(meta["title"], F.lit("{name}"), m["name"]),
                "description": meta["description"], "category": meta["category"], "severity": meta["severity"],
                "confidence": meta["confidence"], "impact": meta["impact"], "code_snippet": trimmed(m["snippet"]),
                "source": F.lit("static"), "engine": meta["engine"],
            }
            return F.struct(*[values[c].alias(c) for c in ISSUE_COLUMNS if c in values])

        return let(F.get(rule_literals(rules), m["ord"]), build)

    return base, F.transform("_placed", of)


REGISTRY_LIMIT = 1000


def load_rules(registry: DataFrame) -> list[MatchRule]:
    """User rules from a table ``(id, title, description, pattern, exts, category, severity, confidence, impact)``.

    ``exts`` is an array of extensions, null for every file. A registry shapes the plan, so it is read
    while the plan is built; its size is checked and a larger one refused.
    """
    rows = registry.limit(REGISTRY_LIMIT + 1).collect()
    if len(rows) > REGISTRY_LIMIT:
        raise ValueError(f"a rule registry holds at most {REGISTRY_LIMIT} rules")
    return [
        MatchRule(
            r["id"], r["title"], r["category"], r["severity"], r["confidence"], r["description"], impact=r["impact"],
            profile="user", exts=tuple(r["exts"]) if r["exts"] else None, pattern=r["pattern"],
        )
        for r in sorted(rows, key=lambda r: r["id"])
    ]

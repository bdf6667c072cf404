"""Rules that need blocks, token sets or whole-file counts.

All rules of script files share one frame: the file row with its blanked code, lines, blocks and
the matches they look at, each computed once. Every rule turns the frame into an array of issues; the
arrays are concatenated and exploded once. The pass is narrow and reads the files once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.bind import let, pin
from lintlake.functions.paths import daemon_context, dot_extension, language_of
from lintlake.functions.text import trimmed
from lintlake.rules.lexer import blank_code
from lintlake.rules.lines import family_of
from lintlake.rules.matches import line_matches, match_offsets
from lintlake.rules.spans import BRANCHES, CONTROL, IDENT, KINDS, LOGICAL, LOOP, MEASURES, NESTING, depth_at, first_where, line_starts, of_kind, structure, with_blocks, with_cognitive_candidates, with_depths, with_many_parameters, with_measures, with_nested
from lintlake.rules.spans import line_at as _line
from lintlake.rules.spec import JS, REACT, WEB_JS
from lintlake.schema import IMPACT, ISSUE_COLUMNS, lookup

LARGE_FILE_CHARS = 200 * 1024
_NUMERIC = {"ord", "line_start", "col_start", "line_end", "col_end", "confidence", "impact"}
_OWN = tuple(c for c in ISSUE_COLUMNS if c not in ("project_id", "file_path"))


def _values(values: dict) -> dict[str, Column]:
    """All issue columns from the given ones; plain values become literals."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    values.setdefault("ord", 0)
    values.setdefault("col_start", 0)
    values.setdefault("line_end", values["line_start"])
    values.setdefault("col_end", values["col_start"])
    values.setdefault("source", "static")
    values.setdefault("engine", "lexical")
    severity = values["severity"]
    values.setdefault("impact", lookup(IMPACT, severity) if isinstance(severity, Column) else IMPACT[severity])
    return {n: as_col(values[n]).cast("int") if n in _NUMERIC else as_col(values[n]) for n in _OWN}


def issue_struct(**values) -> Column:
    return F.struct(*[c.alias(n) for n, c in _values(values).items()])


# ------------------------------------------------------------------ positions inside the frame
# Offsets find their line by binary search in ``line_starts``, which the frame has with ``raw_lines``.
def _column(offset: Column) -> Column:
    return let(_line(offset), lambda line: offset - F.get("line_starts", line))


def _snippet(offset: Column) -> Column:
    return trimmed(F.get("raw_lines", _line(offset)))


def _placed(array: str) -> Column:
    """Matches with the line each one starts on."""
    return F.transform(array, lambda m: m.withField("line", _line(m["offset"])))


# ------------------------------------------------------------------ functions
DEFAULT_THRESHOLDS = {
    "max_cyclomatic": 10,
    "max_cognitive": 15,
    "max_nesting": 4,
    "max_params": 5,
    "max_function_length": 50,
}


#: rule of the ``complexity`` group -> (measures it reads, what the code of every file with an issue of it holds)
COMPLEXITY = {
    "cyclomatic": (("cyclomatic",), lambda code, t: F.regexp_count(code, F.lit(BRANCHES)) >= t["max_cyclomatic"]),
    # Each branch counts at most once more for every block around it.
    "cognitive": (("cognitive",), lambda code, t: let(
        F.regexp_count(code, F.lit(WEIGHTED)), lambda n: n * (1 + F.regexp_count(code, F.lit(NESTING))) > t["max_cognitive"])),
    "nesting": (("nesting",), lambda code, t: F.regexp_count(code, F.lit(NESTING)) > t["max_nesting"]),
    "params": ((), lambda code, t: F.length(code) - F.length(F.replace(code, F.lit(","), F.lit(""))) >= t["max_params"]),
    "func-length": ((), lambda code, t: F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit(""))) > t["max_function_length"]),
}
#: rules whose look counts characters: a text holds as many as its blanked code at least, and all of its line breaks
COUNTED = {"params", "func-length"}
# What counts for the cognitive complexity.
WEIGHTED = rf"{CONTROL}|{LOGICAL}"


def may_hold_functions(code: Column) -> Column:
    """A function or method holds one of these, on whatever line."""
    return code.contains("{") | code.contains("=>") | code.contains("function")


def complexity_hits(thresholds: dict, rules: Sequence[str] = tuple(COMPLEXITY)) -> Column:
    """The per-function ``rules`` over the measured functions."""
    t = {**DEFAULT_THRESHOLDS, **thresholds}

    def of(m: Column) -> Column:
        quoted = lambda before, after="": F.concat(F.lit(before + "'"), m["name"], F.lit("'" + after))

        def rule(ordinal, rule_id, value, limit, title, label, category, severity, confidence, end="line_end"):
            text = F.concat(F.lit(f"{label} is "), m[value].cast("string"), F.lit(f" (threshold: {limit})."))
            return F.when(
                m[value] > limit,
                issue_struct(
                    rule_id=rule_id, ord=ordinal, line_start=m["line_start"], line_end=m[end], title=title,
                    description=text, category=category, severity=severity, confidence=confidence,
                    code_snippet=m["name"],
                ),
            )

        worse = F.when(m["cyclomatic"] > 2 * t["max_cyclomatic"], "CRITICAL").otherwise("MAJOR")
        made = (
            (0, "cyclomatic", "cyclomatic", t["max_cyclomatic"], quoted("High cyclomatic complexity in "),
             "Cyclomatic complexity", "maintainability", worse, 95),
            (1, "cognitive", "cognitive", t["max_cognitive"], quoted("High cognitive complexity in "),
             "Cognitive complexity", "maintainability", "MAJOR", 90),
            (2, "nesting", "nesting", t["max_nesting"], quoted("Deep nesting in "),
             "Maximum nesting depth", "code-smell", "MAJOR", 90),
            (3, "params", "params", t["max_params"], quoted("Too many parameters in "),
             "The number of parameters", "code-smell", "INFO", 85, "line_start"),
            (4, "func-length", "length", t["max_function_length"], quoted("Function ", " is too long"),
             "The number of lines", "maintainability", "MAJOR", 90),
        )
        return F.array_compact(F.array(*[rule(*values) for values in made if values[1] in rules]))

    return F.flatten(F.transform("measures", of))


# ------------------------------------------------------------------ loops
# Fixed values: (rule, title, confidence, pattern, captured group) of the rules that look inside loops.
LOOP_PATTERNS = (
    ("perf-array-in-loop", "Array method '{name}' inside loop", 65,
     r"\.(filter|map|reduce|find|findIndex|some|every|includes)\s*\(", 1),
    ("perf-string-concat", "String concatenation in loop", 60, rf"{IDENT}\s*\+=", None),
    ("async-await-loop", "Await inside loop", 70, r"\bawait\b", None),
)


def loop_found() -> Column:
    found = [match_offsets("code", p, i, group) for i, (_, _, _, p, group) in enumerate(LOOP_PATTERNS)]
    return F.when(F.size(of_kind("loop")) > 0, F.concat(*found))


def loop_hits() -> Column:
    """Array methods, string building and awaits inside loops."""
    pick = lambda m, values: F.element_at(F.array(*[F.lit(v) for v in values]), m["ord"] + 1)
    ids, titles, confidences = zip(*[(r, t, c) for r, t, c, *_ in LOOP_PATTERNS])
    inside = F.filter(_placed("loop_found"), lambda m: depth_at("loops", m["line"]) > 0)
    return F.transform(
        inside,
        lambda m: issue_struct(
            rule_id=pick(m, ids), ord=m["ord"], line_start=m["line"], col_start=_column(m["offset"]),
            col_end=_column(m["offset"]) + F.length(m["hit"]),
            title=F.replace(pick(m, titles), F.lit("{name}"), m["name"]),
            description="Work repeated by a loop; hoist or batch it.", category="performance", severity="INFO",
            confidence=pick(m, confidences), code_snippet=_snippet(m["offset"]),
        ),
    )


def nested_loop_hits() -> Column:
    # Loops stand in the order of their lines: the next one after the start lies inside, or none does.
    following = lambda o: F.get("loops", first_where("loops", lambda i: i["line_start"] > o["line_start"]))
    outer = F.filter("loops", lambda o: F.coalesce(following(o)["line_start"] <= o["line_end"], F.lit(False)))

    def of(b: Column) -> Column:
        line = F.get("lines", b["line_start"])
        kind = (
            F.when(line.rlike(r"\bfor\s*\(.*\bof\b"), "for...of loop")
            .when(line.rlike(r"\bfor\s*\(.*\bin\b"), "for...in loop")
            .when(line.rlike(r"\bfor\b"), "for loop")
            .when(line.rlike(r"\bdo\b"), "do...while loop")
            .otherwise("while loop")
        )
        return issue_struct(
            rule_id="perf-nested-loop", line_start=b["line_start"], line_end=b["line_end"],
            col_start=F.length(F.get(F.split(line, r"\b(?:for|while|do)\b", 2), F.lit(0))), col_end=0,
            title="Nested loop detected", description="Loops inside loops multiply; look values up instead.",
            category="performance", severity="INFO", confidence=70, code_snippet=kind,
        )

    return F.transform(outer, of)


# ------------------------------------------------------------------ async and React
# Names that look asynchronous and names that only seem to.
SURE_ASYNC = r"(?i)(?:fetch|axios|request)"
SYNC_GUARD = r"^(?:is[A-Z]|has[A-Z]|check[A-Z]|can[A-Z])"
SYNC_NAMES = (
    "updateState", "updateConfig", "updateFile", "updateUI", "updateView", "updateCache", "updateLocal",
    "updateCounter", "updateIndex", "saveLocal", "saveToCache", "saveState", "deleteLocal",
    "deleteFromCache", "deleteState", "querySelector", "querySelectorAll", "requestAnimationFrame",
    "isJsonRpcRequest", "isJsonRpcNotification", "isJsonRpcResponse", "isShutdownMessage",
    "isValidRequest", "isValidMessage", "isTypeGuard", "hasProperty", "isInstanceOf",
)
ASYNC_CALL = (
    r"(?i)(?:^|[^\w$])((?:[\w$]*(?:fetch|axios|request|findOne|findAll|findById|findMany|createOne|createMany))[\w$]*)\s*\("
)
TAKEN = r"(?:\bawait\s+|\breturn\s+|\bfunction\s+|=\s*|=>\s*)[\w$.]*$"


def missing_await_hits() -> Column:
    """Calls named like async ones, unhandled, whose innermost function is async."""
    sync_names = [n.lower() for n in SYNC_NAMES]

    def waits(line: Column) -> Column:
        around = F.filter("funcs", lambda f: (line >= f["line_start"]) & (line <= f["line_end"]))
        ranked = F.transform(around, lambda f: F.struct(f["line_start"].alias("s"), f["is_async"].alias("a")))
        return F.coalesce(F.array_max(ranked)["a"], F.lit(False))

    before = lambda m: F.substr(F.col("code"), F.lit(1), m["offset"] + F.length(m["hit"]))
    unhandled = lambda m: ~F.regexp_replace(before(m), r"[\w$]+\s*\($", "").rlike(TAKEN)
    named = F.filter(
        "async_found", lambda m: ~m["name"].rlike(SYNC_GUARD) & ~F.lower(m["name"]).isin(*sync_names) & unhandled(m)
    )
    placed = F.transform(named, lambda m: m.withField("line", _line(m["offset"])))

    def of(m: Column) -> Column:
        column = _column(m["offset"]) + F.length(F.regexp_extract(m["hit"], r"^[^\w$]", 0))
        return issue_struct(
            rule_id="async-missing-await", line_start=m["line"], col_start=column,
            col_end=column + F.length(m["hit"]),
            title=F.concat(F.lit("Possibly missing await on '"), m["name"], F.lit("'")),
            description="The call looks asynchronous and nothing waits for it.", category="bug", severity="MAJOR",
            confidence=F.when(m["name"].rlike(SURE_ASYNC), 85).otherwise(65), code_snippet=_snippet(m["offset"]),
        )

    return F.transform(F.filter(placed, lambda m: waits(m["line"])), of)


HOOKS = "useState|useEffect|useContext|useReducer|useCallback|useMemo|useRef|useLayoutEffect"
HOOK_CALL = rf"(?:^|[^.\w$])({HOOKS})\s*[(<]"


def _is_react() -> Column:
    return F.col("ext").isin(*["." + e for e in REACT])


def conditional_hook_hits() -> Column:
    """Hooks inside of an ``if`` or of a conditional expression."""
    around = lambda m: F.get("conditional", first_where("conditional", lambda c: c["end"] > m["offset"] + F.length(m["hit"]) - 1))
    asked = lambda m: F.coalesce(around(m)["start"] <= m["offset"] + F.length(m["hit"]) - 1, F.lit(False))
    inside = F.filter(_placed("hook_found"), lambda m: (depth_at("ifs", m["line"]) > 0) | asked(m))
    return F.transform(
        inside,
        lambda m: issue_struct(
            rule_id="react-conditional-hook", line_start=m["line"], col_start=_column(m["offset"]),
            col_end=_column(m["offset"]) + F.length(m["hit"]),
            title=F.concat(F.lit("Conditional hook call: "), m["name"]),
            description="Hooks must run in the same order on every render.", category="bug", severity="CRITICAL",
            confidence=95, code_snippet=_snippet(m["offset"]),
        ),
    )


def effect_hits() -> Column:
    """Effects called with one argument."""
    open_ended = F.filter("parens", lambda g: _is_react() & (g["head"] == "useEffect") & (g["parts"] == 1))
    return F.transform(
        open_ended,
        lambda g: issue_struct(
            rule_id="react-useeffect-deps", line_start=g["line"], line_end=g["line_end"],
            title="useEffect missing dependency array", description="The effect runs on every render.",
            category="bug", severity="MAJOR", confidence=90, code_snippet="useEffect(() => {...})",
        ),
    )


# An element or fragment that starts where an expression may, and its key.
ELEMENT = r"(?:^|[^\w$)\].])<(?:[A-Za-z][\w.]*[\s/>]|>)"
KEY = r"\bkey\s*="


def missing_key_hits() -> Column:
    """Calls of ``map`` in whose arguments elements are made and none has a key."""
    made = lambda g: F.substr(F.col("code"), g["start"] + 1, g["end"] - g["start"] + 1)
    keyless = F.filter("parens", lambda g: _is_react() & (g["head"] == ".map") & let(made(g), lambda x: x.rlike(ELEMENT) & ~x.rlike(KEY)))
    return F.transform(
        keyless,
        lambda g: issue_struct(
            rule_id="react-missing-key", line_start=_line(g["start"] - 4), col_start=_column(g["start"] - 4), line_end=g["line_end"], col_end=0,
            title="Missing key prop in list rendering", description="List items need a stable key.",
            category="bug", severity="MAJOR", confidence=80, code_snippet=".map(...)",
        ),
    )


# ------------------------------------------------------------------ unused names
DECLARED = rf"\b(?:const|let|var|function)\s+({IDENT})"
EXPORTED = rf"\bexport\s+(?:default\s+)?(?:async\s+)?(?:const|let|var|function)\s+({IDENT})"
IMPORT = r"\bimport\s+(?:type\s+)?([\w$\s{},*]+?)\s+from\b"


def unused_names() -> Column:
    """Declared names that occur nowhere but in declarations.

    The uses are the identifiers left after the declared names are cut out of the code, so the test is
    a difference of two token sets inside the file row.
    """
    uses = F.regexp_extract_all(F.regexp_replace("code", DECLARED, " "), F.lit(IDENT), F.lit(0))
    exported = F.regexp_extract_all("code", F.lit(EXPORTED), F.lit(1))
    declared = F.filter(F.transform("declared", lambda m: m["name"]), lambda n: ~n.startswith("_"))
    return F.array_except(F.array_except(declared, uses), exported)


def unused_hits() -> Column:
    """The first declaration of each unused name."""
    first = let(
        F.transform("declared", lambda x: x["name"]),
        lambda names: F.filter(
            "declared",
            lambda m, i: F.array_contains("unused", m["name"]) & (F.array_position(names, m["name"]) == i + 1),
        ),
    )

    def of(m: Column) -> Column:
        end = m["offset"] + F.length(m["hit"])
        column = _column(end - F.length(m["name"]))
        return issue_struct(
            rule_id="unused", line_start=_line(end), col_start=column, col_end=column + F.length(m["name"]),
            title=F.concat(F.lit("Unused variable '"), m["name"], F.lit("'")),
            description="Declared and never used; remove it or start the name with an underscore.",
            category="code-smell", severity="MAJOR", confidence=85, code_snippet=m["name"],
        )

    return F.transform(first, of)


def _imported_names(clause: Column) -> Column:
    """Local names of an import clause: default, namespace and named ones, after any ``as``."""
    parts = F.split(F.regexp_replace(clause, r"[{}*]", ","), ",")
    local = F.transform(parts, lambda p: F.regexp_extract(p, rf"({IDENT})\s*$", 1))
    return F.filter(local, lambda n: n != "")


def unused_import_hits() -> Column:
    uses = F.regexp_extract_all(F.regexp_replace("code", IMPORT, " "), F.lit(IDENT), F.lit(0))

    def of(name: Column, line: Column) -> Column:
        return issue_struct(
            rule_id="unused-import", line_start=line, title=F.concat(F.lit("Unused import '"), name, F.lit("'")),
            description="Imported and never used.", category="code-smell", severity="INFO", confidence=80,
            code_snippet=name,
        )

    each = lambda used: F.flatten(
        F.transform(
            "imported",
            lambda m: F.transform(
                F.array_except(_imported_names(m["name"]), used), lambda n: of(n, _line(m["offset"]))
            ),
        )
    )
    return F.when(F.size("imported") > 0, let(uses, each)).otherwise(let(F.array().cast("array<string>"), each))


# ------------------------------------------------------------------ numbers
# Literals that need no name.
PLAIN_NUMBERS = (
    24, 60, 365, 3600, 86400,
    200, 201, 204, 301, 302, 304, 400, 401, 403, 404, 409, 429, 500, 502, 503,
    80, 443, 3000, 5000, 8000, 8080, 8443, 9000,
    0, 1, -1, 2, 3, 10, 100, 1000, 1024, 493, 420, 511, 1200, 10000, 30000, 60000, 256, 512, 8192,
)
#: Decimals with separators, fraction and exponent, and hexadecimal, octal and binary literals; a big integer is another kind.
NUMBER = r"(?:^|[^\w.$])(0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|\d[\d_]*(?:\.[\d_]+)?(?:[eE][+-]?\d+)?)\b"
# A number of two characters or more: no other one is above 50.
HAS_NUMBER = r"\d[\w]"
NAMED_CONTEXT = r"^\s*(?:export\s+)?const\b|^\s*[A-Z][A-Z0-9_]*\s*=\s*\d|^\s*['\"]?[\w$ -]+['\"]?\s*:\s*-?[\d.]+\s*,?\s*$"


def number_value(literal: Column) -> Column:
    """The value of a literal in any notation."""
    bare = F.replace(literal, F.lit("_"), F.lit(""))
    based = lambda base: F.conv(F.substr(bare, F.lit(3)), base, 10).cast("double")
    return (
        F.when(bare.rlike("^0[xX]"), based(16)).when(bare.rlike("^0[oO]"), based(8)).when(bare.rlike("^0[bB]"), based(2))
        .otherwise(bare.try_cast("double"))
    )


def magic_number_hits() -> Column:
    """Numeric literals above 50 outside constants, enum members, object literals and tests."""
    plain = lambda v: (
        v.isin(*[float(n) for n in PLAIN_NUMBERS])
        | ((v >= 100) & (v < 1000) & (v % 100 == 0))
        | ((v >= 1000) & (v < 10000) & (v % 1000 == 0))
        | ((v <= 100) & (v == F.floor(v)))
    )
    kept = F.filter("numbers", lambda m: let(number_value(m["name"]), lambda v: (v > 50) & ~plain(v)))

    def of(m: Column) -> Column:
        return issue_struct(
            rule_id="style-magic-number", line_start=m["line"], col_start=m["column"],
            col_end=m["column"] + F.length(m["name"]), title="Magic number detected",
            description=F.concat(F.lit("Name the literal "), m["name"], F.lit(".")), category="maintainability",
            severity="INFO", confidence=50, code_snippet=m["name"],
        )

    return F.when(daemon_context(F.col("path")) != "test", F.transform(kept, of))


# ------------------------------------------------------------------ the frame
def _found(pattern: str, when: Column | None = None):
    found = lambda: match_offsets("code", pattern, 0, 1)
    return found() if when is None else F.when(when, found())


# rule group -> (columns pinned for it, its issues); ``funcs`` and ``measures`` come from the block pass
GROUPS = {
    "complexity": (("measures",), complexity_hits),
    "loops": (("loops", "loop_found"), loop_hits),
    "nested-loops": (("loops",), nested_loop_hits),
    "missing-await": (("funcs", "async_found"), missing_await_hits),
    "conditional-hooks": (("ifs", "hook_found", "parens"), conditional_hook_hits),
    "effects": (("parens",), effect_hits),
    "missing-keys": (("parens",), missing_key_hits),
    "unused": (("declared", "unused"), unused_hits),
    "unused-imports": (("imported",), unused_import_hits),
    "magic-numbers": (("numbers",), magic_number_hits),
}
#: rule groups that ask for the line, column or text at an offset of the code
_PLACED_GROUPS = set(GROUPS) - {"complexity", "magic-numbers"}
#: rule group -> what the code of every file with an issue of it holds: one look at the file before its lines are taken apart
MAY_HIT = {
    "loops": lambda code: code.rlike(LOOP) & code.rlike("|".join(p for _, _, _, p, _ in LOOP_PATTERNS)),
    "nested-loops": lambda code: F.regexp_count(code, F.lit(LOOP)) > 1,
    "missing-await": lambda code: code.contains("async") & code.rlike(ASYNC_CALL),
    "conditional-hooks": lambda code: _is_react() & code.rlike(HOOK_CALL),
    "effects": lambda code: _is_react() & code.contains("useEffect"),
    "missing-keys": lambda code: _is_react() & code.contains(".map") & code.contains("<"),
    "magic-numbers": lambda code: code.rlike(HAS_NUMBER),
}
_BLOCK_COLUMNS = {"measures", "loops", "loop_found", "funcs", "ifs", "async_found"}


def with_script_hits(
    coded: DataFrame, groups: Sequence[str], thresholds: dict | None = None, complexity: Sequence[str] = tuple(COMPLEXITY)
) -> tuple[DataFrame, list[Column]]:
    """``coded(project_id, path, content, ext, code)`` with all columns that ``groups`` read, and an array of issues per group.

    Files whose ``code`` is empty give none. ``complexity`` names the rules of that group.
    """
    needs = {c for g in groups for c in GROUPS[g][0]}
    # Brackets are matched only in files that may have an issue of a group that asks for them.
    bracketed = [MAY_HIT[g](F.col("code")) if g in MAY_HIT else F.lit(True) for g in groups if "parens" in GROUPS[g][0]]
    spans = F.coalesce(reduce(or_, bracketed), F.lit(False)) if bracketed else False
    if needs & _BLOCK_COLUMNS:
        measures = [m for rule in complexity for m in COMPLEXITY[rule][0]]
        kinds = {"function", "method", *[k for m in measures for k in MEASURES[m]]} if set(groups) == {"complexity"} else KINDS
        counted = "measures" in needs and "params" in complexity
        base = with_blocks(
            coded, nested=counted, spans=spans, kinds=tuple(kinds), bare=set(groups) == {"complexity"} and not counted)
    else:
        base = pin(coded, lines=F.split("code", "\n", -1))
        if bracketed:
            base = with_nested(base, spans)
    if _PLACED_GROUPS & set(groups):
        raw = F.when(F.col("code") != "", F.split("content", "\n", -1)).otherwise(F.array().cast("array<string>"))
        base = pin(base, raw_lines=raw, line_starts=line_starts("lines"))
    if "measures" in needs:
        base = with_measures(base, measures)
    elif "funcs" in needs:
        base = pin(base, funcs=of_kind("function", "method"))
    first = {
        "loops": lambda: of_kind("loop"),
        "ifs": lambda: of_kind("if"),
        "loop_found": loop_found,
        "async_found": lambda: _found(ASYNC_CALL, F.exists("funcs", lambda f: f["is_async"])),
        "hook_found": lambda: _found(HOOK_CALL, _is_react()),
        "declared": lambda: _found(DECLARED),
        "imported": lambda: _found(IMPORT),
        "numbers": lambda: line_matches("lines", NUMBER, 1, HAS_NUMBER, NAMED_CONTEXT),
    }
    pins = {name: make() for name, make in first.items() if name in needs}
    if pins:
        base = pin(base, **pins)
    base = with_depths(base, **{name: (name, 0) for name in ("loops", "ifs") if name in needs})
    if "unused" in needs:
        base = pin(base, unused=unused_names())
    return base, [GROUPS[g][1](thresholds or {}, complexity) if g == "complexity" else GROUPS[g][1]() for g in groups]


def every(hits: Sequence[Column]) -> Column:
    """All arrays of issues as one; a missing one counts as empty."""
    filled = [F.coalesce(h, F.array().cast(ISSUES)) for h in hits]
    return F.concat(*filled) if len(filled) > 1 else filled[0]


def exploded(base: DataFrame, hits: Sequence[Column]) -> DataFrame:
    """One row per issue of the arrays ``hits`` over the file rows ``base``."""
    return base.select("project_id", F.col("path").alias("file_path"), F.explode(every(hits)).alias("i")).select(
        "project_id", "file_path", "i.*"
    )


def _may_hit(code: Column, group: str, thresholds: dict, complexity: Sequence[str]) -> Column | None:
    """What the code of every file with an issue of the group holds; None where any file may have one."""
    if group == "complexity":
        limits = {**DEFAULT_THRESHOLDS, **thresholds}
        return reduce(or_, [COMPLEXITY[rule][1](code, limits) for rule in complexity])
    return MAY_HIT[group](code) if group in MAY_HIT else None


def script_issues(
    files: DataFrame, groups: Sequence[str] = tuple(GROUPS), thresholds: dict | None = None, complexity: Sequence[str] = tuple(COMPLEXITY)
) -> DataFrame:
    """Issues of the given rule groups over script files, in one pass; of the group ``complexity`` those of the rules it names."""
    picked = files.select("project_id", "path", "content", dot_extension(F.col("path")).alias("ext"))
    alone = tuple(complexity) if set(groups) == {"complexity"} else ()
    code = blank_code(F.col("content"))
    if alone:
        # Blanking adds no character: what the code holds, the text holds.
        may = may_hold_functions(F.col("content"))
        code = F.when(may & _may_hit(F.col("content"), "complexity", thresholds or {}, alone) if set(alone) <= COUNTED else may, code)
    coded = pin(picked.where(F.col("ext").isin(*["." + e for e in JS])), code=code)
    looks = [_may_hit(F.col("code"), g, thresholds or {}, complexity) for g in groups]
    if alone:
        coded = coded.where(may_hold_functions(F.col("code")))
    if all(look is not None for look in looks) and alone != ("cognitive",):
        coded = coded.where(reduce(or_, looks))
    if len(alone) == 1 and alone[0] in _CANDIDATES:
        found = _CANDIDATES[alone[0]](coded, {**DEFAULT_THRESHOLDS, **(thresholds or {})})
        return exploded(with_measures(found, COMPLEXITY[alone[0]][0]), [complexity_hits(thresholds or {}, alone)])
    return exploded(*with_script_hits(coded, groups, thresholds, complexity))


def _with_long_functions(coded: DataFrame, limit: int) -> DataFrame:
    found = with_blocks(coded, kinds=("function", "method"), bare=True, least=limit + 1)
    return found.where(F.exists("blocks", lambda b: b["line_end"] - b["line_start"] > limit))


#: rule of the ``complexity`` group -> the files and blocks that an issue of it needs when it is asked for alone
_CANDIDATES = {
    "params": lambda coded, t: with_many_parameters(coded, t["max_params"]),
    "func-length": lambda coded, t: _with_long_functions(coded, t["max_function_length"]),
    "cognitive": lambda coded, t: with_cognitive_candidates(coded, t["max_cognitive"]),
}


ISSUES = "array<struct<" + ",".join(
    f"{n}:{'int' if n in _NUMERIC else 'string'}" for n in _OWN
) + ">>"


def long_function_hits(limit: int = 50) -> Column:
    """The web profile's function-length rule over the ``blocks`` of a frame."""
    size = lambda b: b["line_end"] - b["line_start"]

    def of(b: Column) -> Column:
        long, shown = size(b) > 2 * limit, size(b).cast("string")
        return issue_struct(
            rule_id="long-func", line_start=b["line_start"], line_end=b["line_end"],
            title=F.concat(F.lit("Function '"), b["name"], F.lit("' is "), shown, F.lit(" lines long")),
            description=F.concat(F.lit("The function spans "), shown, F.lit(" lines; split it.")),
            category="maintainability", severity=F.when(long, "CRITICAL").otherwise("MAJOR"), confidence=85,
            impact=F.when(long, 75).otherwise(50), code_snippet=b["name"], engine="regex",
        )

    return F.transform(F.filter(of_kind("function"), lambda b: size(b) > limit), of)


def long_function_issues(files: DataFrame, limit: int = 50) -> DataFrame:
    return exploded(structure(files, WEB_JS), [long_function_hits(limit)])


# ------------------------------------------------------------------ repeated literals
REPEATED_LANGUAGES = ("javascript", "typescript", "python", "java", "csharp", "go")
DECLARATION_LINE = r"^\s*(const|let|var|enum|interface|type)\b"
CONFIG_LINE = r"(?i)(timeout|max|min|limit|threshold|port|size|width|height|delay|interval|confidence|impact)"
# What every long literal holds, as one short test before the long ones.
MAY_BE_LONG = r"\d(?:\d\d|\.\d)"
LONG_LITERAL = r"(?<![\w.])(-?\d{3,}|\d+\.\d+)(?![\w.])"


def may_repeat_literals() -> Column:
    return language_of(F.col("path")).isin(*REPEATED_LANGUAGES)


def with_literals(base: DataFrame, when: Column) -> DataFrame:
    """``base(path, content)`` with ``per_line``, the long literals of each line that may hold magic numbers, and ``repeated``.

    Both are empty where ``when`` does not hold.
    """
    values = lambda x: F.filter(
        F.regexp_extract_all(x, F.lit(LONG_LITERAL), F.lit(1)), lambda v: ~v.isin("-1", "0", "1", "2", "100")
    )
    per_line = F.transform(
        F.split("content", "\n", -1),
        lambda x, i: F.struct(
            i.alias("line"),
            x.alias("text"),
            F.when(x.rlike(MAY_BE_LONG) & ~x.rlike(DECLARATION_LINE) & ~x.rlike(CONFIG_LINE), values(x))
            .otherwise(F.array().cast("array<string>"))
            .alias("found"),
        ),
    )
    found = F.when(when, F.filter(per_line, lambda l: F.size(l["found"]) > 0))
    base = pin(base, per_line=F.coalesce(found, F.array().cast("array<struct<line:int,text:string,found:array<string>>>")))
    everything = F.array_sort(F.flatten(F.transform("per_line", lambda l: l["found"])))
    repeated = let(
        everything,
        lambda a: F.array_distinct(F.filter(a, lambda v, i: (i > 0) & (F.get(a, i - 1) == v))),
    )
    return pin(base, repeated=repeated)


def literal_lines(files: DataFrame) -> DataFrame:
    base = files.select("project_id", "path", "content").where(may_repeat_literals())
    return with_literals(base, F.lit(True)).select("project_id", "path", "per_line", "repeated")


def repeated_literals(files: DataFrame) -> DataFrame:
    """How often each long literal occurs in its file (values seen at least twice)."""
    base = pin(literal_lines(files), every=F.array_sort(F.flatten(F.transform("per_line", lambda l: l["found"]))))
    # Equal values stand together: a run reaches to the start of the next one.
    begins = F.filter(F.transform("every", lambda v, i: F.when((i == 0) | (F.get("every", i - 1) != v), i)), lambda i: i.isNotNull())
    base = pin(base.where(F.size("every") > 1), begins=F.concat(begins, F.array(F.size("every"))))
    runs = F.transform(F.slice("begins", F.lit(1), F.size("begins") - 1), lambda at, k: F.struct(
        F.get("every", at).alias("value"), (F.get("begins", k + 1) - at).alias("occurrences")))
    counted = F.filter(runs, lambda c: c["occurrences"] > 1)
    return base.select("project_id", F.col("path").alias("file_path"), F.explode(counted).alias("c")).select(
        "project_id", "file_path", "c.value", "c.occurrences"
    )


def repeated_number_hits() -> Column:
    """The web profile's magic-number rule over a frame :func:`with_literals`: lines holding a literal the file repeats."""
    flagged = F.filter("per_line", lambda l: F.arrays_overlap(l["found"], F.col("repeated")))
    return F.when(F.size("repeated") > 0, F.transform(
        flagged,
        lambda l: issue_struct(
            rule_id="smell-magic-number", line_start=l["line"], title="Magic number in code",
            description="The literal is repeated; name it once.", category="code-smell", severity="INFO",
            confidence=55, impact=20, code_snippet=trimmed(l["text"]), engine="regex",
        ),
    ))


def repeated_number_issues(files: DataFrame) -> DataFrame:
    return exploded(literal_lines(files), [repeated_number_hits()])


# ------------------------------------------------------------------ documents
LINK = r"\[([^\]]*)\]\(([^)]*)\)"


def broken_anchor_hits() -> Column:
    """Links to anchors that no heading of the document carries, over a frame with ``lower``, the text in lower case."""
    links = F.flatten(
        F.transform(
            F.split("content", "\n", -1),
            lambda x, i: F.transform(
                F.filter(F.regexp_extract_all(x, F.lit(LINK), F.lit(0)), lambda m: m.contains("](#")),
                lambda m: F.struct(
                    i.alias("line"), x.alias("text"), m.alias("hit"), F.regexp_extract(m, LINK, 2).alias("url")
                ),
            ),
        )
    )
    broken = F.filter(
        links,
        lambda l: l["url"].startswith("#")
        & ~F.contains(F.col("lower"), F.concat(F.lit("# "), F.lower(F.substr(l["url"], F.lit(2))))),
    )
    at = lambda l: F.instr(l["text"], l["url"]) - 1
    return F.transform(
        broken,
        lambda l: issue_struct(
            rule_id="md-broken-anchor", line_start=l["line"], col_start=at(l),
            col_end=at(l) + F.length(l["url"]), title="Potentially broken anchor link",
            description=F.concat(F.lit("No heading carries the anchor "), l["url"]), category="bug",
            severity="INFO", confidence=50, code_snippet=l["hit"], engine="regex",
        ),
    )


def broken_anchor_issues(files: DataFrame) -> DataFrame:
    docs = files.select("project_id", "path", "content").where(family_of(F.col("path"), F.col("content")) == "markdown")
    return exploded(pin(docs, lower=F.lower(F.col("content"))), [broken_anchor_hits()])


def is_valid_json(text: Column) -> Column:
    """Strict JSON: the text parses as exactly one element of an array and as the value of a field.

    The parser stops at the end of the first value, so a bracket in the text could close either wrapper early, but
    none closes both.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", strict)
    field = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string, _bad string", {**strict, "columnNameOfCorruptRecord": "_bad"})
    return F.coalesce((F.size(listed) == 1) & field["_bad"].isNull(), F.lit(False))


def json_parse_hits() -> Column:
    return F.when(~is_valid_json(F.col("content")), F.array(issue_struct(
        rule_id="json-parse-error", line_start=0,
        title="Invalid JSON", description="The document does not parse.", category="bug", severity="CRITICAL",
        confidence=100, code_snippet=trimmed(F.substring_index("content", "\n", 1)), engine="regex",
    )))


def json_parse_issues(files: DataFrame) -> DataFrame:
    docs = files.select("project_id", "path", "content").where(family_of(F.col("path"), F.col("content")) == "json")
    return exploded(docs, [json_parse_hits()])


def is_large(content: Column) -> Column:
    return F.length(content) > LARGE_FILE_CHARS


def large_file_hits() -> Column:
    """A notice for a file above the size that makes an analysis slow; it is scanned all the same."""
    kilobytes = F.floor(F.length("content") / 1024 + 0.5).cast("string")
    return F.when(is_large(F.col("content")), F.array(issue_struct(
        rule_id="skip-large-file", line_start=0, title="File too large for analysis",
        description=F.concat(F.lit("The file has "), kilobytes, F.lit("KB; the limit is 200KB.")),
        category="maintainability", severity="INFO", confidence=100, impact=20, code_snippet="", engine="regex",
    )))


def large_file_issues(files: DataFrame) -> DataFrame:
    return exploded(files.select("project_id", "path", "content"), [large_file_hits()])

"""Brace-delimited blocks of script files, and the rules that need them.

Every value of a file (lines, depths, blocks, tokens) lives in arrays of its own row, so the
whole structural pass is narrow: no line of the corpus is shuffled to be counted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.bind import let, pin
from lintlake.functions.paths import dot_extension
from lintlake.functions.text import running_sums_sql
from lintlake.rules.lexer import blank_code
from lintlake.rules.nesting import nested_spans
from lintlake.rules.spec import JS
from lintlake.schema import constant

IDENT = r"[A-Za-z_$][\w$]*"
FUNCTION = (
    rf"\bfunction\s*\*?\s*({IDENT})"
    rf"|\b(?:const|let|var)\s+({IDENT})\s*(?::[^=]+)?=\s*(?:async\s+)?"
    r"(?:function\b|\([^)]*\)\s*(?::\s*[^=]+)?=>|[\w$]+\s*=>)"
)
METHOD = (
    r"^\s*(?:(?:public|private|protected|static|async|override|get|set)\s+)*+"
    rf"({IDENT})\s*(?:<[^>(]*>)?\([^)]*\)\s*(?::\s*[^{{]+)?\{{\s*$"
)
NOT_METHOD = r"^\s*(?:\}\s*)?(?:else\s+)?(?:if|for|while|switch|catch|function|return|do|try|with)\b"
LOOP = r"\bfor\s*(?:await\s*)?\(|\bwhile\s*\(|\bdo\s*\{"
LOOP_TAIL = r"^\s*\}\s*while\b"
IF = r"\bif\s*\("
SWITCH = r"\bswitch\s*\("
TRY = r"\btry\s*\{"
CATCH = r"\bcatch\b"
EFFECT = r"\buseEffect\s*\("
CLASS = rf"\bclass\s+({IDENT})"
INTERFACE = rf"\binterface\s+({IDENT})"
ENUM = rf"\benum\s+({IDENT})"
KINDS = {
    "function": FUNCTION, "method": METHOD, "loop": LOOP, "if": IF, "switch": SWITCH, "try": TRY, "catch": CATCH, "effect": EFFECT,
    "class": CLASS, "interface": INTERFACE, "enum": ENUM,
}
ANY_START = "|".join(KINDS.values())

# What every line that starts a block holds, as one short test before the long one.
MAY_START = r"\b(?:function|const|let|var|for|while|do|if|switch|try|catch|useEffect|class|interface|enum)\b|\{\s*$"

# The same for functions and methods alone.
MAY_FUNCTION = r"\b(?:function|const|let|var)\b|\{\s*$"
# Every parenthesis of the line ends on it and holds no bracket: it has one part more than commas at most.
CLOSED_PARENS = r"^[^()]*+(?:\([^()\[\]{}]*+\)[^()]*+)*+$"

BARE_ARROW = r"=\s*(?:async\s+)?[\w$]+\s*=>"

BRANCHES = r"\b(?:if|for|while|catch|case)\b|&&|\|\||\?\?|\?[^.:?]"
CONTROL = r"\b(?:if|for|while|catch|switch)\b|\?\?|\?[^.:?]"
NULLISH = r"\?\?"
LOGICAL = r"&&|\|\|"
# Lines without any of these count nothing.
MAY_BRANCH = r"[&|?]|\b(?:if|for|while|catch|case|switch)\b"
# Starts of what nests, one word for every block.
NESTING = r"\b(?:if|for|while|do|switch|try|catch)\b"
# A line with one opener and no other brace.
ONE_OPENER = r"^[^{}]*\{[^{}]*$"
# (closers, openers) that do not match within a line, of the braces most lines have; a longer row of braces is folded.
SHORT_BRACES = {"": (0, 0), "{": (0, 1), "}": (1, 0), "}{": (1, 1), "{}": (0, 0)}
# A parenthesis that ends on its line and holds no bracket, no arrow and no comma between angle brackets: its commas part parameters.
PLAIN_LIST = (
    r"^[^(]*\(((?:[\t\x20-\x7E&&[^()\[\]{}<>]]++|<[\t\x20-\x7E&&[^()\[\]{}<>,=]]*+>)*+)\)"
)


def first_where(array: Column | str, test: Callable[[Column], Column]) -> Column:
    """Index of the first element from which on ``test`` holds, the size if there is none: a binary search by halving steps."""
    values = F.col(array) if isinstance(array, str) else array
    rounds = F.greatest(F.ceil(F.log2(F.size(values) + 1)).cast("int"), F.lit(1))
    further = lambda at, step: F.when(at + step > F.size(values), at).when(test(F.get(values, at + step - 1)), at).otherwise(at + step)
    steps = constant([1 << k for k in range(30, -1, -1)], "array<int>")
    return F.aggregate(F.slice(steps, -rounds, rounds), F.lit(0), further)


def line_starts(lines: str) -> Column:
    """The offsets at which the lines of an array begin; pin it as ``line_starts``."""
    starts = F.concat(F.array(F.lit(0)), F.expr(running_sums_sql(f"transform({lines}, x -> length(x) + 1)")))
    return F.slice(starts, F.lit(1), F.size(lines))


def line_at(offset: Column) -> Column:
    """The line of an offset, by binary search in ``line_starts``."""
    return first_where("line_starts", lambda s: s > offset) - 1


def with_depths(base: DataFrame, **blocks: tuple[str, int]) -> DataFrame:
    """Pin for each ``name=(array of blocks, shift)`` what :func:`depth_at` needs.

    A difference array in sorted form: +1 where a block begins (``shift`` lines after its start), -1 after its end, and the
    running sums of these steps.
    """
    def events(array: str, shift: int) -> Column:
        begins = F.transform(array, lambda b: F.struct((b["line_start"] + shift).alias("at"), F.lit(1).alias("step")))
        ends = F.transform(array, lambda b: F.struct((b["line_end"] + 1).alias("at"), F.lit(-1).alias("step")))
        return F.sort_array(F.concat(begins, ends))

    if not blocks:
        return base
    base = pin(base, **{f"_{name}_at": events(*given) for name, given in blocks.items()})
    return pin(base, **{f"_{name}_sum": F.expr(running_sums_sql(f"transform(_{name}_at, e -> e.step)")) for name in blocks})


def depth_at(name: str, line: Column) -> Column:
    """How many blocks of a :func:`with_depths` array a line lies in."""
    passed = first_where(f"_{name}_at", lambda e: e["at"] > line)
    return let(passed, lambda k: F.when(k > 0, F.get(f"_{name}_sum", k - 1)).otherwise(0))


def without_depths(base: DataFrame, *names: str) -> DataFrame:
    return base.drop(*[f"_{n}_{part}" for n in names for part in ("at", "sum")])


def _net_braces(braces: Column) -> Column:
    """How many closers and openers of a line's braces do not match within it: the lowest depth below its start, and the rise from there."""
    step = lambda acc, b: let(
        acc["depth"] + F.when(b == "{", 1).when(b == "}", -1).otherwise(0),
        lambda d: F.struct(d.alias("depth"), F.least(acc["low"], d).alias("low")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))
    of = lambda closes, opens: F.struct(closes.alias("closes"), opens.alias("opens"))
    folded = F.aggregate(F.split(braces, ""), start, step, lambda acc: of(-acc["low"], acc["depth"] - acc["low"]))
    cases = [(braces == text, of(F.lit(c), F.lit(o))) for text, (c, o) in SHORT_BRACES.items()]
    return reduce(lambda known, case: known.when(*case), cases[1:], F.when(*cases[0])).otherwise(folded)


def _function_name(line: Column) -> Column:
    first = F.regexp_extract(line, FUNCTION, 1)
    return F.when(first != "", first).otherwise(F.regexp_extract(line, FUNCTION, 2))


def _parameter_count(line: Column) -> Column:
    inside = F.regexp_extract(line, r"\(([^()]*)\)", 1)
    return F.when(F.trim(inside) == "", 0).otherwise(F.size(F.split(inside, ",")))


def _starts(line: Column, i: Column, kinds: Sequence[str], bare: bool = False) -> Column:
    """The blocks of the given kinds that a line starts, outermost kind first; ``bare`` ones without what is not measured."""

    def start(kind: str, test: Column, name: Column = F.lit("")) -> Column:
        more = () if bare else (
            line.rlike(r"\basync\b").alias("is_async"), line.rlike(r"^\s*export\b").alias("exported"), _parameter_count(line).alias("params"))
        return F.when(test, F.struct(F.lit(kind).alias("kind"), name.alias("name"), i.alias("line_start"), *more))

    is_function = line.rlike(FUNCTION)
    tests = {
        "function": lambda: (is_function, _function_name(line)),
        "method": lambda: (~is_function & line.rlike(METHOD) & ~line.rlike(NOT_METHOD), F.regexp_extract(line, METHOD, 1)),
        "loop": lambda: (line.rlike(LOOP) & ~line.rlike(LOOP_TAIL),),
        **{kind: lambda p=KINDS[kind]: (line.rlike(p), F.regexp_extract(line, p, 1)) for kind in ("class", "interface", "enum")},
    }
    plain = lambda kind: lambda: (line.rlike(KINDS[kind]),)
    return F.array_compact(F.array(*[start(kind, *tests.get(kind, plain(kind))()) for kind in KINDS if kind in kinds]))


def _plain_parameters(b: Column) -> Column:
    """The parameters of a function are the parts of the first parenthesis after its keyword or name; null where only the stack can tell."""
    line = F.get("lines", b["line_start"])
    rest = F.when(b["kind"] == "function", F.substr(line, F.regexp_instr(line, F.lit(FUNCTION)))).otherwise(line)
    parts = lambda text: F.size(F.filter(F.split(F.regexp_extract(text, PLAIN_LIST, 1), ","), lambda p: p.rlike(r"\S")))
    count = let(rest, lambda text: F.when(line.rlike(BARE_ARROW), 1).when(~text.contains("("), 0).when(text.rlike(PLAIN_LIST), parts(text)))
    return F.when(b["kind"].isin("function", "method"), b.withField("params", count)).otherwise(b)


def _with_parameters(b: Column) -> Column:
    """The parameters that :func:`_plain_parameters` left open, on whatever line their parenthesis ends."""
    line = F.get("lines", b["line_start"])
    column = F.when(b["kind"] == "function", F.regexp_instr(line, F.lit(FUNCTION)) - 1).otherwise(0)
    first = F.get("parens", first_where(
        "parens", lambda g: (g["line"] > b["line_start"]) | ((g["line"] == b["line_start"]) & (g["col"] >= column))))
    count = F.when(first["line"] == b["line_start"], first["parts"]).otherwise(0)
    return F.when(b["params"].isNull(), b.withField("params", count)).otherwise(b)


def structure(files: DataFrame, exts: Sequence[str] = JS, nested: bool = False, kinds: Sequence[str] = tuple(KINDS)) -> DataFrame:
    """Script files with their blanked ``code``, its ``lines`` and the ``blocks`` of the given kinds found in them.

    With ``nested`` parameters are counted by matching brackets (:func:`~lintlake.rules.nesting.nested`) where a plain look at the line
    that starts a function cannot tell; else they are counted on that line.
    """
    picked = files.select("project_id", "path", "content", dot_extension(F.col("path")).alias("ext")).where(
        F.col("ext").isin(*["." + e for e in exts])
    )
    return with_blocks(pin(picked, code=blank_code(F.col("content"))), nested, kinds=kinds)


def with_blocks(
    coded: DataFrame, nested: bool = False, spans: bool | Column = False, kinds: Sequence[str] = tuple(KINDS), bare: bool = False, least: int = 0,
    braces: bool = False,
) -> DataFrame:
    """``coded(code)`` with its ``lines`` and ``blocks``, those of the given kinds; see :func:`structure`. Empty code has no blocks.

    Only lines that hold a brace or start a block are looked at. With ``spans`` also the ``parens`` and ``conditional`` of every file, or
    of those that hold a test.
    ``bare`` blocks, for measures other than parameters, hold their kind, name, depth and lines only. Blocks with fewer than ``least``
    lines of the file after their start may be left out. With ``braces`` also the ``marks``, ``after`` and ``closings`` that ends are found by.
    """
    lined = pin(coded, lines=F.split("code", "\n", -1), braces=F.split(F.regexp_replace("code", r"[^{}\n]+", ""), "\n", -1))
    any_start = "|".join(KINDS[kind] for kind in KINDS if kind in kinds)
    room = lambda i: (i + least < F.size("lines"),) if least else ()
    starts = lambda x, i: F.when(reduce(and_, (*room(i), x.rlike(MAY_START), x.rlike(any_start))), _starts(x, i, kinds, bare))
    looked = F.transform("lines", lambda x, i: F.struct(i.alias("line"), F.get("braces", i).alias("braces"), starts(x, i).alias("starts")))
    netted = lambda m: F.struct(m["line"].alias("line"), m["starts"].alias("starts"), _net_braces(m["braces"]).alias("net"))
    marked = pin(lined, marks=F.transform(F.filter(looked, lambda m: (m["braces"] != "") | m["starts"].isNotNull()), netted)).drop("braces")
    deep = pin(marked, after=F.expr(running_sums_sql("transform(marks, m -> m.net.opens - m.net.closes)")))
    base = lambda m, k: F.get("after", k) - m["net"]["opens"]
    # Every closing brace ends one level at its line: the end of a block is the first one of its level after its start.
    closing = lambda d, m: F.struct(d.alias("level"), m["line"].alias("line"))
    level = lambda m, k: F.when(m["net"]["closes"] == 1, F.array(closing(base(m, k), m))).when(m["net"]["closes"] > 1, F.transform(
        F.sequence(base(m, k), base(m, k) + m["net"]["closes"] - 1), lambda d: closing(d, m)))
    ends = F.flatten(F.array_compact(F.transform("marks", level)))
    closed = pin(deep, closings=F.sort_array(F.coalesce(ends, F.array().cast("array<struct<level:int,line:int>>"))))
    ended = lambda m, k: F.when(m["starts"].isNotNull(), let(F.struct(base(m, k).alias("depth"), (m["net"]["opens"] > 0).alias("opened")),
                                lambda at: F.transform(m["starts"], lambda s: _with_end(s, at["depth"], at["opened"], bare))))
    blocks = pin(closed, blocks=F.flatten(F.array_compact(F.transform("marks", ended))))
    if not braces:
        blocks = blocks.drop("marks", "after", "closings")
    asked, everywhere = isinstance(spans, Column), spans is True
    if not nested:
        return with_nested(blocks, spans if asked else None) if asked or everywhere else blocks
    plain = pin(blocks, plain=F.transform("blocks", _plain_parameters)).drop("blocks").withColumnRenamed("plain", "blocks")
    open_ended = F.exists("blocks", lambda b: b["kind"].isin("function", "method") & b["params"].isNull())
    deep = with_nested(plain, open_ended | spans if asked else F.lit(True) if everywhere else open_ended)
    counted = deep.withColumn("blocks", F.when(open_ended, F.transform("blocks", _with_parameters)).otherwise(F.col("blocks")))
    return counted if asked or everywhere else counted.drop("parens", "conditional")


def with_many_parameters(coded: DataFrame, limit: int) -> DataFrame:
    """``coded(code)`` of the files with a function of more than ``limit`` parameters, and those functions as ``blocks``.

    Parameters stand where a function starts: no brace is looked at, and its last line is given as its first one.
    """
    def may_have(x: Column) -> Column:
        if limit < 1:
            return F.lit(True)
        commas = F.length(x) - F.length(F.replace(x, F.lit(","), F.lit("")))
        return x.contains("(") & ((commas >= limit) | ~x.rlike(CLOSED_PARENS))

    kinds = ("function", "method")
    started = lambda x, i: F.when(
        may_have(x) & x.rlike(MAY_FUNCTION) & x.rlike(f"{FUNCTION}|{METHOD}"),
        F.transform(_starts(x, i, kinds, bare=True), lambda s: _plain_parameters(
            s.withField("line_end", s["line_start"]).withField("params", F.lit(None).cast("int")))))
    many = lambda b: b["params"].isNull() | (b["params"] > limit)
    lined = pin(coded, lines=F.split("code", "\n", -1))
    found = pin(lined, blocks=F.filter(F.flatten(F.array_compact(F.transform("lines", started))), many)).where(F.size("blocks") > 0)
    open_ended = F.exists("blocks", lambda b: b["params"].isNull())
    deep = with_nested(found, open_ended)
    counted = deep.withColumn("blocks", F.when(open_ended, F.transform("blocks", _with_parameters)).otherwise(F.col("blocks")))
    return counted.drop("parens", "conditional")


def with_nested(coded: DataFrame, when: Column | None = None) -> DataFrame:
    """``coded(code)`` with its ``parens`` and ``conditional`` spans; both are empty where ``when`` does not hold."""
    code = F.col("code") if when is None else F.when(when, F.col("code"))
    deep = coded.withColumn("_nested", nested_spans(code))
    return pin(deep, parens=F.col("_nested.parens"), conditional=F.col("_nested.conditional")).drop("_nested")


def _with_end(s: Column, depth: Column, opened: Column, bare: bool = False) -> Column:
    """Close a block at the first later line that falls back to the depth it started at.

    A block that opens no brace on its first line covers that line, or the next one for a
    loop or branch whose body is a single statement.
    """
    first, last = s["line_start"], F.size("lines") - 1
    line = F.get("lines", first)
    after = F.struct(depth.alias("level"), first.alias("line"))
    closing = F.get("closings", first_where("closings", lambda c: c > after))
    bodyless = s["kind"].isin("loop", "if") & ~line.contains("{")
    end = (
        F.when(opened & (closing["level"] == depth), closing["line"])
        .when(opened, last)
        .when(bodyless, F.least(first + 1, last))
        .otherwise(first)
    )
    more = lambda e: (F.lit(None).cast("int").alias("params"),) if bare else (
        s["is_async"].alias("is_async"), s["exported"].alias("exported"), s["params"].alias("params"), F.get("lines", e).alias("tail"))
    return let(
        end,
        lambda e: F.struct(
            s["kind"].alias("kind"),
            s["name"].alias("name"),
            s["line_start"].alias("line_start"),
            e.alias("line_end"),
            depth.alias("depth"),
            *more(e),
        ),
    )


def of_kind(*kinds: str) -> Column:
    return F.filter("blocks", lambda b: b["kind"].isin(*kinds))


def block_spans(files: DataFrame, *kinds: str, exts: Sequence[str] = JS) -> DataFrame:
    """One row per block of the given kinds."""
    return structure(files, exts, nested=True, kinds=kinds).select("project_id", "path", F.explode(of_kind(*kinds)).alias("b")).select(
        "project_id", "path", "b.kind", "b.name", "b.line_start", "b.line_end", "b.depth",
        "b.is_async", "b.exported", "b.params",
    )


def function_spans(files: DataFrame, exts: Sequence[str] = JS) -> DataFrame:
    return block_spans(files, "function", "method", exts=exts)


def loop_spans(files: DataFrame, exts: Sequence[str] = JS) -> DataFrame:
    return block_spans(files, "loop", exts=exts)


#: measure -> kinds of blocks that are read for it, besides the functions
MEASURES = {"cyclomatic": (), "cognitive": ("if", "loop", "switch", "catch"), "nesting": ("if", "loop", "switch", "try")}


_COUNTS = {
    "branches": lambda x: F.regexp_count(x, F.lit(BRANCHES)),
    "controls": lambda x: F.regexp_count(x, F.lit(CONTROL)) - F.regexp_count(x, F.lit(NULLISH)),
    "logical": lambda x: F.regexp_count(x, F.lit(LOGICAL)),
    "nesting": lambda x: F.regexp_count(x, F.lit(NESTING)),
}


def _counted(*names: str, may: str = MAY_BRANCH) -> Column:
    """What the lines count that hold any of it."""
    branching = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("line"), x.alias("text"))), lambda l: l["text"].rlike(may))
    return F.transform(branching, lambda l: F.struct(l["line"].alias("line"), *[_COUNTS[n](l["text"]).alias(n) for n in names]))


def _within(array: str, f: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of where the rows of ``array``, sorted by line, that lie in a function begin and how many they are."""
    bounds = F.struct(first_where(array, lambda x: x["line"] >= f["line_start"]).alias("a"),
                      first_where(array, lambda x: x["line"] > f["line_end"]).alias("b"))
    return let(bounds, lambda r: body(r["a"], r["b"] - r["a"]))


def with_cognitive_candidates(coded: DataFrame, limit: int) -> DataFrame:
    """``coded(code)`` of the files with a function whose cognitive complexity may be above ``limit``; ``blocks`` are those functions and what nests.

    A control counts once, and once more for every block around it that the function does not lie in itself: at most for every
    start of a block before it in the function. Only where this bound is above the limit are blocks looked for besides the functions.
    """
    functions = with_blocks(coded, kinds=("function", "method"), bare=True, braces=True).where(F.size("blocks") > 0)
    counted = pin(functions, counts=_counted("controls", "logical", "nesting", may=rf"{MAY_BRANCH}|{NESTING}"))
    step = lambda acc, l: F.struct(
        (acc["sum"] + l["logical"] + F.greatest(l["controls"], F.lit(0)) * (1 + acc["around"])).alias("sum"),
        (acc["around"] + l["nesting"]).alias("around"))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("around"))
    bound = lambda f: _within("counts", f, lambda first, n: F.aggregate(F.slice("counts", first + 1, n), start, step, lambda acc: acc["sum"]))
    picked = pin(counted, picked=F.filter("blocks", lambda f: bound(f) > limit)).where(F.size("picked") > 0)

    def nests(l: Column) -> Column:
        k = first_where("marks", lambda m: m["line"] >= l["line"])
        at = let(k, lambda k: F.struct(F.get("marks", k).alias("mark"), F.get("after", k).alias("after")))
        starts = lambda: _starts(F.get("lines", l["line"]), l["line"], MEASURES["cognitive"], bare=True)

        def ended(at: Column) -> Column:
            opened = (at["mark"]["line"] == l["line"]) & (at["mark"]["net"]["opens"] > 0)
            place = F.struct((at["after"] - at["mark"]["net"]["opens"]).alias("depth"), F.coalesce(opened, F.lit(False)).alias("opened"))
            return let(place, lambda p: F.transform(starts(), lambda s: _with_end(s, p["depth"], p["opened"], bare=True)))

        return let(at, ended)

    nested = pin(picked, nests=F.flatten(F.transform(F.filter("counts", lambda l: l["nesting"] > 0), nests)))
    whole = nested.withColumn("blocks", F.concat("picked", "nests"))
    return whole.drop("picked", "nests", "counts", "marks", "after", "closings")


def with_measures(base: DataFrame, wanted: Sequence[str] = tuple(MEASURES)) -> DataFrame:
    """Add ``funcs`` and, per function, its ``measures``: size, parameters, and of the complexities and the nesting those ``wanted``.

    Only lines that hold a branch are counted: those of a function are a slice.
    """
    base = pin(base, funcs=of_kind("function", "method"))
    summed = {"cyclomatic", "cognitive"} & set(wanted)
    pins = {}
    if summed:
        pins["busy"] = F.when(F.size("funcs") > 0, _counted("branches", "controls", "logical"))
    if "cognitive" in wanted:
        pins["nest"] = of_kind(*MEASURES["cognitive"])
    if "nesting" in wanted:
        pins["deep"] = of_kind(*MEASURES["nesting"])
    depths = {name: (name, 1) for name in ("nest", "deep") if name in pins}
    base = with_depths(pin(base, **pins) if pins else base, **depths)
    levels = {}
    if "cognitive" in wanted:
        levels["busy_depth"] = F.transform("busy", lambda l: F.when(l["controls"] != 0, depth_at("nest", l["line"])).otherwise(0))
        levels["start_depth"] = F.transform("funcs", lambda f: depth_at("nest", f["line_start"]))
    if "nesting" in wanted:
        levels["start_level"] = F.transform("funcs", lambda f: depth_at("deep", f["line_start"]))
        levels["deep_levels"] = F.transform(
            "deep", lambda d: F.struct(d["line_start"].alias("line"), (depth_at("deep", d["line_start"]) + 1).alias("level")))
    base = pin(base, **levels) if levels else base

    def sums(f: Column, k: Column) -> Column:
        def of(first: Column, n: Column) -> Column:
            own = F.slice("busy", first + 1, n)
            cyclomatic = F.aggregate(own, F.lit(1), lambda acc, l: acc + l["branches"]) if "cyclomatic" in wanted else F.lit(None).cast("int")
            if "cognitive" not in wanted:
                return F.struct(cyclomatic.alias("cyclomatic"), F.lit(None).cast("int").alias("cognitive"))
            weights = F.zip_with(own, F.slice("busy_depth", first + 1, n), lambda l, d: l["logical"]
                                 + l["controls"] * (1 + F.greatest(d - F.get("start_depth", k), F.lit(0))))
            cognitive = F.aggregate(weights, F.lit(0), lambda acc, n: acc + n)
            return F.struct(cyclomatic.alias("cyclomatic"), cognitive.alias("cognitive"))

        return _within("busy", f, of)

    def measure(f: Column, k: Column) -> Column:
        # Blocks stand in the order of their lines.
        deepest = lambda first, n: F.array_max(F.transform(F.slice("deep_levels", first + 1, n), lambda d: d["level"]))
        nothing = F.lit(None).cast("int")
        nesting = F.coalesce(_within("deep_levels", f, deepest) - F.get("start_level", k), F.lit(0)) if "nesting" in wanted else nothing
        row = lambda cyclomatic, cognitive: F.struct(
            f["kind"].alias("kind"),
            f["name"].alias("name"),
            f["line_start"].alias("line_start"),
            f["line_end"].alias("line_end"),
            f["params"].alias("params"),
            (f["line_end"] - f["line_start"]).alias("length"),
            cyclomatic.alias("cyclomatic"),
            cognitive.alias("cognitive"),
            nesting.alias("nesting"),
        )
        return let(sums(f, k), lambda s: row(s["cyclomatic"], s["cognitive"])) if summed else row(nothing, nothing)

    return without_depths(pin(base, measures=F.transform("funcs", measure)), *depths).drop(*pins, *levels)


def function_metrics(files: DataFrame, exts: Sequence[str] = JS) -> DataFrame:
    """Per function: length, parameters, cyclomatic and cognitive complexity, deepest nesting."""
    base = with_measures(structure(files, exts, nested=True))
    return base.select("project_id", "path", F.explode("measures").alias("m")).select("project_id", "path", "m.*")

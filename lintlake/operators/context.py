"""Relations between files, issues and suggestions: imports, related files, fix context, prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lintlake.functions.bind import pin
from lintlake.functions.paths import collapse_dots, dirname
from lintlake.functions.text import capitalize, extract_quoted
from lintlake.operators.views import valid_suggestion

# What a relative import may resolve to, in order.
CANDIDATE_SUFFIXES = (
    "", ".ts", ".tsx", ".js", ".jsx", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx",
)
CONTEXT_LINES = 15
BLOCK = 256
#: Rows whose texts are rendered or cut by the plan are larger than the planner thinks: these joins are never broadcast.
SORTED = "merge"


def resolve_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Relative imports with the file they resolve to; the first existing candidate wins.

    Candidates are exploded with their priority and joined by equality; the pick per import is a
    partial aggregate.
    """
    target = collapse_dots(F.concat_ws("/", dirname(F.col("path")), F.col("module")))
    options = F.array(
        *[
            F.struct(F.lit(i).alias("priority"), F.concat(F.col("_base"), F.lit(s)).alias("candidate"))
            for i, s in enumerate(CANDIDATE_SUFFIXES)
        ]
    )
    wanted = pin(imports.where(F.col("module").startswith(".")), _base=target)
    wanted = wanted.select("project_id", "path", "position", "module", F.explode(options).alias("o")).select(
        "project_id", "path", "position", "module", "o.*"
    )
    known = files.select("project_id", F.col("path").alias("candidate"))
    found = wanted.join(known.hint(SORTED), ["project_id", "candidate"])
    return found.groupBy("project_id", "path", "position", "module").agg(
        F.min_by("candidate", "priority").alias("resolved")
    )


def related_files(resolved: DataFrame, keep: int | None = None) -> DataFrame:
    """Related files per file with their rank: what it imports in order, then what imports it.

    ``keep`` bounds the rank; the bound goes below the shuffle, so a module imported everywhere sends few rows per task.
    """
    pairs = resolved.where("resolved <> path")
    forward = pairs.select("project_id", "path", F.col("resolved").alias("related"), F.lit(0).alias("side"),
                           F.col("position").cast("int").alias("place"), F.lit("").alias("name"))
    backward = pairs.select("project_id", F.col("resolved").alias("path"), F.col("path").alias("related"),
                            F.lit(1).alias("side"), F.lit(0).alias("place"), F.col("path").alias("name"))
    best = forward.unionByName(backward).groupBy("project_id", "path", "related").agg(
        F.min(F.struct("side", "place", "name")).alias("_r")
    )
    w = Window.partitionBy("project_id", "path").orderBy("_r", "related")
    ranked = best.withColumn("rank", F.row_number().over(w)).drop("_r")
    return ranked if keep is None else ranked.where(F.col("rank") <= keep)


def dependencies(imports: DataFrame) -> DataFrame:
    """Edges from files to the packages they import (relative imports are not dependencies)."""
    return imports.where(~F.col("module").startswith(".")).select("project_id", "path", "module").distinct()


def file_graph(resolved: DataFrame) -> DataFrame:
    """The edges ``(project_id, src, dst)`` between the files of a project: who imports whom, each pair once."""
    edges = resolved.where("resolved <> path").select("project_id", F.col("path").alias("src"), F.col("resolved").alias("dst"))
    return edges.distinct()


def file_degrees(edges: DataFrame) -> DataFrame:
    """Per file of the graph, how many files it imports (``dependencies``) and how many import it (``dependents``).

    An edge counts once for each end; both counts come from one aggregate with partial sums, so a file that is imported
    everywhere sends one row per task.
    """
    ends = F.explode(F.array(
        F.struct(F.col("src").alias("path"), F.lit(1).alias("out"), F.lit(0).alias("in")),
        F.struct(F.col("dst").alias("path"), F.lit(0).alias("out"), F.lit(1).alias("in"))))
    return edges.select("project_id", ends.alias("e")).groupBy("project_id", "e.path").agg(
        F.sum("e.out").alias("dependencies"), F.sum("e.in").alias("dependents"))


def neighbours(edges: DataFrame, files: DataFrame) -> DataFrame:
    """The files next to each of ``files(project_id, path)`` in the graph, with the ``side`` they stand on."""
    asked = files.select("project_id", "path").distinct()
    forward = edges.select("project_id", F.col("src").alias("path"), F.col("dst").alias("other"), F.lit("dependencies").alias("side"))
    backward = edges.select("project_id", F.col("dst").alias("path"), F.col("src").alias("other"), F.lit("dependents").alias("side"))
    return forward.unionByName(backward).join(asked, ["project_id", "path"])


def project_context(files: DataFrame, issues: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals per project: files, issues, files with issues, edges of the graph, files that no other file imports.

    Every part is an aggregate with partial sums; what is joined is one row a project.
    """
    of_files = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_files"))
    per_file = issues.groupBy("project_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    of_issues = per_file.groupBy("project_id").agg(F.sum("n").alias("total_issues"), F.count(F.lit(1)).alias("files_with_issues"))
    degrees = file_degrees(edges)
    of_graph = degrees.groupBy("project_id").agg(
        F.sum("dependencies").alias("n_edges"), F.max("dependents").alias("most_dependents"), F.count_if(F.col("dependents") > 0).alias("imported_files"))
    out = of_files.join(of_issues, "project_id", "left").join(of_graph, "project_id", "left")
    out = out.na.fill(0, ["total_issues", "files_with_issues", "n_edges", "most_dependents", "imported_files"])
    return out.withColumn("not_imported", F.col("n_files") - F.col("imported_files")).drop("imported_files")


def fix_context(files: DataFrame, issues: DataFrame, around: int = CONTEXT_LINES) -> DataFrame:
    """Numbered source lines around each issue.

    A file meets the list of its different windows once: its text is moved and split one time, however many windows
    it has, and the windows are cut inside its row before they become rows. The issues pick their window up by the same key.
    """
    keys = ["project_id", "file_path", "line_start", "line_end"]
    windows = issues.groupBy("project_id", "file_path").agg(F.collect_set(F.struct("line_start", "line_end")).alias("windows"))
    texts = files.select("project_id", F.col("path").alias("file_path"), "content")
    joined = pin(texts.join(windows.hint(SORTED), ["project_id", "file_path"]), lines=F.split("content", "\n", -1))

    def cut(w: Column) -> Column:
        first = F.greatest(w["line_start"] - around, F.lit(0))
        length = F.greatest(F.least(F.size("lines"), w["line_end"] + around) - first, F.lit(0))
        numbered = F.transform(
            F.slice("lines", first + 1, length), lambda x, i: F.concat((first + i + 1).cast("string"), F.lit(": "), x)
        )
        return F.struct(w["line_start"].alias("line_start"), w["line_end"].alias("line_end"), (first + 1).alias("first_line"),
                        F.array_join(numbered, "\n").alias("context"))

    cuts = joined.select("project_id", "file_path", F.explode(F.transform("windows", cut)).alias("w"))
    return issues.join(cuts.select("project_id", "file_path", "w.*").hint(SORTED), keys)


def _blocks(first: Column, last: Column) -> Column:
    return F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))


def issues_in_spans(issues: DataFrame, spans: DataFrame) -> DataFrame:
    """Each issue with every span around it, as an equality join on (file, line block) plus a range test.

    Spans are exploded to the blocks they touch, so the candidates of an issue are the spans of its
    own block and not all spans of a long file.
    """
    cut = spans.select(
        "project_id", F.col("path").alias("file_path"), "kind", "name", F.col("line_start").alias("span_start"),
        F.col("line_end").alias("span_end"), F.explode(_blocks(F.col("line_start"), F.col("line_end"))).alias("_block"),
    )
    keyed = issues.withColumn("_block", F.floor(F.col("line_start") / BLOCK))
    inside = (F.col("line_start") >= F.col("span_start")) & (F.col("line_start") <= F.col("span_end"))
    return keyed.join(cut.hint(SORTED), ["project_id", "file_path", "_block"]).where(inside).drop("_block")


# ------------------------------------------------------------------ suggestions
def suggestions_for(suggestions: DataFrame, issues: DataFrame) -> DataFrame:
    """Stored suggestions of a set of issues, with the file each belongs to."""
    return issues.select("issue_id", "file_path").join(suggestions, "issue_id")


def suggestion_cache_split(issues: DataFrame, suggestions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues with stored suggestions, issues still to serve)."""
    known = suggestions.select("issue_id").distinct()
    return issues.join(known, "issue_id", "left_semi"), issues.join(known, "issue_id", "left_anti")


# Ordered: a title that holds all words of an entry gets its guidance kind.
GUIDANCE = (
    ("too-long", (("too long",), ("function length",))),
    ("deep-nesting", (("deep nesting",), ("nesting depth",))),
    ("unused-variable", (("unused", "variable"),)),
    ("complexity", (("complexity",),)),
)
TITLES = {
    "too-long": ("Refactor '", "' into smaller functions"),
    "deep-nesting": ("Flatten nesting in '", "'"),
    "unused-variable": ("Remove or use '", "'"),
    "complexity": ("Reduce code complexity", ""),
}
HINTS = {
    "too-long": "Move validation, core logic and formatting into helpers that do one thing each.",
    "deep-nesting": "Return early, move inner logic into helpers, and replace nested loops by array methods.",
    "unused-variable": "Delete the declaration, start its name with an underscore, or use it.",
    "complexity": "Replace long conditionals by lookup tables, move branches into functions, return early.",
}
CATEGORY_GUIDANCE = {
    "bug": "Correct the logic, cover edge cases and missing values.",
    "code-smell": "Make it readable, remove dead code, follow the conventions.",
    "performance": "Avoid repeated work and choose better data structures.",
    "security": "Sanitise input, bind parameters, escape output, keep secrets out.",
    "maintainability": "Lower the complexity, improve names, extract functions.",
    "accessibility": "Add labels, keyboard access and text for images.",
    "best-practice": "Follow the conventions of the language and its tools.",
}


def guidance_kind(title: Column) -> Column:
    low = F.lower(title)
    out = None
    for kind, alternatives in GUIDANCE:
        test = None
        for words in alternatives:
            every = low.contains(words[0])
            for w in words[1:]:
                every = every & low.contains(w)
            test = every if test is None else test | every
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("other")


def fix_template(issues: DataFrame) -> DataFrame:
    """Manual guidance per issue: a title by ordered title patterns, a hint and tags."""
    kind = guidance_kind(F.col("title"))
    named = extract_quoted(F.col("title"), "targetFunction")
    variable = extract_quoted(F.col("title"), "variable")
    title, hint = None, None
    for k, (before, after) in TITLES.items():
        name = variable if k == "unused-variable" else named
        text = F.lit(before) if k == "complexity" else F.concat(F.lit(before), name, F.lit(after))
        title = F.when(kind == k, text) if title is None else title.when(kind == k, text)
        hint = F.when(kind == k, HINTS[k]) if hint is None else hint.when(kind == k, HINTS[k])
    return issues.withColumns(
        {
            "kind": kind,
            "fix_title": title.otherwise(F.concat(F.lit("Fix: "), F.col("title"))),
            "hint": hint.otherwise(F.concat(F.lit("A "), F.col("category"), F.lit(" issue: see its description."))),
            "helper": F.when(kind == "too-long", F.concat(F.lit("validate"), capitalize(named), F.lit("Input"))),
            "tags": F.array("category", "severity", F.lit("manual-guidance")),
        }
    )


def category_guidance(category: Column) -> Column:
    out = None
    for name, text in CATEGORY_GUIDANCE.items():
        out = F.when(category == name, text) if out is None else out.when(category == name, text)
    return out.otherwise("Address the reported problem in the style of the code around it.")


#: Characters of a file's text in one request; a longer text is asked about in parts.
PART_CHARS = 5000
#: Related files that a fix request names, and the characters of each that it shows.
RELATED_FILES, RELATED_CHARS = 2, 500


def analysis_request(files: DataFrame, symbols: DataFrame, imports: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Request texts for every file: its whole text in numbered parts, and with the first part its symbols and imports.

    A null text is one empty part. The parts are cut inside the file's row.
    """
    def listed(df: DataFrame, value: str, order: Sequence[str], name: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v"))))
        return df.groupBy("project_id", "path").agg(F.transform(items, lambda s: s["v"]).alias(name))

    names = listed(symbols, "name", ["line_start", "name", "kind"], "symbols")
    modules = listed(imports, "module", ["position"], "imports")
    keys = ["project_id", "path"]
    text = F.coalesce(F.col("content"), F.lit(""))
    last = F.greatest(F.expr(f"(length(content) - 1) div {part_chars}").cast("int"), F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), F.coalesce(last, F.lit(0))), lambda i: F.substr(text, i * part_chars + 1, F.lit(part_chars)))
    cut = files.select(*keys, parts.alias("parts"))
    cut = cut.select(*keys, F.size("parts").alias("parts"), F.posexplode("parts").alias("part", "code"))
    first = names.join(modules.hint(SORTED), keys, "full").withColumn("part", F.lit(0))
    joined = cut.join(first.hint(SORTED), [*keys, "part"], "left")
    none = F.array().cast("array<string>")
    request = F.to_json(
        F.struct(
            F.lit("analyze_code").alias("task"),
            F.struct(F.col("path"), (F.col("part") + 1).alias("part"), F.col("parts")).alias("file"),
            F.struct(F.coalesce("symbols", none).alias("symbols"), F.coalesce("imports", none).alias("imports")).alias(
                "context"
            ),
            F.col("code"),
        )
    )
    return joined.select(*keys, "part", request.alias("request"))


def related_heads(files: DataFrame, related: DataFrame, keep: int = RELATED_FILES, chars: int = RELATED_CHARS) -> DataFrame:
    """Per file ``related``: path and head of its nearest related files in order. ``related`` has ranks (:func:`related_files`)."""
    heads = files.select("project_id", F.col("path").alias("related"), F.substring("content", 1, chars).alias("head"))
    near = related.where(F.col("rank") <= keep).join(heads.hint(SORTED), ["project_id", "related"])
    items = F.array_sort(F.collect_list(F.struct("rank", F.struct(F.col("related").alias("path"), "head").alias("file"))))
    return near.groupBy("project_id", "path").agg(F.transform(items, lambda x: x["file"]).alias("related"))


def fix_prompt(contexts: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """A request text per issue from ``fix_context`` rows: details, snippet, numbered lines, related files and guidance.

    ``related`` comes from :func:`related_heads`; ``description``, ``confidence`` and ``code_snippet`` may be absent.
    """
    shape = "array<struct<path:string,head:string>>"
    if related is None:
        rows = contexts.withColumn("related", F.array().cast(shape))
    else:
        rows = contexts.join(related.withColumnRenamed("path", "file_path").hint(SORTED), ["project_id", "file_path"], "left").withColumn(
            "related", F.coalesce("related", F.array().cast(shape)))
    given = lambda name, kind="string": (F.col(name) if name in contexts.columns else F.lit(None)).cast(kind).alias(name)
    prompt = F.to_json(
        F.struct(
            F.lit("fix_issue").alias("task"),
            "issue_id", "title", given("description"), "category", "severity", given("confidence", "int"),
            F.col("file_path").alias("file"),
            F.format_string("%d-%d", F.col("line_start") + 1, F.col("line_end") + 1).alias("lines"),
            given("code_snippet"),
            F.col("context").alias("code"),
            "related",
            category_guidance(F.col("category")).alias("guidance"),
        )
    )
    return rows.select("project_id", "issue_id", prompt.alias("prompt"))


SUGGESTION = "struct<id:string,issueId:string,title:string,description:string,suggestedCode:string,confidence:int,impact:int>"
INVISIBLE = r"[\uFEFF\u200B-\u200D\u2060]"


def parse_fix_response(responses: DataFrame, text: str = "text") -> DataFrame:
    """Suggestions of model responses: a fenced, wrapped or bare JSON array or ``{"suggestions": []}``.

    Control characters and fences are stripped, the outermost array or object is taken, both shapes
    are parsed and incomplete suggestions dropped. Broken JSON gives no rows.
    """
    clean = F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    fenced = F.regexp_extract("_clean", r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    stripped = F.when(fenced != "", fenced).otherwise(F.col("_clean"))
    rows = pin(pin(responses, _clean=clean), _body=stripped)
    array = F.regexp_extract("_body", r"(?s)(\[.*\])", 1)
    wrapped = F.regexp_extract("_body", r"(?s)(\{.*\})", 1)
    found = F.coalesce(
        F.when(F.ltrim("_body").startswith("{"), F.from_json(wrapped, f"suggestions array<{SUGGESTION}>")["suggestions"]),
        F.from_json(array, f"array<{SUGGESTION}>"),
        F.from_json(wrapped, f"suggestions array<{SUGGESTION}>")["suggestions"],
    )
    out = rows.select(*responses.columns, F.explode(found).alias("s")).select(*responses.columns, "s.*")
    return out.where(valid_suggestion(F.col("id"), F.col("suggestedCode")))

"""End-to-end plans: scan a corpus, report its issues, score its projects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions.bind import pin
from lintlake.functions.paths import basename, dot_extension
from lintlake.operators import metrics, triage
from lintlake.rules import structural
from lintlake.rules.lexer import blank_code
from lintlake.rules.lines import family_of, line_issues
from lintlake.rules.matches import with_match_hits
from lintlake.rules.registry import FILE_TYPE_RULES, LEXICAL_RULES, STYLE_RULES, WEB_LINE_RULES, WEB_MATCH_RULES
from lintlake.rules.spans import with_blocks
from lintlake.rules.spec import JS, WEB_JS, MatchRule
from lintlake.schema import ISSUE_COLUMNS, severity_rank

# Files whose findings come from the static rules alone in the web profile.
STATIC_PRIMARY = (
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".sql", ".json", ".jsonc", ".yaml", ".yml", ".md", ".markdown",
    ".sh", ".bash", ".zsh",
)
# More than any engine has rules: the engines' ordinals follow each other.
_STRIDE = 1_000_000


def spread(files: DataFrame, factor: int = 2) -> DataFrame:
    """Spread a source of few large splits over the cores; sources with enough splits stay as they are.

    The scan is bound by CPU, so a corpus in one row group would otherwise run on one core. At scale the
    source has more splits than cores and nothing is shuffled. A stream has no splits before it runs: its batches are dealt out.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    if not files.isStreaming and files.rdd.getNumPartitions() >= cores:
        return files
    return files.repartition(cores * factor)


def is_static_primary(path: Column) -> Column:
    return dot_extension(path).isin(*STATIC_PRIMARY) & (F.lower(basename(path)) != "dockerfile")


#: Switches of the script rules: the groups of structural rules and the beginnings of rule ids that each one turns off.
SWITCHES = {
    "complexity": (("complexity",), ()),
    "dead-code": (("unused", "unused-imports"), ("unreachable",)),
    "security": ((), ("security-",)),
    "typescript": ((), ("ts-",)),
    "performance": (("loops", "nested-loops", "missing-await"), ("perf-", "async-")),
    "style": (("magic-numbers",), ("style-",)),
}
PROFILES = ("static", "regex", "web", "all")
#: Places of the parts in the order of findings.
_LINES, _LEXICAL, _STRUCTURAL, _LARGE, _WEB_MATCHES, _WEB_LINES, _WEB_STRUCTURAL, _USER = range(8)


def _at(part: int, hits: Column) -> Column:
    """Issues of a part: their ``ord`` follows those of all parts before it."""
    filled = F.coalesce(hits, F.array().cast(structural.ISSUES))
    return F.transform(filled, lambda i: i.withField("ord", (i["ord"] + part * _STRIDE).cast("int")))


def _on(rule_id: str, switches: dict) -> bool:
    return not any(rule_id.startswith(head) for name, (_, heads) in SWITCHES.items() if not switches.get(name, True) for head in heads)


def frame_issues(files: DataFrame, static: bool, web: Column | None, config: dict, switches: dict, user_rules: Sequence[MatchRule]) -> DataFrame:
    """Findings of all match and structural rules from one read: a file is one row, every rule an array of it, exploded once.

    ``static`` says whether the static rules run, ``web`` on which files those of the regex registry do (None: on none).
    """
    ext = F.col("ext")
    script = ext.isin(*["." + e for e in JS])
    lexical = [r for r in LEXICAL_RULES if _on(r.id, switches)] if static else []
    registry = list(WEB_MATCH_RULES) if web is not None else []
    rules = [*lexical, *registry, *user_rules]
    prepared = files.select("project_id", "path", "content", dot_extension(F.col("path")).alias("ext"))
    base = pin(prepared, web=F.lit(False) if web is None else F.coalesce(web, F.lit(False)), family=family_of(F.col("path"), F.col("content")))
    # Files that no part looks at leave before anything is computed for them.
    wanted = script | F.col("family").isin("markdown", "json") | F.col("web")
    for rule in user_rules:
        wanted = wanted | (ext.isin(*["." + e for e in rule.exts]) if rule.exts else F.lit(True))
    base = pin(base.where(F.coalesce(wanted, F.lit(False))), code=F.when(script, blank_code(F.col("content"))).otherwise(""))
    gates = [None] * len(lexical) + [F.col("web")] * len(registry) + [None] * len(user_rules)
    hits = []
    if rules:
        base, matched = with_match_hits(base, rules, gates)
        first, last = len(lexical), len(lexical) + len(registry)
        order = lambda i: F.when(i["ord"] < first, i["ord"] + _LEXICAL * _STRIDE).when(
            i["ord"] < last, i["ord"] - first + _WEB_MATCHES * _STRIDE).otherwise(i["ord"] - last + _USER * _STRIDE)
        hits.append(F.transform(matched, lambda i: i.withField("ord", order(i).cast("int"))))
    groups = [g for g in structural.GROUPS if not any(
        g in off for name, (off, _) in SWITCHES.items() if not switches.get(name, True))] if static else []
    if groups:
        base, found = structural.with_script_hits(base, groups, config)
        hits += [_at(_STRUCTURAL, h) for h in found]
    elif web is not None:
        base = with_blocks(base)
    if static:
        base = pin(base, lower=F.when(F.col("family") == "markdown", F.lower(F.col("content"))))
        hits.append(_at(_STRUCTURAL, F.when(F.col("family") == "markdown", structural.broken_anchor_hits())))
        hits.append(_at(_STRUCTURAL, F.when(F.col("family") == "json", structural.json_parse_hits())))
    if web is not None:
        if "blocks" not in base.columns:
            base = with_blocks(base)
        base = structural.with_literals(base, F.col("web") & structural.may_repeat_literals())
        hits.append(_at(_LARGE, F.when(F.col("web"), structural.large_file_hits())))
        long = F.col("web") & ext.isin(*["." + e for e in WEB_JS])
        hits.append(_at(_WEB_STRUCTURAL, F.when(long, structural.long_function_hits())))
        hits.append(_at(_WEB_STRUCTURAL, structural.repeated_number_hits()))
    return structural.exploded(base, hits).select(*ISSUE_COLUMNS)


def scan(files: DataFrame, profile: str = "static", config: dict | None = None, switches: dict | None = None,
         user_rules: Sequence[MatchRule] = ()) -> DataFrame:
    """All findings of ``files(project_id, path, content)`` with their ids, from two reads of the files at most.

    ``static`` runs the rules by file type, ``regex`` the regex registry, ``web`` both with the registry
    only where the static rules are not the primary source, ``all`` both everywhere. ``config`` may set ``max_line_length``
    and the thresholds of the per-function rules; ``switches`` turns kinds of script rules off (see ``SWITCHES``);
    ``user_rules`` (:func:`~lintlake.rules.matches.load_rules`) run besides the profile's own.
    """
    if profile not in PROFILES:
        raise ValueError("profile is static, regex, web or all")
    config, switches = dict(config or {}), dict(switches or {})
    if unknown := set(switches) - set(SWITCHES):
        raise ValueError(f"no such switch: {', '.join(sorted(unknown))}")
    length = config.pop("max_line_length", 120)
    static = profile != "regex"
    web = {"static": None, "regex": F.lit(True), "web": ~is_static_primary(F.col("path")), "all": F.lit(True)}[profile]
    own = [*FILE_TYPE_RULES, *(STYLE_RULES if switches.get("style", True) else ())] if static else []
    registry = list(WEB_LINE_RULES) if web is not None else []
    lines = line_issues(files, own + registry, length, web).select(*ISSUE_COLUMNS)
    place = F.when(F.col("ord") < len(own), F.col("ord")).otherwise(F.col("ord") - len(own) + _WEB_LINES * _STRIDE)
    found = lines.withColumn("ord", place.cast("int")).unionByName(frame_issues(files, static, web, config, switches, user_rules))
    return found.withColumn("issue_id", F.concat_ws("-", "rule_id", F.col("line_start").cast("string")))


FIRST = ("ord", "line_start", "col_start", "issue_id")
MERGE_ORDER = ("line_start", "col_start", "issue_id")


def report(files: DataFrame, profile: str = "static", config: dict | None = None, mode: str = "observed",
           overrides: DataFrame | None = None, suppressions: DataFrame | None = None,
           external: DataFrame | None = None, switches: dict | None = None, user_rules: Sequence[MatchRule] = (),
           sources: str = "both") -> DataFrame:
    """Findings as reported: suppressed, merged with external ones, deduplicated, remapped, overridden.

    ``sources`` is the analysis mode: with ``external`` only the findings of other tools are reported, with ``internal`` none
    of them.
    """
    issues = scan(files, profile, config, switches, user_rules)
    if sources == "internal":
        external = None
    elif sources == "external":
        if external is None:
            raise ValueError("the analysis mode external needs findings of other tools")
        issues = issues.limit(0)
    if suppressions is not None:
        issues = triage.suppress(issues, suppressions)
    if external is not None:
        columns = [c for c in issues.columns if c in external.columns]
        issues = triage.merge_sources(external.select(*columns), issues.select(*columns), MERGE_ORDER)
        issues = triage.dedupe_scan(issues, MERGE_ORDER)
    else:
        issues = triage.dedupe_scan(issues, FIRST)
    issues = triage.remap(issues, mode)
    return issues if overrides is None else triage.apply_rule_overrides(issues, overrides)


def project_health(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Per project: counts, the three scores and the debt, best projects first."""
    sizes = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("files_analyzed"))
    counted = metrics.project_metrics(issues, sizes).join(metrics.mean_score(issues, sizes), "project_id")
    return counted.withColumn("score_flat", metrics.flat_score()).orderBy(F.desc("score_mean"), "project_id")


def issue_priority_order() -> list[Column]:
    return [F.desc(triage.priority()), severity_rank(F.col("severity")), F.col("file_path"), F.col("line_start")]

"""Ingest operators: filtering, excluding, deduplicating and budgeting files; tool routing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from lintlake.functions.paths import (
    basename, dot_extension, glob_to_regex, ignore_regex, ingest_extension, is_traversal, normalize_path, slashes,
)

MAX_FILES = 200
MAX_FILE_BYTES = 500 * 1024
MAX_TOTAL_BYTES = 10 * 1024 * 1024

# What an upload accepts and what it leaves out.
SUPPORTED_EXTENSIONS = (
    "ts", "tsx", "js", "jsx", "py", "java", "cs", "go", "rs", "rb", "php", "cpp", "c", "h", "html", "css",
    "json", "yaml", "yml", "sql", "sh", "swift", "kt", "scala", "lua", "r", "m", "vue", "svelte", "astro",
    "md", "markdown", "bash",
)
EXCLUDED_SEGMENTS = (
    "node_modules/", ".git/", "vendor/", "dist/", "build/", "__pycache__/", ".next/", "coverage/", ".venv/", "venv/",
)
# What a folder watch accepts besides.
WATCHED_EXTENSIONS = (
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".pyw", ".pyx", ".pxd", ".pxi", ".java", ".cs", ".go",
    ".rs", ".rb", ".php", ".cpp", ".c", ".h", ".hpp", ".cc", ".cxx", ".swift", ".kt", ".kts", ".scala", ".html",
    ".htm", ".css", ".scss", ".sass", ".less", ".vue", ".svelte", ".astro", ".json", ".yaml", ".yml", ".toml",
    ".xml", ".md", ".mdx", ".markdown", ".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd", ".sql", ".graphql", ".gql",
    ".prisma",
)
WATCHED_CONFIG_EXTENSIONS = (".env", ".ini", ".cfg")
WATCHED_NAMES = (
    "dockerfile", "dockerfile.dev", "dockerfile.prod", "docker-compose.yml", "docker-compose.yaml", "compose.yml",
    "compose.yaml", ".dockerignore", "makefile", "rakefile", "gemfile", ".gitignore", ".eslintrc", ".prettierrc",
)
WATCHED_STREAM_NAMES = WATCHED_NAMES + (
    "procfile", ".babelrc", ".editorconfig", ".env.local", ".env.development", ".env.production",
)
SKIPPED_FOLDERS = (
    "node_modules", ".git", "dist", "build", "out", ".next", "__pycache__", ".venv", "venv", ".tox", ".pytest_cache",
)
DEFAULT_GLOBS = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**")
DEFAULT_IGNORES = ("node_modules", "dist", "build", ".next", "coverage", ".git")

# Which external tools look at which files.
_SEMGREP_ONLY = (
    ".go", ".rb", ".java", ".kt", ".scala", ".c", ".cpp", ".cc", ".h", ".hpp", ".cs", ".php", ".swift", ".rs",
    ".lua", ".r", ".sql", ".sh", ".bash",
)
TOOLS = {
    **{e: ("biome", "semgrep") for e in (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")},
    **{e: ("biome",) for e in (".json", ".jsonc")},
    **{e: ("ruff", "semgrep") for e in (".py", ".pyi", ".pyw")},
    **{e: ("tflint", "checkov") for e in (".tf", ".tfvars")},
    **{e: ("checkov",) for e in (".yaml", ".yml")},
    ".dockerfile": ("checkov", "semgrep"),
    **{e: ("semgrep",) for e in _SEMGREP_ONLY},
}
TOOLS_BY_NAME = {"Dockerfile": ("checkov", "semgrep")}


def normalized(files: DataFrame) -> DataFrame:
    """Files with clean paths; climbing paths are left out (see ``quarantined``)."""
    return files.where(~is_traversal(F.col("path"))).withColumn("path", normalize_path(F.col("path")))


def quarantined(files: DataFrame) -> DataFrame:
    return files.where(is_traversal(F.col("path")))


def in_excluded_folder(path: Column) -> Column:
    low = F.lower(normalize_path(path))
    return reduce(or_, [low.contains(s) for s in EXCLUDED_SEGMENTS])


def filter_supported(files: DataFrame, large_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files an upload keeps, those above ``large_bytes`` marked ``too_large``: whoever wants the size limit drops the marked.

    Path tests come first so that a scan can skip content.
    """
    return normalized(files).withColumn("too_large", F.col("size") > large_bytes).where(
        (F.col("size") > 0)
        & ingest_extension(F.col("path")).isin(*SUPPORTED_EXTENSIONS, "dockerfile")
        & ~in_excluded_folder(F.col("path"))
        & (F.coalesce(F.col("content"), F.lit("")) != "")
    )


def matches_any_glob(path: Column, globs: Sequence[str]) -> Column:
    """True where a path matches a glob; the globs become one alternation."""
    if not globs:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{glob_to_regex(g)})" for g in globs))


def is_ignored(path: Column, patterns: Sequence[str]) -> Column:
    """True where a path matches a project-config ignore entry."""
    if not patterns:
        return F.lit(False)
    return slashes(path).rlike("|".join(f"(?:{ignore_regex(p)})" for p in patterns))


def exclude_globs(files: DataFrame, globs: Sequence[str] = DEFAULT_GLOBS, ignores: Sequence[str] = ()) -> DataFrame:
    return files.where(~matches_any_glob(F.col("path"), globs) & ~is_ignored(F.col("path"), ignores))


def is_watched(path: Column, globs: Sequence[str] = DEFAULT_GLOBS, streaming: bool = False) -> Column:
    """Files a folder scan (or, with ``streaming``, a change watcher) takes up."""
    names = WATCHED_STREAM_NAMES if streaming else WATCHED_NAMES
    exts = WATCHED_EXTENSIONS + (WATCHED_CONFIG_EXTENSIONS if streaming else ())
    wanted = F.lower(basename(path)).isin(*names) | dot_extension(path).isin(*exts)
    return wanted & ~matches_any_glob(path, globs)


def discover(files: DataFrame, large_kilobytes: int = 500, globs: Sequence[str] = DEFAULT_GLOBS) -> DataFrame:
    """Workspace discovery: supported names outside skipped and hidden folders, those above the size limit marked ``too_large``."""
    folders = F.slice(F.split(slashes(F.col("path")), "/"), F.lit(1), F.size(F.split(slashes(F.col("path")), "/")) - 1)
    hidden = F.exists(folders, lambda f: f.isin(*SKIPPED_FOLDERS) | f.startswith("."))
    return files.where(is_watched(F.col("path"), globs) & ~hidden).withColumn(
        "too_large", F.col("size") > large_kilobytes * 1024)


def path_order() -> list[Column]:
    return [F.length("path"), F.col("path")]


def union_patterns(user: DataFrame, project: DataFrame) -> DataFrame:
    """The different ignore patterns of a user and a project (``pattern``)."""
    return user.select("pattern").unionByName(project.select("pattern")).distinct()


def dedupe_paths(files: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The first file of each project and path in the given order.

    The rank filter is applied on the map side first, so a path copied without bound sends at most
    one row per task into the shuffle.
    """
    w = Window.partitionBy("project_id", "path").orderBy(*order)
    return files.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def corpus_budget(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_TOTAL_BYTES) -> DataFrame:
    """All files, ``within_budget`` telling the first ones of a project in (path length, path) order until either limit is hit.

    Those have their ``position`` and ``running_bytes``. The number of files is ranked first: that bound is pushed below the
    shuffle, so the running size is summed over at most ``max_files`` rows per project however large the project is. ``path``
    must be unique in its project.
    """
    w = Window.partitionBy("project_id").orderBy(*path_order())
    ranked = files.select("project_id", "path", "size").withColumn("position", F.row_number().over(w)).where(F.col("position") <= max_files)
    running = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = ranked.withColumn("running_bytes", running).where(F.col("running_bytes") <= max_bytes).drop("size")
    return files.join(kept, ["project_id", "path"], "left").withColumn("within_budget", F.col("position").isNotNull())


def tool_routing(files: DataFrame, enabled: Sequence[str] | None = None) -> DataFrame:
    """One row per file and external tool that looks at it."""
    as_array = lambda tools: F.array(*[F.lit(x) for x in tools])

    def chain(table: dict, key: Column) -> Column:
        out = None
        for name, tools in table.items():
            out = F.when(key == name, as_array(tools)) if out is None else out.when(key == name, as_array(tools))
        return out

    tools = F.coalesce(chain(TOOLS_BY_NAME, basename(F.col("path"))), chain(TOOLS, dot_extension(F.col("path"))))
    rows = files.select("project_id", "path", F.explode(tools).alias("tool"))
    return rows.where(F.col("tool").isin(*enabled)) if enabled is not None else rows

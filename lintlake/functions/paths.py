"""Path functions: normalising, extensions, languages, labels, contexts, globs."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from lintlake.schema import lookup

# Extension -> language.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "py": "python", "java": "java", "cs": "csharp", "go": "go", "rs": "rust", "rb": "ruby",
    "php": "php", "cpp": "cpp", "c": "c", "h": "c", "hpp": "cpp", "swift": "swift",
    "kt": "kotlin", "scala": "scala", "html": "html", "css": "css", "scss": "scss",
    "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown", "sql": "sql",
    "sh": "shell", "bash": "shell", "vue": "vue", "svelte": "svelte", "astro": "astro",
    "mdx": "markdown",
}

# Extension (or bare name) -> label shown for a file type.
CATEGORY_LABELS = {
    ".ts": "TypeScript", ".tsx": "TypeScript (React)", ".js": "JavaScript", ".jsx": "JavaScript (React)",
    ".mjs": "JavaScript", ".cjs": "JavaScript", ".py": "Python", ".pyw": "Python", ".java": "Java",
    ".cs": "C#", ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".cpp": "C++", ".c": "C",
    ".h": "C/C++ Header", ".hpp": "C++ Header", ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala",
    ".html": "HTML", ".htm": "HTML", ".css": "CSS", ".scss": "SCSS", ".sass": "Sass", ".less": "Less",
    ".vue": "Vue", ".svelte": "Svelte", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML",
    ".toml": "TOML", ".xml": "XML", ".md": "Markdown", ".mdx": "MDX", ".sh": "Shell", ".bash": "Shell",
    ".ps1": "PowerShell", ".sql": "SQL", ".graphql": "GraphQL", "dockerfile": "Docker",
    ".dockerignore": "Docker",
}


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(slashes(path), "^/+", "")


def is_traversal(path: Column) -> Column:
    """True where a normalised path climbs out of its root."""
    norm = normalize_path(path)
    return norm.contains("../") | (norm == "..")


def basename(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(slashes(path), r"^(.*)/[^/]*$", 1)


def dot_extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty for names without one and for dot files."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def last_segment_extension(path: Column) -> Column:
    """Text after the last dot of the whole path, lower-cased; the whole path when there is no dot."""
    return F.lower(F.substring_index(path, ".", -1))


def ingest_extension(path: Column) -> Column:
    norm = F.lower(normalize_path(path))
    return F.when(norm.endswith("dockerfile"), "dockerfile").otherwise(F.substring_index(norm, ".", -1))


def language_of(path: Column) -> Column:
    ext = last_segment_extension(path)
    known = lookup(LANGUAGES, ext)
    return F.coalesce(known, F.when(ext != "", ext), F.lit("unknown"))


def file_category(path: Column) -> Column:
    """A readable label: the known one, else the extension in capitals, else ``Other``."""
    ext = dot_extension(path)
    key = F.when(ext != "", ext).otherwise(F.lower(basename(path)))
    fallback = F.upper(F.regexp_replace(key, r"^([^.]*)\.", "$1"))
    return F.coalesce(lookup(CATEGORY_LABELS, key), F.when(fallback != "", fallback), F.lit("Other"))


def web_context(path: Column) -> Column:
    p = F.lower(slashes(path))
    has = lambda *parts: reduce(or_, [p.contains(x) for x in parts])
    return (
        F.when(has("/web/src/", "/src/app/", "/src/components/"), "production-web")
        .when(has("/daemon/", "/services/"), "daemon-service")
        .when(has("/scripts/", "/webpack") | p.endswith(".config.js"), "build-script")
        .otherwise("general")
    )


def daemon_context(path: Column) -> Column:
    p = F.lower(slashes(path))
    has = lambda *parts: reduce(or_, [p.contains(x) for x in parts])
    return (
        F.when(has("/daemon/"), "daemon-service")
        .when(has("/scripts/", "/bin/"), "build-script")
        .when(has(".test.", ".spec.", "/__tests__/"), "test")
        .otherwise("production-web")
    )


def is_cli_script(path: Column) -> Column:
    return (
        slashes(path).contains("/scripts/") | path.endswith(".config.js") | path.endswith(".config.ts")
    )


def collapse_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a relative path inside its root."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(folded, "/")


def glob_to_regex(glob: str) -> str:
    """A path glob (``**``, ``*``, ``?``, ``{a,b}``) as one anchored regular expression."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def ignore_regex(pattern: str) -> str:
    """A project-config ignore entry: a star pattern spans folders, a bare name matches a whole segment."""
    if "*" in pattern:
        body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
        return f"^{body}$"
    return f"/{re.escape(pattern)}(?:/|$)"

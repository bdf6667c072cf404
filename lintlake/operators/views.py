"""Row-level views, filters and validation, and the ordered reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.schema import CATEGORIES, LOCATION, SEVERITIES, severity_rank


def normalize_severity(value: Column) -> Column:
    up = F.upper(value)
    return F.when(up.isin(*SEVERITIES), up).otherwise("INFO")


def normalize_category(value: Column) -> Column:
    return F.when(value.isin(*CATEGORIES), value).otherwise("code-smell")


def issue_nested(issues: DataFrame) -> DataFrame:
    """The flat store row with its position as a ``location`` struct and clean enums."""
    at = lambda line, column: F.struct(F.col(line).alias("line"), F.col(column).alias("column"))
    location = F.struct(
        F.col("file_path").alias("filePath"),
        F.struct(at("line_start", "col_start").alias("start"), at("line_end", "col_end").alias("end")).alias("range"),
    )
    return issues.withColumns(
        {
            "location": location,
            "category": normalize_category(F.col("category")),
            "severity": normalize_severity(F.col("severity")),
            "code_snippet": F.coalesce("code_snippet", F.lit("")),
        }
    ).drop("file_path", "line_start", "col_start", "line_end", "col_end")


def issue_flat(nested: DataFrame) -> DataFrame:
    r = "location.range."
    return nested.withColumns(
        {
            "file_path": F.col("location.filePath"),
            "line_start": F.col(r + "start.line"),
            "col_start": F.col(r + "start.column"),
            "line_end": F.col(r + "end.line"),
            "col_end": F.col(r + "end.column"),
        }
    ).drop("location")


def scan_metrics_view(scans: DataFrame) -> DataFrame:
    """JSON count maps of a stored scan as zero-filled columns."""
    sev = F.from_json("issues_by_severity", "map<string,int>")
    cat = F.from_json("issues_by_category", "map<string,int>")
    zero = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0))
    return scans.select(
        "scan_id",
        F.coalesce(F.col("overall_score").cast("double"), F.lit(0.0)).alias("overall_score"),
        *[zero(sev, s).alias(s.lower()) for s in SEVERITIES],
        *[zero(cat, c).alias(c.replace("-", "_")) for c in CATEGORIES],
    )


def scan_job_view(jobs: DataFrame) -> DataFrame:
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("files_discovered", "files_analyzed", "issue_count")}
    return jobs.withColumns(zero).withColumn(
        "error_message", F.when(F.col("error_message") != "", F.col("error_message"))
    )


def suggestion_view(suggestions: DataFrame) -> DataFrame:
    """Stored suggestions with defaults; ``tags`` (JSON text) keeps only its string members."""
    members = F.from_json("tags", "array<string>")
    raw = F.regexp_extract_all("tags", F.lit(r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'), F.lit(1))
    empty = F.lit(None).cast(LOCATION)
    location = F.coalesce(F.from_json("location", LOCATION), empty)
    return suggestions.withColumns(
        {
            **{c: F.coalesce(c, F.lit("")) for c in ("original_code", "suggested_code", "diff")},
            **{c: F.coalesce(c, F.lit(0)) for c in ("confidence", "impact")},
            "tags": F.coalesce(F.filter(members, lambda m: F.array_contains(raw, m)), F.array().cast("array<string>")),
            "location": location,
        }
    )


def search_issues(issues: DataFrame, text: str = "", severities: Sequence[str] = (), categories: Sequence[str] = (),
                  file_path: str | None = None) -> DataFrame:
    out = issues
    if text:
        q = text.lower()
        out = out.where(
            F.lower("title").contains(q) | F.lower("description").contains(q) | F.lower("file_path").contains(q)
        )
    if severities:
        out = out.where(F.col("severity").isin(*severities))
    if categories:
        out = out.where(F.col("category").isin(*categories))
    if file_path:
        out = out.where(F.col("file_path") == file_path)
    return out


def scan_issues_page(issues: DataFrame, scan_id: str, offset: int = 0, limit: int = 200,
                     severity: str | None = None, file_path: str | None = None) -> DataFrame:
    """One page of a scan in alphabetical severity order, as the store returns it."""
    out = issues.where(F.col("scan_id") == scan_id)
    if severity:
        out = out.where(F.col("severity") == severity)
    if file_path:
        out = out.where(F.col("file_path") == file_path)
    return out.orderBy("severity", "created_at", "issue_id").offset(offset).limit(limit)


def sort_issues(issues: DataFrame, by: str = "severity", order: str = "asc") -> DataFrame:
    """Severity by rank, category and file by name, date newest first; ``desc`` reverses."""
    keys = {
        "severity": (severity_rank(F.col("severity")), True),
        "category": (F.col("category"), True),
        "file": (F.col("file_path"), True),
        "date": (F.col("created_at"), False),
    }
    key, ascending = keys[by]
    ascending = ascending == (order == "asc")
    return issues.orderBy(key.asc() if ascending else key.desc(), "issue_id")


def issue_order() -> list[Column]:
    return [severity_rank(F.col("severity")), F.col("line_start"), F.col("issue_id")]


def top_issues(issues: DataFrame, keep: int = 5) -> DataFrame:
    return issues.orderBy(*issue_order()).limit(keep)


def validate_external(issues: DataFrame) -> DataFrame:
    """Adds ``valid``; external findings need an id, a title, known enums and a location.

    Severities are the legacy names here, and accessibility is not among the categories.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    known = [c for c in CATEGORIES if c != "accessibility"]
    return issues.withColumn(
        "valid",
        filled("issue_id") & filled("title") & F.col("category").isin(*known)
        & F.col("severity").isin("error", "warning", "info", "hint") & filled("file_path")
        & F.col("line_start").isNotNull(),
    )


def valid_suggestion(identifier: Column, code: Column) -> Column:
    """A suggestion counts when it has an id and more than ten characters of code."""
    stripped = F.regexp_replace(code, r"^\s+|\s+$", "")
    return F.coalesce((identifier != "") & (F.length(stripped) > 10), F.lit(False))


NAME = r"^[\w\s\-.]+$"
REPOSITORY = r"^[\w.-]+/[\w.-]+$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def validate_projects(requests: DataFrame) -> DataFrame:
    """Adds ``errors`` (array) and ``valid`` to project creation requests."""
    name, repo = F.col("name"), F.col("repo_full_name")
    checks = (
        (F.length(name) < 1, "name is required"),
        (F.length(name) > 100, "name is too long"),
        (~name.rlike(NAME), "name has other characters"),
        (~F.col("source").isin("upload", "github"), "source is unknown"),
        (repo.isNotNull() & ~repo.rlike(REPOSITORY), "repository is not owner/name"),
    )
    errors = F.array_compact(F.array(*[F.when(test, text) for test, text in checks]))
    return requests.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def is_uuid(identifier: Column) -> Column:
    """Whether a text is a UUID of versions 1 to 8; null is none."""
    return F.coalesce(identifier.rlike(UUID), F.lit(False))


def validate_ids(requests: DataFrame, *columns: str) -> DataFrame:
    """Adds ``id_errors`` and ``valid`` to requests whose ``columns`` must be UUIDs; a missing one is an error."""
    errors = F.array_compact(F.array(*[F.when(~is_uuid(F.col(c)), f"{c} is no UUID") for c in columns]))
    return requests.withColumn("id_errors", errors).withColumn("valid", F.size("id_errors") == 0)


def newest_first(projects: DataFrame) -> DataFrame:
    """Projects by ``updated_at``, the newest first."""
    return projects.orderBy(F.desc("updated_at"), "project_id")


def tenant_scope(table: DataFrame, projects: DataFrame, email: str) -> DataFrame:
    """Rows of the projects a user owns, by semi join (owners compare without case)."""
    mine = projects.where(F.lower("user_email") == email.lower()).select("project_id")
    return table.join(mine, "project_id", "left_semi")

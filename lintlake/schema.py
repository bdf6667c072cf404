"""Enums, weights and table shapes shared by every operator."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F, types as T

# The ordered severities and the categories of an issue.
SEVERITIES = ("BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO")
CATEGORIES = (
    "bug",
    "code-smell",
    "performance",
    "security",
    "maintainability",
    "accessibility",
    "best-practice",
)

# Weights and label maps keyed by severity or category.
SCORE_WEIGHT = {"BLOCKER": 15.0, "CRITICAL": 10.0, "MAJOR": 5.0, "MINOR": 2.0, "INFO": 0.5}
FLAT_SCORE_WEIGHT = {"BLOCKER": 15, "CRITICAL": 10, "MAJOR": 5, "MINOR": 2, "INFO": 1}
DEBT_MINUTES = {"BLOCKER": 120, "CRITICAL": 60, "MAJOR": 30, "MINOR": 10, "INFO": 5}
IMPACT = {"BLOCKER": 100, "CRITICAL": 90, "MAJOR": 60, "MINOR": 40, "INFO": 20}
OLD_SEVERITY = {"BLOCKER": "error", "CRITICAL": "error", "MAJOR": "warning", "MINOR": "info", "INFO": "hint"}
SARIF_LEVEL = {"BLOCKER": "error", "CRITICAL": "error", "MAJOR": "warning", "MINOR": "note", "INFO": "note"}
PRIORITY_SEVERITY = {"BLOCKER": 120, "CRITICAL": 100, "MAJOR": 60, "MINOR": 30, "INFO": 10}
PRIORITY_CATEGORY = {
    "security": 50,
    "bug": 40,
    "performance": 30,
    "maintainability": 20,
    "code-smell": 15,
    "best-practice": 10,
    "accessibility": 10,
}

FILES = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("size", T.LongType()),
    ]
)

POSITION = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())])
RANGE = T.StructType([T.StructField("start", POSITION), T.StructField("end", POSITION)])
LOCATION = T.StructType([T.StructField("filePath", T.StringType()), T.StructField("range", RANGE)])

# Columns every rule emits, in order. ``ord`` is the rule's ordinal, the tie-break of "first wins".
ISSUE_COLUMNS = (
    "project_id",
    "file_path",
    "rule_id",
    "ord",
    "line_start",
    "col_start",
    "line_end",
    "col_end",
    "title",
    "description",
    "category",
    "severity",
    "confidence",
    "impact",
    "code_snippet",
    "source",
    "engine",
)


_SQL_TYPES = {str: "string", int: "int", float: "double"}


def constant(value, sql_type: str) -> Column:
    """A nested constant from plain Python data; the optimizer folds it into one literal."""
    return F.from_json(F.lit(json.dumps(value)), sql_type)


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """``mapping[key]`` over a constant map, or ``default``."""
    kind = _SQL_TYPES[type(next(iter(mapping.values())))]
    return F.coalesce(F.try_element_at(constant(mapping, f"map<string,{kind}>"), key), F.lit(default).cast(kind))


def severity_rank(severity: Column) -> Column:
    """0 for BLOCKER .. 4 for INFO; unknown values rank last."""
    return lookup({s: i for i, s in enumerate(SEVERITIES)}, severity, len(SEVERITIES))


def js_round(value: Column) -> Column:
    """Round half up towards +infinity, as the reference's runtime rounds."""
    return F.floor(value + F.lit(0.5)).cast("long")


def severity_counts(column: str = "severity") -> list[Column]:
    """Five zero-filled count columns: ``blocker`` .. ``info``."""
    severity = F.col(column)
    return [F.count_if(severity == s).alias(s.lower()) for s in SEVERITIES]


def category_counts(column: str = "category") -> list[Column]:
    """Seven zero-filled count columns with underscores for dashes."""
    category = F.col(column)
    return [F.count_if(category == c).alias(c.replace("-", "_")) for c in CATEGORIES]

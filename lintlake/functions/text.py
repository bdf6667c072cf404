"""Scalar text helpers: trimming, hashing, identifiers, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lintlake.schema import js_round


def trimmed(text: Column) -> Column:
    """Strip every kind of white space at both ends (``F.trim`` strips blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# Elements of a block of a running sum: growing one array over all elements would copy it for each of them.
SUM_BLOCK = 512
_SUMS = """
transform(array({values}), v -> CASE WHEN size(v) <= {n} THEN
  slice(aggregate(v, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x))), 2, {n}) ELSE
  transform(array(aggregate(sequence(0, CAST((size(v) - 1) div {n} AS INT)), array(0), (a, k) ->
      concat(a, array(element_at(a, -1) + aggregate(slice(v, k * {n} + 1, {n}), 0, (t, x) -> t + x))))), c ->
    flatten(transform(sequence(0, CAST((size(v) - 1) div {n} AS INT)), k ->
      slice(aggregate(slice(v, k * {n} + 1, {n}), array(c[k]), (a, x) -> concat(a, array(element_at(a, -1) + x))), 2, {n}))))[0] END)[0]"""


def running_sums_sql(values: str) -> str:
    """SQL of the running sums of an int array, in time proportional to its length."""
    return _SUMS.format(values=values, n=SUM_BLOCK)


def raw_lines(content: Column) -> Column:
    return F.size(F.split(content, "\n", -1))


def meaningful_lines(content: Column) -> Column:
    """Lines holding at least one non-blank character, counted without building the line array."""
    return F.regexp_count(content, F.lit(r"(?m)^[^\n]*\S"))


def content_hash16(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def cache_key(path: Column, content: Column, rules_version: str) -> Column:
    return F.concat_ws(":", path, content_hash16(content), F.lit(rules_version))


def base_rule_id(issue_id: Column) -> Column:
    return F.regexp_replace(issue_id, r"-\d+$", "")


def extract_quoted(title: Column, default: str) -> Column:
    """The first quoted word of a title, or ``default``."""
    hit = F.regexp_extract(title, "['\"]([^'\"]+)['\"]", 1)
    return F.when(hit == "", F.lit(default)).otherwise(hit)


def capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))


def debt_label(minutes: Column) -> Column:
    """Minutes below an hour, hours below a working day of 480 minutes, else days."""
    text = lambda value, unit: F.concat(value.cast("string"), F.lit(unit))
    return (
        F.when(minutes < 60, text(minutes, "m"))
        .when(minutes < 480, text(js_round(minutes / 60), "h"))
        .otherwise(text(js_round(minutes / 480), "d"))
    )


def badge_text(score: Column) -> Column:
    return F.when(score.isNull(), F.lit("N/A")).otherwise(F.concat(js_round(score).cast("string"), F.lit("/100")))


def badge_colour(score: Column) -> Column:
    """Grey without a score, then green from 80, orange from 60, red below."""
    rounded = js_round(score)
    return (
        F.when(score.isNull(), "#9e9e9e")
        .when(rounded >= 80, "#4caf50")
        .when(rounded >= 60, "#ff9800")
        .otherwise("#f44336")
    )


def issue_source(issue_id: Column) -> Column:
    external = issue_id.rlike("^(semgrep|biome|ruff|tflint|checkov)-")
    return F.when(external, "external").otherwise("static")

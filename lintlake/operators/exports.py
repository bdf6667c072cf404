"""Exports: issue documents and SARIF runs, in chunks that stay bounded for any project."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lintlake.functions.text import base_rule_id
from lintlake.schema import SARIF_LEVEL, lookup
from lintlake.session import cut_lineage

SARIF_VERSION = "2.1.0"


def chunked_lists(df: DataFrame, keys: Sequence[str], number: str, size: int, item: Column) -> DataFrame:
    """Ordered lists per key, split by ``number div size`` of a unique running number.

    A list never holds more than ``size`` items, however many rows a key has; a reader takes the
    chunks of a key in order.
    """
    chunk = F.floor(F.col(number) / size).alias("chunk")
    grouped = df.select(*keys, chunk, item.alias("item")).groupBy(*keys, "chunk")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("item")).alias("items"))


def with_running_number(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """A unique number that follows ``order`` for tables without one: range partition, then partition offsets.

    The offsets come from one count per partition, the numbers from each partition's own order. The
    partitioned rows are written to the checkpoint folder first: range bounds are sampled, so the counts
    and the numbers must come from one and the same run.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order])
    ordered = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = ordered.withColumn("_rank", rank).join(F.broadcast(offsets), "_part")
    return numbered.withColumn("number", F.col("_offset") + F.col("_rank") - 1).drop("_part", "_rank", "_offset")


def issue_json() -> Column:
    """One exported issue, with its position as a flat ``location``."""
    location = F.struct(
        F.col("file_path").alias("filePath"),
        F.col("line_start").alias("startLine"),
        F.col("col_start").alias("startColumn"),
        F.col("line_end").alias("endLine"),
        F.col("col_end").alias("endColumn"),
    )
    return F.struct(
        F.col("issue_id").alias("id"),
        "title",
        "description",
        "category",
        "severity",
        location.alias("location"),
        F.col("code_snippet").alias("codeSnippet"),
        "confidence",
        "impact",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("createdAt"),
    )


def export_issues_json(issues: DataFrame, export_date: str, number: str = "event_id", size: int = 2000) -> DataFrame:
    """Documents ``{exportDate, totalIssues, issues}``; the total is the project's, the list its chunk."""
    item = F.struct(F.col(number).alias("_o"), issue_json().alias("issue"))
    lists = chunked_lists(issues, ["project_id"], number, size, item)
    totals = issues.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"))
    document = F.to_json(
        F.struct(
            F.lit(export_date).alias("exportDate"),
            F.col("total").alias("totalIssues"),
            F.transform("items", lambda i: i["issue"]).alias("issues"),
        )
    )
    return lists.join(totals, "project_id").select("project_id", "chunk", document.alias("document"))


def sarif_rules(issues: DataFrame, number: str = "event_id") -> DataFrame:
    """The distinct rules of each project; the first finding of a rule names it."""
    rule = base_rule_id(F.col("issue_id")).alias("rule")
    first = F.min_by(
        F.struct("title", "description", lookup(SARIF_LEVEL, F.col("severity")).alias("level")), F.col(number)
    )
    return issues.groupBy("project_id", rule).agg(first.alias("r"), F.min(number).alias("first")).select(
        "project_id", "rule", "r.*", "first"
    )


def export_sarif(issues: DataFrame, number: str = "event_id", size: int = 2000) -> DataFrame:
    """SARIF logs, one per project and chunk of results; each carries the project's rules."""
    rules = sarif_rules(issues, number).groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct("first", "rule", "title", "description", "level"))).alias("rules")
    )
    region = F.struct(
        (F.col("line_start") + 1).alias("startLine"),
        (F.col("col_start") + 1).alias("startColumn"),
        (F.col("line_end") + 1).alias("endLine"),
        (F.col("col_end") + 1).alias("endColumn"),
    )
    place = F.struct(
        F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias(
            "physicalLocation"
        )
    )
    result = F.struct(
        base_rule_id(F.col("issue_id")).alias("ruleId"),
        lookup(SARIF_LEVEL, F.col("severity")).alias("level"),
        F.struct(F.col("description").alias("text")).alias("message"),
        F.array(place).alias("locations"),
        F.struct("category", "confidence", "impact").alias("properties"),
    )
    item = F.struct(F.col(number).alias("_o"), result.alias("result"))
    lists = chunked_lists(issues, ["project_id"], number, size, item).join(rules, "project_id")
    driver = F.struct(
        F.col("project_id").cast("string").alias("name"),
        F.lit("1.0.0").alias("version"),
        F.transform(
            "rules",
            lambda r: F.struct(
                r["rule"].alias("id"),
                r["title"].alias("name"),
                F.struct(r["description"].alias("text")).alias("shortDescription"),
                F.struct(r["level"].alias("level")).alias("defaultConfiguration"),
            ),
        ).alias("rules"),
    )
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("items", lambda i: i["result"]).alias("results"))
    log = F.to_json(F.struct(F.lit(SARIF_VERSION).alias("version"), F.array(run).alias("runs")))
    return lists.select("project_id", "chunk", log.alias("log"))

"""The warehouse side: appends, replacements and upserts as whole-table plans."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lintlake.operators.triage import keep_first
from lintlake.operators.usage import priced
from lintlake.session import cut_lineage


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def save_scan(scans: DataFrame, issues: DataFrame, root: str) -> None:
    """Append scans and their issues, laid out by project so that reads of one project prune.

    ``rebalance`` brings the rows of a project together to avoid small files, and splits a project
    that would overload one writer.
    """
    for name, table in (("scans", scans), ("issues", issues)):
        table.hint("rebalance", "project_id").write.mode("append").partitionBy("project_id").parquet(f"{root}/{name}")


def touched_projects(projects: DataFrame, scans: DataFrame) -> DataFrame:
    """Projects with ``updated_at`` moved to their newest scan."""
    newest = scans.groupBy("project_id").agg(F.max("scanned_at").alias("_newest"))
    return projects.join(newest, "project_id", "left").withColumn(
        "updated_at", F.greatest("updated_at", "_newest")
    ).drop("_newest")


def replace_project_files(files: DataFrame, root: str, projects: DataFrame | None = None) -> None:
    """Replace the files of ``projects(project_id)``, by default of exactly those that ``files`` holds (dynamic partition overwrite).

    A project that is named but has no files keeps one row of nulls as its partition, which :func:`project_files` leaves out.
    """
    if projects is not None:
        empty = projects.select("project_id").distinct().join(files.select("project_id").distinct(), "project_id", "left_anti")
        files = files.join(projects.select("project_id").distinct(), "project_id", "left_semi").unionByName(empty, allowMissingColumns=True)
    files.hint("rebalance", "project_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(
        f"{root}/files"
    )


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """The files as last written by :func:`replace_project_files`."""
    return spark.read.parquet(f"{root}/files").where("path IS NOT NULL")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` taking over their keys; the last row of ``new`` per key wins.

    ``new`` carries ``load_order``.
    """
    tagged = old.withColumn("load_order", F.lit(-1).cast("long")).unionByName(new)
    return keep_first(tagged, [key], [F.desc("load_order")]).drop("load_order")


#: Folders of the snapshot table: all snapshots of a project in a month. An upsert rewrites whole folders.
SNAPSHOT_LAYOUT = ("project_id", "month")
#: Folders that one upsert may touch; their names are collected, to read and write these folders only.
MOST_FOLDERS = 10_000


def _in_folders(table: DataFrame, folders: list) -> DataFrame:
    """The rows of the given (project, month) folders, by a filter on the folder names alone."""
    by_month: dict = {}
    for project, month in folders:
        by_month.setdefault(month, []).append(project)
    test = F.lit(False)
    for month, projects in by_month.items():
        test = test | ((F.col("month") == month) & F.col("project_id").isin(projects))
    return table.where(test)


def upsert_health_snapshot(new: DataFrame, root: str) -> int:
    """Snapshots of ``new`` take over their ``scan_id`` in the table at ``root``; the folders rewritten are counted and returned.

    ``new`` has ``scan_id``, ``project_id``, ``scanned_at``, ``load_order`` (the last row of a scan wins) and further columns; a scan
    stays with its project. Of the folders of these projects the scan ids are read, to find those that hold a touched scan;
    only these and the folders that the new rows belong to are read in full and overwritten. A folder that is left without
    rows keeps one of nulls, which :func:`health_snapshots` leaves out.
    """
    spark = new.sparkSession
    month = F.date_format("scanned_at", "yyyy-MM")
    rows = keep_first(new.withColumn("project_id", F.col("project_id").cast("string")), ["scan_id"], [F.desc("load_order")])
    rows = cut_lineage(rows.drop("load_order").withColumn("month", month))
    current = read_table(spark, f"{root}/snapshots", rows.schema)
    touched = rows.select("project_id").distinct()
    ids = current.select("scan_id", *SNAPSHOT_LAYOUT).join(touched, "project_id", "left_semi")
    holding = ids.join(rows.select("scan_id"), "scan_id", "left_semi").select(*SNAPSHOT_LAYOUT)
    folders = holding.unionByName(rows.select(*SNAPSHOT_LAYOUT)).distinct().limit(MOST_FOLDERS + 1).collect()
    if len(folders) > MOST_FOLDERS:
        raise ValueError(f"an upsert may touch {MOST_FOLDERS} folders; give it in parts")
    if not folders:
        return 0
    kept = _in_folders(current, folders).where("scan_id IS NOT NULL").join(rows.select("scan_id"), "scan_id", "left_anti")
    merged = cut_lineage(kept.select(*rows.columns).unionByName(rows))
    empty = spark.createDataFrame(folders, "project_id string, month string").join(merged.select(*SNAPSHOT_LAYOUT).distinct(), [*SNAPSHOT_LAYOUT], "left_anti")
    merged.unionByName(empty, allowMissingColumns=True).hint("rebalance", *SNAPSHOT_LAYOUT).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*SNAPSHOT_LAYOUT).parquet(f"{root}/snapshots")
    return len(folders)


def health_snapshots(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The snapshots as last written by :func:`upsert_health_snapshot`; ``schema`` has the folder columns as strings."""
    return read_table(spark, f"{root}/snapshots", schema).where("scan_id IS NOT NULL")


def replace_suggestions(existing: DataFrame, new: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Suggestions of ``issues(issue_id)`` replaced by those in ``new``, all others kept; an issue without new ones loses its own."""
    renewed = (new if issues is None else issues).select("issue_id").distinct()
    return existing.join(renewed, "issue_id", "left_anti").unionByName(new)


def record_ai_usage(calls: DataFrame, root: str) -> None:
    """Append priced calls, laid out by month as the cost reports read them."""
    dated = priced(calls).withColumn("month", F.trunc("created_at", "month"))
    dated.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(f"{root}/ai_usage")


def map_project_upsert(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with the id of the user's project for the same repository, else their own ``new_id``."""
    known = existing.groupBy("user_email", "repo_full_name").agg(F.min("project_id").alias("_known"))
    joined = requests.join(known, ["user_email", "repo_full_name"], "left")
    return joined.withColumns(
        {"project_id": F.coalesce("_known", "new_id"), "reused": F.col("_known").isNotNull()}
    ).drop("_known", "new_id")


def write_export(documents: DataFrame, path: str) -> None:
    """Row-form export: one JSON document per line."""
    documents.select("document").write.mode("overwrite").text(path)

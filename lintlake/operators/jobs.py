"""Reports over the scan-job table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

STALE_MINUTES = 10


def job_report(jobs: DataFrame, as_of: str) -> DataFrame:
    """Per status: jobs, files discovered and analysed, mean duration, and running jobs gone stale."""
    now = F.lit(as_of).cast("timestamp")
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(STALE_MINUTES)))
    seconds = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
    return jobs.groupBy("status").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.sum("files_discovered").alias("files_discovered"),
        F.sum("files_analyzed").alias("files_analyzed"),
        F.avg(seconds).alias("mean_seconds"),
        F.count_if(stale).alias("stale"),
    )


def with_owner(jobs: DataFrame, projects: DataFrame) -> DataFrame:
    """Jobs with the owner of their project."""
    return jobs.join(projects.select("project_id", "user_email"), "project_id")


def requeue_stale(jobs: DataFrame, as_of: str) -> DataFrame:
    """Running jobs without an end for ten minutes go back to the queue."""
    now = F.lit(as_of).cast("timestamp")
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(STALE_MINUTES)))
    return jobs.withColumns(
        {
            "status": F.when(stale, "queued").otherwise(F.col("status")),
            "started_at": F.when(~stale, F.col("started_at")),
        }
    )

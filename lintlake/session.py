"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "lintlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan in this package assumes.

    Cluster settings given to ``spark-submit`` win: only semantics-bearing options
    are fixed here, sizes are left to the caller through ``conf``.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Plans of many rules hold thousands of expressions: do not record a call site for each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only when it names none."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a shared folder before cutting lineage on a cluster")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and read it back from there, so a lost executor costs no replay."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)

"""Session set-up and the two places where a job has to write something."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder of a table that a step has written, under its shared folder.
STEP = "/tidewatch-step"


def build_session(app: str = "tidewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on.

    Joins are left to AQE: nothing is hinted as broadcast, so a side is only
    broadcast when its measured size is under Spark's own threshold, and a hot
    join key is split by the skew rule.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one the cluster names for shared scratch data.

    ``spark.checkpoint.dir`` names it. Only a local master, where driver and
    executors are one machine, falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidewatch-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Iterative operators call this once per round. A lost executor then re-reads
    the written table instead of replaying every earlier round, and the reader
    gets true size statistics for the next join.
    """
    path = shared_folder(df.sparkSession) + STEP
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reads_written(df: DataFrame) -> bool:
    """Whether all files that ``df`` reads were written by :func:`cut_lineage`."""
    files = df.inputFiles()
    return bool(files) and all(f"{STEP}/" in f for f in files)

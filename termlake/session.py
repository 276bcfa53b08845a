"""SparkSession with the settings that the package's results rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "termlake", **conf: str) -> SparkSession:
    """UTC and ANSI semantics, adaptive execution with skew handling; other settings are the cluster's own."""
    builder = SparkSession.builder.appName(name)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=base | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder in spark.checkpoint.dir; only in local mode, where all share one disk, one of the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """df written to the cluster's checkpoint folder (`shared_folder`) and read from there: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()

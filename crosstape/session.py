"""Spark session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "crosstape", master: str | None = None, cores: int | None = None) -> SparkSession:
    """A session with the settings every job here assumes: UTC, AQE, RocksDB state.

    On a cluster leave ``master`` unset and let spark-submit decide; the shuffle
    partition count then comes from the cluster's own configuration.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    if cores:
        b = (
            b.config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g")
        )
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would vanish with the executor that wrote it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    fallback = getattr(spark.sparkContext, "_crosstape_dir", None)
    if fallback is None:
        fallback = tempfile.mkdtemp(prefix="spark-crosstape-")
        spark.sparkContext._crosstape_dir = fallback
    return fallback


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive executor loss and are not recomputed."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()

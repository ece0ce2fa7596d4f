"""Session settings and shared-storage helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "vitaline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with UTC and AQE. On a cluster leave master and shuffle_partitions unset, as spark-submit gives them."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the cluster has cores, for work that is heavy for its bytes.

    Only an input of fewer partitions is moved, as a small or single file; larger ones are left as they are read. The
    frame must come from a scan without a shuffle, so that counting its partitions runs nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that losing an executor never loses it.

    The folder is the session's spark.checkpoint.dir. Where that is unset a session in one process (tests) gets a folder
    of its machine; on a cluster that is refused, as such a folder is lost with its machine.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vitaline-"))
    return df.checkpoint(eager=True)

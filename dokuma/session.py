"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def make_session(app: str = "dokuma", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster passes its own session in."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder all executors share.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset
    (local tests, where driver and executors share one machine) a temporary folder is used.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not re.fullmatch(r"local(\[.*\])?", sc.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "dokuma-checkpoints"))
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over at least as many partitions as the cluster has cores, before work that is heavy for each row.

    A large input has more partitions than that already and passes unchanged; only an input of few files is shuffled.
    """
    if not hasattr(df, "_jdf"):  # a remote session doesn't tell; its planner decides
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return df.repartition(cores, *keys) if few else df

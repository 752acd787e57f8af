"""What every operator needs from the session: where checkpoints go and how lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. The cluster names it in spark.checkpoint.dir; only where that is
    unset and the master is local (tests) a temporary folder is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodestrand-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where a scan has fewer partitions than there are cores, as one file of one row group has; else
    as they are. The rows stay the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """The same rows with their lineage cut, stored where a lost executor doesn't matter."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)

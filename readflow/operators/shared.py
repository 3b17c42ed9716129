"""Cutting the lineage of iterative jobs, in a folder that all executors see."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_checkpoints(spark: SparkSession) -> None:
    """Makes sure that checkpoint() has a folder: the session's spark.checkpoint.dir, or in local mode a temporary one.

    On a cluster a folder on one machine is of no use, so there the setting is required.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-checkpoints-"))


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there on."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it comes from fewer files (a small table in one file); no job is run to find out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


#: Bytes of input files to a part: what is made of a text takes up to a hundred times its size while it is sorted.
PART_BYTES = 2 << 20
MOST_PARTS = 20_000


def parts(df: DataFrame) -> int:
    """How many parts df should have, from the size of what it reads (no job is run); the session's number, if that is more."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    # What was checkpointed says that it may have any size.
    return max(least, min(-(-sum(x for x in sizes if x < 1 << 50) // PART_BYTES), MOST_PARTS))


def parted(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out (by keys) to parts of a bounded size, so that a task's memory doesn't grow with the table."""
    return df.repartition(parts(df), *keys)

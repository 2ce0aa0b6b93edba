"""Materialised intermediate tables in the shared checkpoint folder; sizes of batches and of tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch that goes to a Python worker; texts of a few KB gain nothing from larger ones.
BATCH_BYTES = 8 << 20


def lean(spark: SparkSession) -> SparkSession:
    """Lowers the session's Arrow batches to BATCH_BYTES, so that workers hold little text at a time; smaller ones stay."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower().rstrip("b")
    size = int(now.rstrip("kmg") or 0) << {"k": 10, "m": 20, "g": 30}.get(now[-1], 0)
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return spark


#: Bytes, as the optimizer estimates them from the files, of the rows that one task joins or groups.
TASK_BYTES = 2 << 20
#: Tasks: below the first the session's own partitions do; beyond the second tasks grow, and spill.
LEAST_TASKS, MOST_TASKS = 16, 20_000


def estimated(df: DataFrame) -> int:
    """The optimizer's estimate of a table's bytes, at most those of all it reads; 0 if unknown, as of checkpoints.  No job."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = lambda p: int(str(p.stats().sizeInBytes()))
    leaves = plan.collectLeaves()
    n = min(size(plan), sum(size(leaves.apply(i)) for i in range(leaves.size())))
    return n if n < 1 << 50 else 0


def tasks_for(df: DataFrame) -> int:
    """Tasks over which a large table is to be spread, in proportion to it; 0 for a small one."""
    n = -(-estimated(df) // TASK_BYTES)
    return 0 if n < LEAST_TASKS else min(n, MOST_TASKS)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which executors share; a temporary one only in a local session without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="provenant-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df computed once; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()

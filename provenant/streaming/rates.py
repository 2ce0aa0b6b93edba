"""Failure counters kept up to date over micro-batches of facts.

The batch tables read additive cells (rows and failures by model, category and
scores), so a stream needs no state beyond them: each micro-batch is reduced to its
cells and appended under its epoch, rerun epochs overwrite themselves, and tables are
computed from the summed cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ["model_short", "category", "asf_score", "ssm_score", "ipam_score"]


def cells(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*KEYS).agg(F.count("*").alias("c"))


def start(facts: DataFrame, folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append each micro-batch's cells to folder/epoch=N."""

    def write(batch: DataFrame, epoch: int) -> None:
        cells(batch).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    stream = facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(**trigger) if trigger else stream).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of all epochs so far, summed."""
    return spark.read.parquet(folder).groupBy(*KEYS).agg(F.sum("c").alias("c"))


def rates(counted: DataFrame, by: str = "model_short") -> DataFrame:
    """by, n, FFR, SFR, AFR from summed cells."""
    rate = lambda col: F.lit(100.0) * F.sum(F.when(F.col(col) <= 2, F.col("c")).otherwise(0)) / F.sum("c")
    return counted.where(F.col(by).isNotNull()).groupBy(by).agg(F.sum("c").alias("n"), rate("asf_score").alias("FFR"), rate("ssm_score").alias("SFR"), rate("ipam_score").alias("AFR"))

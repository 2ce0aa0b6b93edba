"""Session helpers of the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from ..sources.durable import lean  # noqa: F401


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only on a local master that names none."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="provenant-")


def durable(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()

"""Results that are read more than once, written in the folder that all executors share, and rows dealt for work that is heavy for its bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the cluster's spark.checkpoint.dir, or below the warehouse where that is unset (tests)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint()


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df in spark.sql.shuffle.partitions parts, dealt by these columns or in turn.

    A number that is named isn't lowered for small rows, so rows that are short but slow to read keep all tasks busy.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)

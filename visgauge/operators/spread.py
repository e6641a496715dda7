"""Partitions whose number grows with the rows, so that a task's memory does not."""

from __future__ import annotations

from pyspark.sql import DataFrame


def partitions(df: DataFrame, rows: int = 200_000) -> int:
    """As many partitions as give each about so many rows of df, and one for each core at least. df is counted, which for
    a table of Parquet reads its footers only."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))

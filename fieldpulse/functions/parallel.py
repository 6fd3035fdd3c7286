"""Parallelism for CPU-heavy per-row work.

A Parquet split is a row group, so a small table written as one row group is
scanned by one task, and every narrow operator fused into that scan stage
(regex audits, text cleaning, HTML stripping) then runs on one core. ``spread``
inserts a round-robin repartition only when the planner's size estimate of the
input is below one target split for each task slot; a cluster-sized input is
left alone, and no shuffle is added. Only the number of tasks depends on it, never
a result, and nothing is run to find out: the estimate comes from the plan.
Filters and column pruning are still pushed below the repartition into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


#: Bytes of input that one task should have at most before spreading stops.
SPLIT_BYTES = 16 << 20


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition to ``min_partitions`` (default: task slots) of inputs that are small for so many tasks."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if estimate > target * SPLIT_BYTES else df.repartition(target)

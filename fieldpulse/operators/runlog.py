"""Sync-job bookkeeping as table operators (S-13..S-16).

The reference keeps these in Python lists in one process. Here they are
tables: a target-results table (one row per target per run), a job log (one
row per run). Roll-ups use bounded aggregates only (counts, flags, the latest
value by ``max_by``); nothing collects a run's rows into one list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECENT_RUNS = 20  # the job log shows the last 20 runs (part of the feature)

# Dataset names recognised in landed file names, in priority order.
DATASETS = ("survey", "study")


def run_rollup(results: DataFrame, run_col: str = "run_id", file_col: str = "file",
               error_col: str = "error", order_col: str = "seq") -> DataFrame:
    """S-13: per run: targets, files, errors, success (at least one file), latest file."""
    return results.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("n_targets"),
        F.count(file_col).alias("n_files"),
        F.count(error_col).alias("n_errors"),
        (F.count(file_col) > 0).alias("success"),
        F.max_by(F.col(file_col), F.when(F.col(file_col).isNotNull(), F.col(order_col))).alias("latest_file"))


def assign_datasets(files: DataFrame, name_col: str = "name", run_col: str = "run_id",
                    path_col: str = "path", order_col: str = "seq") -> DataFrame:
    """S-14: per run, the newest landed file of each dataset and the ingest gate.

    A file belongs to the first dataset whose name it contains (case-folded),
    ``survey`` before ``study``. The run is ready when every dataset has a
    file; otherwise ``missing`` lists the absent ones in dataset order.
    """
    low = F.lower(F.col(name_col))
    ds = None
    for d in DATASETS:
        ds = F.when(low.contains(d), F.lit(d)) if ds is None else ds.when(low.contains(d), F.lit(d))
    tagged = files.withColumn("_ds", ds)
    aggs = [F.max_by(F.when(F.col("_ds") == d, F.col(path_col)),
                     F.when(F.col("_ds") == d, F.col(order_col))).alias(f"{d}_path") for d in DATASETS]
    g = tagged.groupBy(run_col).agg(*aggs)
    missing = F.array_compact(F.array(*[F.when(F.col(f"{d}_path").isNull(), F.lit(d)) for d in DATASETS]))
    return g.withColumn("missing", missing).withColumn("ready", F.size("missing") == 0)


def recent_runs(log: DataFrame, ts_col: str = "timestamp", key_col: str = "job_id",
                n: int = RECENT_RUNS) -> DataFrame:
    """S-15: the last ``n`` runs, newest first (ties broken by job id)."""
    return log.orderBy(F.desc(ts_col), F.desc(key_col)).limit(n)


def scheduler_status(log: DataFrame, ts_col: str = "timestamp", key_col: str = "job_id",
                     success_col: str = "success") -> DataFrame:
    """S-15: total runs, last run time, last run id and its success, in one aggregate."""
    order = F.struct(F.col(ts_col), F.col(key_col))
    return log.agg(F.count(F.lit(1)).alias("total_syncs"), F.max(ts_col).alias("last_sync_at"),
                   F.max_by(F.col(key_col), order).alias("last_job_id"),
                   F.max_by(F.col(success_col), order).alias("last_success"))


class UnknownTarget(ValueError):
    pass


def select_target(targets: DataFrame, name: str, name_col: str = "name") -> DataFrame:
    """S-16: one target by name; unknown names raise with the list of valid ones.

    The target list is configuration-sized; only the names are read back for
    the error message, and only when the name is unknown.
    """
    picked = targets.filter(F.col(name_col) == name)
    if picked.limit(1).count() == 0:
        valid = sorted(r[0] for r in targets.select(name_col).distinct().collect())
        raise UnknownTarget(f"Unknown target '{name}'. Valid: {', '.join(valid)}")
    return picked

"""Export ledger (ST-01): which export of a sheet is whole, and which one is current.

An export is a full copy of its sheet under one name below the landing folder: a
file, or a folder of part files that its writer closes with a marker. Its files
may arrive, and be read, over many batches, and exports may arrive out of order.

* ``rows/``: the cleaned rows, partitioned by export and batch, written as they
  are read (no sort, so a task holds no more of a large part file than its
  writer's buffers). A batch that is replayed rewrites its own partitions.
* ``ledger/``: one row for each file of a batch: export, file, rows.
* versions (``sources.versions``): the name of the current export. It moves on to
  the greatest name (S-04's order) among exports that are whole: closed, and every
  landed file read, or without rows. So an export shows up only when all of
  it is there, and one that comes late and is older changes nothing.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldpulse.sources.files import Files
from fieldpulse.sources.versions import Versions

EXPORT, FILE, PART = "_landed_export", "_landed_file", "_part_of"
LEDGER = "export string, file string, rows long, batch_id long"
MARKER = "_SUCCESS"
# keeps names such as 0001 texts when partitions are read back
_PREFIX = "x-"
#: Files that a task writes at once, one for each of its exports: a task reads one file's split, or 32 small files
#: (128 MB by 4 MB for opening one). Beyond that many Spark sorts the task's remaining rows by export.
OPEN_FILES = 32
_OPEN_FILES_KEY = "spark.sql.maxConcurrentOutputFileWriters"


def with_origin(rows: DataFrame, landing: str) -> DataFrame:
    """Landed rows with their export's name and their file."""
    under = "/" + re.escape(os.path.basename(os.path.normpath(landing))) + "/([^/]+)"
    path = F.col("_metadata.file_path")
    return rows.withColumns({EXPORT: F.regexp_extract(path, under, 1), FILE: path})


@contextmanager
def unsorted_partitions(spark: SparkSession, open_files: int = OPEN_FILES) -> Iterator[None]:
    """Partitioned writes of this session keep a file open for each partition, in place of sorting all rows of a task first."""
    before = spark.conf.get(_OPEN_FILES_KEY, None)
    spark.conf.set(_OPEN_FILES_KEY, str(open_files))
    try:
        yield
    finally:
        spark.conf.unset(_OPEN_FILES_KEY) if before is None else spark.conf.set(_OPEN_FILES_KEY, before)


class ExportLedger:
    """The ledger, rows and current export of one sheet."""

    def __init__(self, spark: SparkSession, base: str, marker: str | None = MARKER):
        self.spark, self.base, self.marker = spark, base, marker
        self.rows_path, self.ledger_path = os.path.join(base, "rows"), os.path.join(base, "ledger")
        self.versions, self.files = Versions(spark, base), Files(spark)

    def _read(self, path: str, schema: str | None = None) -> DataFrame | None:
        try:
            return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(path)
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
                raise
            return None

    def record(self, rows: DataFrame, batch_id: int) -> None:
        """Write one batch's (cleaned) rows, which carry ``EXPORT`` and ``FILE``, and note its files."""
        batch = F.lit(batch_id).cast("long")

        def put(df: DataFrame, path: str, *by: str) -> None:
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

        out = rows.withColumns({PART: F.concat(F.lit(_PREFIX), F.col(EXPORT)), "batch_id": batch})
        # a stream's batches have a session of their own
        with unsorted_partitions(out.sparkSession):
            put(out.drop(EXPORT), self.rows_path, PART, "batch_id")
        # from the written partitions: one column of this batch
        own = self.spark.read.parquet(self.rows_path).where(F.col("batch_id") == batch_id)
        files = own.groupBy(F.substr(PART, F.lit(len(_PREFIX) + 1)).alias("export"), F.col(FILE).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
        put(files.withColumn("batch_id", batch), self.ledger_path, "batch_id")

    def entries(self) -> DataFrame:
        """export, file, rows, batch_id of all that was read."""
        found = self._read(self.ledger_path, LEDGER)
        return found if found is not None else self.spark.createDataFrame([], LEDGER)

    def landed(self, landing: str) -> DataFrame:
        """(export, file) of the data files that are there now; no file is opened."""
        listing = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(landing)
        return with_origin(listing, landing).select(F.col(EXPORT).alias("export"), F.col(FILE).alias("file"))

    def exports(self, landing: str) -> DataFrame:
        """export, files landed, files read, rows, batches: the state of every landed export."""
        read = self.entries().groupBy("export", "file").agg(F.sum("rows").alias("rows"), F.min("batch_id").alias("batch_id"))
        return self.landed(landing).join(read, ["export", "file"], "left").groupBy("export").agg(
            F.count(F.lit(1)).alias("files"), F.count("rows").alias("files_read"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.count_distinct("batch_id").alias("batches"))

    def _closed(self, landing: str, export: str) -> bool:
        path = os.path.join(landing, unquote(export))
        return self.marker is None or not self.files.is_folder(path) or self.files.exists(os.path.join(path, self.marker))

    def _whole(self, landing: str, export: str, fmt: str, options: dict, schema: StructType) -> bool:
        missing = self.landed(landing).where(F.col("export") == export).join(self.entries(), ["export", "file"], "left_anti")
        if missing.isEmpty():
            return True
        # a part file without rows is never seen in a batch
        open_rows = self.spark.read.format(fmt).schema(schema).options(**options).load(os.path.join(landing, unquote(export)))
        return with_origin(open_rows, landing).select(F.col(FILE).alias("file")).join(missing, "file", "left_semi").isEmpty()

    def current_export(self) -> str | None:
        now = self.versions.current()
        return now.sources["export"] if now else None

    def advance(self, landing: str, fmt: str, options: dict, schema: StructType) -> str | None:
        """Make the greatest whole export current, if it is newer than the current one; returns the current name."""
        now = self.current_export()
        newer = self.landed(landing).select("export").distinct()
        if now is not None:
            newer = newer.where(F.col("export") > now)
        # names of exports that came since: one a load
        for name in sorted((r["export"] for r in newer.collect()), reverse=True):
            if self._closed(landing, name) and self._whole(landing, name, fmt, options, schema):
                self.versions.publish({}, {"export": name})
                return name
        return now

    def current(self) -> DataFrame | None:
        """The rows of the current export, or None before the first whole one."""
        name, rows = self.current_export(), self._read(self.rows_path)
        if name is None or rows is None:
            return None
        return rows.where(F.col(PART) == _PREFIX + name).drop(PART, FILE, "batch_id")

    def retire(self, keep: int = 2) -> list[str]:
        """Delete the rows of older exports than the current one, but for the newest ``keep - 1`` of them; the ledger stays."""
        now = self.current_export()
        folders = {unquote(n.split("=", 1)[1])[len(_PREFIX):]: n for n in self.files.names(self.rows_path) if n.startswith(PART + "=")}
        older = sorted(e for e in folders if now is not None and e < now)
        gone = older[:max(0, len(older) - (keep - 1))]
        for export in gone:
            self.files.delete(os.path.join(self.rows_path, folders[export]))
        self.versions.retain(keep, grace_seconds=0)
        return gone

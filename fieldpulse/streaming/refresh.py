"""Incremental refresh with Structured Streaming (ST-01, ST-02).

ST-01  newly landed exports are picked up by a file-source stream; the
       checkpoint (on shared storage) records which files were processed, so
       a restarted job never re-reads or skips a file. ``trigger(availableNow=True)``
       processes everything pending and stops, so a scheduler can run it every
       few hours as the reference's cron does. Each micro-batch is cleaned and
       noted in the sheet's export ledger (``streaming.ledger``).
ST-02  once an export is whole it becomes current, and the gold brief and risk
       tables are rebuilt from the current exports and published together as
       one version (``sources.versions``). Readers see the old pair or the new
       one. The version names the exports it was made from: a tick rebuilds
       whenever they differ from the current ones, also after a crash.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fieldpulse.model import DOMAIN_ACTIVITY, DOMAIN_STUDY, ActivityModel, StudyModel
from fieldpulse.operators.brief import brief_long
from fieldpulse.operators.clean import CleanSpec, clean_sheet
from fieldpulse.operators.risks import risk_table
from fieldpulse.session import shared_dir
from fieldpulse.sources.versions import Manifest, Versions
from fieldpulse.streaming.ledger import MARKER, ExportLedger, with_origin

TABLES = ("survey_main", "study_main")


def ledger_of(spark: SparkSession, silver_dir: str, table: str, marker: str | None = MARKER) -> ExportLedger:
    return ExportLedger(spark, os.path.join(silver_dir, table), marker)


def current_version(spark: SparkSession, silver_path: str) -> DataFrame | None:
    """The current export's cleaned rows, or None before the first whole export."""
    return ExportLedger(spark, silver_path).current()


def _sources(spark: SparkSession, silver_dir: str, tables: tuple[str, str]) -> dict[str, str | None]:
    return {t: ledger_of(spark, silver_dir, t).current_export() for t in tables}


def gold_is_current(spark: SparkSession, silver_dir: str, gold_dir: str,
                    tables: tuple[str, str] = TABLES) -> bool:
    """Was gold published from the exports that are current now?"""
    gold = Versions(spark, gold_dir).current()
    return gold is not None and gold.sources == _sources(spark, silver_dir, tables)


def gold(spark: SparkSession, gold_dir: str) -> Manifest | None:
    """The published gold version; ``.read(spark, "brief")`` and ``"risks"`` belong together."""
    return Versions(spark, gold_dir).current()


def refresh_gold(spark: SparkSession, silver_dir: str, gold_dir: str,
                 m: ActivityModel = DOMAIN_ACTIVITY, s: StudyModel = DOMAIN_STUDY,
                 activity_table: str = TABLES[0], study_table: str = TABLES[1], keep: int = 2) -> bool:
    """Publish ``brief`` and ``risks`` (with their details) from the current exports; False until both sheets have one."""
    sources = _sources(spark, silver_dir, (activity_table, study_table))
    activity, study = (ledger_of(spark, silver_dir, t).current() for t in (activity_table, study_table))
    if activity is None or study is None:
        return False
    versions = Versions(spark, gold_dir)
    versions.publish({"brief": brief_long(activity, study, m, s), "risks": risk_table(activity, study, m, s)}, sources)
    versions.retain(keep)
    return True


def _options(fmt: str) -> dict[str, str]:
    return {"recursiveFileLookup": "true"} | ({"header": "true"} if fmt == "csv" else {})


def make_batch_handler(ledger: ExportLedger, spec: CleanSpec | None, as_of: str, after=None):
    """The stream's foreachBatch function: clean, record, then ``after()``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        ledger.record(batch if spec is None else clean_sheet(batch, spec, as_of), batch_id)
        if after is not None:
            after()

    return handle


def landed_schema(spark: SparkSession, landing_dir: str, fmt: str) -> StructType:
    """Schema of the files already landed (a stream needs it up front)."""
    return spark.read.format(fmt).options(**_options(fmt)).load(landing_dir).schema


def start_refresh(spark: SparkSession, landing_dir: str, table: str, spec: CleanSpec | None,
                  silver_dir: str, gold_dir: str, as_of: str, schema=None, fmt: str = "parquet",
                  checkpoint: str | None = None, files_per_batch: int | None = None,
                  available_now: bool = True, refresh_each_batch: bool = True,
                  marker: str | None = MARKER) -> StreamingQuery:
    """Start the incremental refresh of one landed sheet; returns the running query.

    ``schema`` defaults to that of the files already landed. The checkpoint
    defaults to a folder under the cluster's ``spark.checkpoint.dir``.
    ``marker`` is the file that closes a folder of part files (None: such a
    folder counts as closed at any time).
    """
    schema = schema or landed_schema(spark, landing_dir, fmt)
    reader = spark.readStream.format(fmt).schema(schema).options(**_options(fmt))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    ledger = ledger_of(spark, silver_dir, table, marker)

    def after() -> None:
        if ledger.advance(landing_dir, fmt, _options(fmt), schema) and not gold_is_current(spark, silver_dir, gold_dir):
            refresh_gold(spark, silver_dir, gold_dir)

    handler = make_batch_handler(ledger, spec, as_of, after if refresh_each_batch else None)
    ckpt = checkpoint or shared_dir(spark, f"stream-{table}")
    writer = (with_origin(reader.load(landing_dir), landing_dir).writeStream.foreachBatch(handler)
              .option("checkpointLocation", ckpt).queryName(f"refresh_{table}"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="6 hours")
    return writer.start()


def run_refresh_once(spark: SparkSession, sheets: dict[str, tuple[str, CleanSpec | None]], silver_dir: str,
                     gold_dir: str, as_of: str, checkpoint_base: str, fmt: str = "parquet",
                     files_per_batch: int | None = None, marker: str | None = MARKER) -> bool:
    """Process everything pending for each sheet, then rebuild gold once (one scheduler tick).

    The sheets' streams are independent, so they run concurrently (each
    query drives its micro-batches from its own thread). Afterwards each sheet's
    ledger moves on to its greatest whole export. Returns whether gold was
    rebuilt: only if it was not made from the exports that are current then.
    """
    schemas = {t: landed_schema(spark, landing, fmt) for t, (landing, _) in sheets.items()}
    queries = [start_refresh(spark, landing, table, spec, silver_dir, gold_dir, as_of, schema=schemas[table], fmt=fmt,
                             checkpoint=os.path.join(checkpoint_base, table), files_per_batch=files_per_batch,
                             refresh_each_batch=False, marker=marker)
               for table, (landing, spec) in sheets.items()]
    for q in queries:
        q.awaitTermination()
    for table, (landing, _) in sheets.items():
        ledger_of(spark, silver_dir, table, marker).advance(landing, fmt, _options(fmt), schemas[table])
    return not gold_is_current(spark, silver_dir, gold_dir) and refresh_gold(spark, silver_dir, gold_dir)

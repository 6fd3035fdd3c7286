"""Landing, loading and snapshots (S-01..S-09).

Everything writes to a caller-given base path on shared storage (by default a
folder under ``spark.checkpoint.dir``), never to a machine-local temp folder.
Loads and snapshots are published (``sources.versions``): readers see the tables
of the last whole version, whatever is being written or failed.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fieldpulse.operators.clean import CleanSpec, clean_sheet
from fieldpulse.sources.versions import Manifest, Versions

LOAD_LOG_SCHEMA = "source string, ingested_at timestamp, filepath string, rows_total long"
REPORT_SCHEMA = "source string, table string, rows long, columns int, rejected long, version long, error string"
#: Column that holds the text of a landed line which does not fit its declared schema.
CORRUPT = "_corrupt_record"


def latest_file(spark: SparkSession, directory: str, prefix: str, suffix: str = "") -> str | None:
    """S-04: newest file by *name* order (not mtime) among ``prefix*suffix``.

    Lists with the ``binaryFile`` source; selecting only ``path`` prunes the
    content column, so no file body is read. One value reaches the driver.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*{suffix}")
             .load(directory).select("path"))
    row = files.agg(F.max("path").alias("p")).first()
    return row["p"] if row else None


def declared_schema(columns: list[str], spec: CleanSpec | None, typed: dict[str, object] | None = None) -> StructType:
    """The declared types of a CSV sheet: percentages by the sheet's name rule are doubles (so that C-03 applies), the rest text.

    ``typed`` overrides single columns by Spark types. Amounts and times stay
    text: the cleaning rules coerce them cell by cell.
    """
    def kind(name: str):
        if typed and name in typed:
            return typed[name]
        return DoubleType() if spec is not None and spec.is_percent is not None and spec.is_percent(name) and name not in spec.amounts else StringType()

    return StructType([StructField(c, kind(c)) for c in columns])


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a landed CSV sheet, from its header."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_landed(spark: SparkSession, path: str, fmt: str = "csv", schema: StructType | None = None, strict: bool = False) -> DataFrame:
    """S-01/S-02 read side: a landed sheet under its declared schema.

    A CSV line that does not fit the schema (a cell that is no number, cells too
    many or too few) keeps its text in ``CORRUPT`` (null on sound lines); with ``strict`` it fails
    the read. A header with other names, or in another order, always does. Other formats
    carry their own types, and have no such column. Without a schema all cells are text.
    """
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    schema = schema or declared_schema(csv_header(spark, path), None)
    reader = spark.read.option("header", True).option("multiLine", True).option("enforceSchema", False)
    if strict:
        return reader.option("mode", "FAILFAST").schema(schema).csv(path)
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(full).csv(path)


def write_table(df: DataFrame, base: str, name: str = "table", sources: dict | None = None) -> Manifest:
    """S-05: full refresh of one table: written beside the old one, then published in its place."""
    return Versions(df.sparkSession, base).publish({name: df}, sources)


def read_table(spark: SparkSession, base: str, name: str = "table") -> DataFrame:
    """The published rows of a table, without rejected lines."""
    now = Versions(spark, base).current()
    if now is None or name not in now.tables:
        raise LookupError(f"no table {name} is published under {base}")
    df = now.read(spark, name)
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT) if CORRUPT in df.columns else df


def rejects(spark: SparkSession, base: str, name: str) -> DataFrame:
    """(table, line): the lines of a loaded sheet that did not fit its declared schema."""
    df = Versions(spark, base).current().read(spark, name)
    lines = df.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line")) if CORRUPT in df.columns else spark.createDataFrame([], "line string")
    return lines.select(F.lit(name).alias("table"), "line")


def append_load_log(spark: SparkSession, log_path: str, source: str, filepath: str, rows_total: int,
                    ingested_at: datetime | None = None) -> None:
    """S-06: append one row to the load log table."""
    ts = ingested_at or datetime.now(timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(source, ts, filepath, int(rows_total))], LOAD_LOG_SCHEMA) \
        .write.mode("append").parquet(log_path)


@dataclass(frozen=True)
class Sheet:
    """A landed sheet: where it is, how it is cleaned, and its declared CSV schema (default: from header and spec)."""

    path: str
    spec: CleanSpec | None = None
    schema: StructType | None = None


def _loaded(spark: SparkSession, sheet: Sheet, as_of: str, fmt: str, strict: bool) -> DataFrame:
    schema = sheet.schema
    if fmt == "csv" and schema is None:
        schema = declared_schema(csv_header(spark, sheet.path), sheet.spec)
    raw = read_landed(spark, sheet.path, fmt, schema, strict)
    return raw if sheet.spec is None else clean_sheet(raw, sheet.spec, as_of)


def _quality(df: DataFrame) -> list[Column]:
    """What is observed while a sheet is written (C-11)."""
    bad = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
    return [F.count_if(bad).alias("rejected")]


def ingest_sheets(spark: SparkSession, sheets: dict[str, Sheet | tuple], out_base: str,
                  log_path: str, source: str, as_of: str, fmt: str = "csv",
                  isolate_errors: bool = True, log_table: str | None = None) -> list[dict]:
    """S-01/S-02/S-06: load each sheet, clean it, publish it under ``out_base``, log the load.

    ``sheets`` maps a table name to a ``Sheet`` (or ``(path, spec)``). With
    ``isolate_errors`` (survey workbook) a failing sheet is reported, keeps its
    published version, and the others still load; without it (study workbook) lines
    must fit the schema and the first error propagates. Rows and rejected
    lines are observed during the one write, so no sheet is scanned twice.
    The load log gets one row, with the rows of ``log_table`` (default: the first sheet).
    """
    versions = Versions(spark, out_base)
    results = []
    for table, sheet in sheets.items():
        sheet = sheet if isinstance(sheet, Sheet) else Sheet(*sheet)
        result = {"source": source, "table": table, "rows": None, "columns": None, "rejected": None, "version": None, "error": None}
        try:
            df = _loaded(spark, sheet, as_of, fmt, strict=not isolate_errors)
            done = versions.publish({table: df}, {"source": source, "path": sheet.path}, {table: _quality(df)})
            seen = done.metrics[table]
            result |= {"rows": seen["rows"] - seen["rejected"], "rejected": seen["rejected"], "version": done.version,
                       "columns": len([c for c in df.columns if c != CORRUPT])}
        except Exception as exc:  # per-sheet isolation, as the reference does
            if not isolate_errors:
                raise
            result["error"] = str(exc)
        results.append(result)
    counted = log_table or next(iter(sheets))
    rows = next((r["rows"] for r in results if r["table"] == counted and r["error"] is None), None)
    if rows is not None:
        paths = [(s if isinstance(s, Sheet) else Sheet(*s)).path for s in sheets.values()]
        append_load_log(spark, log_path, source, ";".join(paths), rows)
    return results


def load_report(spark: SparkSession, results: list[dict]) -> DataFrame:
    """S-03: what the loads observed, one row a sheet: source, table, rows, columns, rejected, version, error."""
    names = [f.split(" ")[0] for f in REPORT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in results], REPORT_SCHEMA)


def write_snapshot(df: DataFrame, base: str, ingest_ts: str) -> None:
    """S-09: keep every landed version, under ``ingest_ts=<ts>`` (written again, it replaces itself)."""
    (df.withColumn("ingest_ts", F.lit(ingest_ts)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("ingest_ts").parquet(base))


def read_current(spark: SparkSession, base: str) -> DataFrame:
    """S-09: the newest landed version (partition filter on the max ``ingest_ts``)."""
    all_versions = spark.read.parquet(base)
    newest = all_versions.agg(F.max("ingest_ts").alias("m")).first()["m"]
    return all_versions.filter(F.col("ingest_ts") == newest).drop("ingest_ts")


def read_or_compute(spark: SparkSession, base: str, compute, token: str | None = None) -> DataFrame:
    """S-08: serve the published table if it was made from ``token``, else compute it, publish it and serve that.

    ``token`` is the version of what the table is made from (see ``source_token``); None serves
    any published copy. The written copy is served in any case, so a lost executor re-reads files
    instead of computing the analytics again.
    """
    now = Versions(spark, base).current()
    if now is None or (token is not None and now.sources.get("token") != token):
        now = write_table(compute(), base, sources={"token": token})
    return now.read(spark, "table")


def source_token(spark: SparkSession, base: str) -> str | None:
    """The staleness token of tables made from what is published under ``base``: its current version."""
    now = Versions(spark, base).current()
    return None if now is None else f"{now.version}"


def snapshot_json(brief_long: DataFrame, risks: DataFrame, brief_text: DataFrame, updated_at: str) -> DataFrame:
    """S-07: the snapshot as one JSON document, one row ``document`` (brief, risks with details, formatted brief, time).

    Nulls stay in the document. The inputs are the gold tables; each is folded to
    one value, the three are unioned and combined by a single aggregate (no join).
    """
    b = brief_long.agg(F.collect_list(F.struct("section", "key", "measure", "value")).alias("brief"))
    r = risks.agg(F.collect_list(F.struct(*risks.columns)).alias("risks"))
    bt, rt = b.schema["brief"].dataType, r.schema["risks"].dataType
    none = F.lit(None)
    u = (b.select("brief", none.cast(rt).alias("risks"), none.cast("string").alias("formatted_brief"))
         .unionByName(r.select(none.cast(bt).alias("brief"), "risks", none.cast("string").alias("formatted_brief")))
         .unionByName(brief_text.select(none.cast(bt).alias("brief"), none.cast(rt).alias("risks"),
                                        F.col("brief").alias("formatted_brief"))))
    doc = u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("brief", "risks", "formatted_brief")]) \
        .select(F.to_json(F.struct("brief", "risks", "formatted_brief", F.lit(updated_at).alias("updated_at")),
                          {"ignoreNullFields": "false"}).alias("document"))
    return doc


def ingest_all(spark: SparkSession, survey_sheets: dict[str, str | Sheet], study_path: str | Sheet, out_base: str,
               log_path: str, as_of: str, fmt: str = "csv") -> DataFrame:
    """S-03: load the survey workbook (sheet errors isolated) and the study workbook
    (errors propagate), log both loads, and return the load report: one row a sheet, with what was
    observed while it was written.

    ``survey_sheets`` maps the survey table names (``survey_main``,
    ``survey_receiver``, ...) to landed paths or ``Sheet``s; of paths only
    ``survey_main`` is cleaned, as in the reference. ``read_table`` reads what was loaded.
    """
    from fieldpulse.operators.clean import STUDY_MAIN_SPEC, SURVEY_MAIN_SPEC

    def sheet(landed: Sheet | str, spec: CleanSpec | None) -> Sheet:
        return landed if isinstance(landed, Sheet) else Sheet(landed, spec)

    sheets = {t: sheet(p, SURVEY_MAIN_SPEC if t == "survey_main" else None) for t, p in survey_sheets.items()}
    results = ingest_sheets(spark, sheets, out_base, log_path, "survey", as_of, fmt,
                            isolate_errors=True, log_table="survey_main")
    results += ingest_sheets(spark, {"study_main": sheet(study_path, STUDY_MAIN_SPEC)}, out_base, log_path,
                             "study", as_of, fmt, isolate_errors=False)
    return load_report(spark, results)


def refresh_snapshot(activity: DataFrame, study: DataFrame, gold_dir: str, updated_at: str,
                     m=None, s=None, token: str | None = None) -> Manifest:
    """S-07 / S-08 producer: ``brief``, ``risks`` (with details), ``brief_text`` and ``snapshot`` (JSON), published together.

    The analytics run once: text and JSON are made from the written copies of brief and risks (staged
    as a version of their own), and all four switch at once. With a ``token`` a snapshot that was made from it is served as it is.
    """
    from fieldpulse.model import ADAPTER_ACTIVITY, ADAPTER_STUDY
    from fieldpulse.operators import brief, risks

    m, s = m or ADAPTER_ACTIVITY, s or ADAPTER_STUDY
    spark = activity.sparkSession
    versions = Versions(spark, gold_dir)
    now = versions.current()
    if now is not None and token is not None and now.sources.get("token") == token:
        return now
    staged = Versions(spark, os.path.join(gold_dir, "staged")).publish(
        {"brief": brief.brief_long(activity, study, m, s), "risks": risks.risk_table(activity, study, m, s)}, {"token": token})
    b, r = staged.read(spark, "brief"), staged.read(spark, "risks")
    text = brief.brief_text(b, r, as_of_label=updated_at)
    done = versions.publish({"brief": b, "risks": r, "brief_text": text, "snapshot": snapshot_json(b, r, text, updated_at)},
                            {"token": token, "updated_at": updated_at})
    versions.retain()
    Versions(spark, os.path.join(gold_dir, "staged")).retain(1)
    return done

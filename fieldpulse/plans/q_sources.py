"""Registered queries: catalog, row counts and run bookkeeping (S-10..S-15).

The run-log operators are exercised on ``events`` read as a job log: each
event is one run of one target (``event_type`` is the target, an ``error``
event is a failed fetch, any other event delivered a file), the day of
``ts`` is the run.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from fieldpulse.operators import runlog
from fieldpulse.operators.clean import STUDY_MAIN_SPEC, SURVEY_MAIN_SPEC
from fieldpulse.plans.oracle import with_adapter
from fieldpulse.plans.q_brief import _DELAYED as DELAYED, B06_BODY, B06_CTES, risk_parts
from fieldpulse.plans.q_clean import _LANDED_STUDY, _LANDED_SURVEY, _clean_study_body, _clean_survey_body
from fieldpulse.plans.registry import REGISTRY
from fieldpulse.session import shared_dir
from fieldpulse.sources import catalog, store
from fieldpulse.sources.files import Files
from fieldpulse.sources.landing import landed_study_main, landed_survey_main, write_csv_sheet
from fieldpulse.sources.versions import Versions
from fieldpulse.streaming.ledger import MARKER
from fieldpulse.streaming.refresh import gold, run_refresh_once

R = REGISTRY
RELATIONS = ("activity", "study", "receiver", "shotpoint", "recording")


def _counts(ws):
    tables = {n: getattr(ws, n) for n in RELATIONS}
    tables["_ingestion_log"] = None  # not loaded yet: counts 0, as the health check reports
    return catalog.table_row_counts(ws.spark, tables)


_COUNTS_SQL = "\nUNION ALL\n".join(
    [f"SELECT '{n}' AS \"table\", COUNT(*) AS rows FROM {n}" for n in RELATIONS]
    + ["SELECT '_ingestion_log', CAST(0 AS BIGINT)"])


@R.query("s11_row_counts", with_adapter(_COUNTS_SQL), ("S-11",))
def _s11(ws):
    return _counts(ws)


@R.query("s12_ingest_summary", with_adapter(
    f"SELECT * FROM ({_COUNTS_SQL}) WHERE NOT starts_with(\"table\", '_')"), ("S-12",))
def _s12(ws):
    return catalog.ingest_summary(_counts(ws))


@R.query("s10_schema_listing", None, ("S-10",))
def _s10(ws):
    ws.register_views()
    return catalog.schema_text(catalog.schema_listing(ws.spark, list(RELATIONS)))


def _results(ws):
    e = ws.raw.events
    failed = F.col("event_type") == "error"
    return e.select(
        F.to_date("ts").cast("string").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.when(~failed, F.concat(F.lit("export_"), F.col("event_id").cast("string"), F.lit(".parquet")))
         .alias("file"),
        F.when(failed, F.concat(F.lit("target "), F.col("event_type"), F.lit(" failed"))).alias("error"))


@R.query("s13_run_rollup", """
WITH r AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, event_id AS seq,
         CASE WHEN event_type != 'error' THEN 'export_' || CAST(event_id AS VARCHAR) || '.parquet' END AS file,
         CASE WHEN event_type = 'error' THEN 'target ' || event_type || ' failed' END AS error
  FROM events)
SELECT run_id, COUNT(*) AS n_targets, COUNT(file) AS n_files, COUNT(error) AS n_errors,
       COUNT(file) > 0 AS success, arg_max(file, CASE WHEN file IS NOT NULL THEN seq END) AS latest_file
FROM r GROUP BY run_id""", ("S-13",))
def _s13(ws):
    return runlog.run_rollup(_results(ws))


def _job_log(ws):
    e = ws.raw.events
    return e.select(F.col("event_id").alias("job_id"), F.col("ts").alias("timestamp"),
                    (F.col("event_type") != "error").alias("success"))


@R.query("s15_recent_runs", """
SELECT event_id AS job_id, ts AS "timestamp", event_type != 'error' AS success
FROM events ORDER BY ts DESC, event_id DESC LIMIT 20""", ("S-15", "F-11"))
def _s15(ws):
    return runlog.recent_runs(_job_log(ws))


@R.query("s15_scheduler_status", """
WITH last AS (SELECT event_id, event_type != 'error' AS success FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)
SELECT (SELECT COUNT(*) FROM events) AS total_syncs, (SELECT MAX(ts) FROM events) AS last_sync_at,
       last.event_id AS last_job_id, last.success AS last_success FROM last""", ("S-15",))
def _s15b(ws):
    return runlog.scheduler_status(_job_log(ws))


# ------------------------------------------------ landing, loading, publishing (S-01..S-09, ST-01, ST-02)
#: Landed CSV lines whose year is no number: every so many activities.
BAD_LINES = 41
_CLEANED = _LANDED_SURVEY + ",\ncleaned AS (" + _clean_survey_body() + "),\n" + _LANDED_STUDY + ",\ncleaned_study AS (" + _clean_study_body() + ")"
_SOUND_SURVEY = f"(SELECT * FROM activity WHERE activity_id % {BAD_LINES} <> 0)"


def _land_csv(ws):
    """The derived sheets as landed CSV, some survey lines broken: {table: Sheet}."""
    base = shared_dir(ws.spark, "landed")
    survey, study = landed_survey_main(ws.activity), landed_study_main(ws.study)
    broken = F.substring("NAMA_KEGIATAN", 5, 20).cast("long") % BAD_LINES == 0
    write_csv_sheet(survey, f"{base}/survey_main", {"TAHUN": broken})
    write_csv_sheet(study, f"{base}/study_main")
    return {"survey_main": store.Sheet(f"{base}/survey_main", SURVEY_MAIN_SPEC, survey.schema),
            "study_main": store.Sheet(f"{base}/study_main", STUDY_MAIN_SPEC, study.schema)}, base


@R.query("s01_ingest_csv", with_adapter(_clean_survey_body(), ctes=_LANDED_SURVEY.replace("FROM activity)", f"FROM {_SOUND_SURVEY})")), ("S-01", "C-01", "C-03"))
def _s01(ws):
    sheets, base = _land_csv(ws)
    store.ingest_sheets(ws.spark, {"survey_main": sheets["survey_main"]}, f"{base}/silver", f"{base}/log", "survey", ws.as_of)
    return store.read_table(ws.spark, f"{base}/silver", "survey_main")


# an empty CSV cell is a missing one
@R.query("s02_ingest_study", with_adapter(_clean_study_body(), ctes=_LANDED_STUDY.replace("validator AS", "NULLIF(validator, '') AS")), ("S-02", "C-02"))
def _s02(ws):
    sheets, base = _land_csv(ws)
    store.ingest_sheets(ws.spark, {"study_main": sheets["study_main"]}, f"{base}/silver", f"{base}/log", "study", ws.as_of, isolate_errors=False)
    return store.read_table(ws.spark, f"{base}/silver", "study_main")


@R.query("s03_s06_load_report", with_adapter(f"""
SELECT 'survey' AS source, 'survey_main' AS "table", COUNT(CASE WHEN activity_id % {BAD_LINES} <> 0 THEN 1 END) AS rows, 30 AS columns,
       COUNT(CASE WHEN activity_id % {BAD_LINES} = 0 THEN 1 END) AS rejected, COUNT(CASE WHEN activity_id % {BAD_LINES} <> 0 THEN 1 END) AS logged FROM activity
UNION ALL SELECT 'survey', 'survey_receiver', COUNT(*), 3, 0, NULL FROM receiver
UNION ALL SELECT 'survey', 'survey_shotpoint', NULL, NULL, NULL, NULL
UNION ALL SELECT 'study', 'study_main', COUNT(*), 15, 0, COUNT(*) FROM study"""), ("S-03", "S-06"))
def _s03(ws):
    """Load both workbooks, one survey sheet missing: what was observed, and what the load log has."""
    sheets, base = _land_csv(ws)
    ws.receiver.write.option("header", True).csv(f"{base}/receiver")
    survey = {"survey_main": sheets["survey_main"], "survey_receiver": store.Sheet(f"{base}/receiver", None, ws.receiver.schema),
              "survey_shotpoint": f"{base}/not_there"}
    report = store.ingest_all(ws.spark, survey, sheets["study_main"], f"{base}/silver", f"{base}/log", ws.as_of)
    log = ws.spark.read.parquet(f"{base}/log").select(F.col("source").alias("s"), F.col("rows_total").alias("logged"))
    mine = (F.col("source") == F.col("s")) & F.col("table").endswith("_main")
    return report.join(log, mine, "left").select("source", "table", "rows", "columns", "rejected", "logged")


_BY_REGION = "SELECT '{0}' AS reader, region, COUNT(*) AS n, ROUND(SUM(planned_amount), 0) AS planned FROM activity {1} GROUP BY region"


@R.query("s05_s09_publish", with_adapter(
    _BY_REGION.format("before", "WHERE status = 'Done'") + " UNION ALL " + _BY_REGION.format("after", "")), ("S-05", "S-09"))
def _s05(ws):
    """Publish twice; a reader that resolved the first version keeps it whole while the second one is published."""
    base = shared_dir(ws.spark, "published")
    store.write_table(ws.activity.where(F.col("status") == "Done").select("region", "planned_amount"), base)
    before = Versions(ws.spark, base).current()
    store.write_table(ws.activity.select("region", "planned_amount"), base)
    after = Versions(ws.spark, base).current()

    def summary(reader, version):
        return version.read(ws.spark, "table").groupBy("region").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("planned_amount"), 0).alias("planned")).select(F.lit(reader).alias("reader"), "region", "n", "planned")

    return summary("before", before).unionByName(summary("after", after))


_RISK_CTES, _RISK_BODY = risk_parts()


@R.query("s07_s08_snapshot", with_adapter(f"""
SELECT 'brief' AS part, section AS a, key AS b, measure AS c, value FROM ({B06_BODY})
UNION ALL SELECT 'risk', severity, category, message, rule FROM ({_RISK_BODY})
UNION ALL SELECT 'detail', activity_name, work_area, CAST(days_since_planned_start AS VARCHAR), resource_p50 FROM (
  SELECT * {DELAYED} ORDER BY resource_p50 DESC, activity_id LIMIT 3)""", ctes=B06_CTES + ",\n" + _RISK_CTES.strip()), ("S-07", "S-08", "R-05"))
def _s07(ws):
    """The JSON snapshot, read back: a stale one is made anew, a fresh one is served."""
    base = shared_dir(ws.spark, "snapshot")
    store.refresh_snapshot(ws.activity.limit(0), ws.study, base, ws.as_of, token="1")
    store.refresh_snapshot(ws.activity, ws.study, base, ws.as_of, token="2")
    made = store.refresh_snapshot(ws.activity.limit(0), ws.study, base, ws.as_of, token="2")
    form = ("struct<brief:array<struct<section:string,key:string,measure:string,value:double>>,risks:array<struct<rule:int,severity:string,category:string,"
            "message:string,details:array<struct<activity_name:string,work_area:string,resource_p50:double,days_since_planned_start:bigint>>,action:string>>>")
    doc = made.read(ws.spark, "snapshot").select(F.from_json("document", form).alias("d"))
    brief_rows = doc.select(F.inline("d.brief")).select(F.lit("brief").alias("part"), F.col("section").alias("a"), F.col("key").alias("b"), F.col("measure").alias("c"), "value")
    risk_rows = doc.select(F.inline("d.risks"))
    details = risk_rows.select(F.inline("details"))
    return (brief_rows
            .unionByName(risk_rows.select(F.lit("risk").alias("part"), F.col("severity").alias("a"), F.col("category").alias("b"), F.col("message").alias("c"), F.col("rule").cast("double").alias("value")))
            .unionByName(details.select(F.lit("detail").alias("part"), F.col("activity_name").alias("a"), F.col("work_area").alias("b"),
                                        F.col("days_since_planned_start").cast("string").alias("c"), F.col("resource_p50").alias("value"))))


def _on_sheets(sql: str) -> str:
    """Brief SQL over the cleaned sheets (``act``, ``stu``) with their own literals."""
    for ours, theirs in (("FROM activity", "FROM act"), ("FROM study", "FROM stu"), ("'Running%'", "'Sedang%'"), ("'Done'", "'Selesai'"), ("'Not started'", "'Belum Mulai'"),
                         ("'BUILDING'", "'Seismik 2D'"), ("'MACHINERY'", "'Seismik 3D'"), ("'FURNITURE'", "'Survey Lainnya'")):
        sql = sql.replace(ours, theirs)
    return sql


@R.query("st01_02_stream_refresh", with_adapter(B06_BODY, ctes=_CLEANED + """,
act AS (SELECT REALISASI_STATUS_PELAKSANAAN AS status, NILAI_AFE_INVESTASI AS planned_amount, REALISASI_AFE_INVESTASI AS realised_amount,
        RR_TOTAL_P50_MMBOE AS resource_p50, P_REALISASI_KEGIATAN AS progress_pct, JENIS_KEGIATAN AS kind, AREA_KEGIATAN AS area,
        REGION_SKK AS region, HOLDING AS holding FROM cleaned),
stu AS (SELECT REALISASI_STATUS_PELAKSANAAN AS status, RENCANA_ANGGARAN_AFE_INVESTASI AS planned_budget,
        REALISASI_ANGGARAN_AFE_INVESTASI AS realised_budget, TIPE_STUDI AS study_type FROM cleaned_study),""" + _on_sheets(B06_CTES)), ("ST-01", "ST-02"), headline=True)
def _st(ws):
    """Exports in parts read over several batches, then an older one that comes late and a newer one that isn't closed; serve gold."""
    base = shared_dir(ws.spark, "stream-refresh")
    landing = {t: os.path.join(base, "landing", t) for t in ("survey_main", "study_main")}
    sheets = {"survey_main": (landing["survey_main"], SURVEY_MAIN_SPEC), "study_main": (landing["study_main"], STUDY_MAIN_SPEC)}
    survey = landed_survey_main(ws.activity)

    def tick():
        run_refresh_once(ws.spark, sheets, os.path.join(base, "silver"), os.path.join(base, "gold"), ws.as_of, os.path.join(base, "checkpoints"), files_per_batch=2)

    survey.repartition(4, "NAMA_KEGIATAN").write.parquet(os.path.join(landing["survey_main"], "KegiatanSurvey_0002"))
    landed_study_main(ws.study).write.parquet(os.path.join(landing["study_main"], "KegiatanStudy_0001"))
    tick()
    part = survey.where(F.col("AREA_KEGIATAN") == "Offshore")
    for name in ("KegiatanSurvey_0001", "KegiatanSurvey_0003"):
        part.write.parquet(os.path.join(landing["survey_main"], name))
    Files(ws.spark).delete(os.path.join(landing["survey_main"], "KegiatanSurvey_0003", MARKER))
    tick()
    return gold(ws.spark, os.path.join(base, "gold")).read(ws.spark, "brief")

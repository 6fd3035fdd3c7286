"""Sinks, landing, run bookkeeping and the incremental refresh stream."""

import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from fieldpulse.operators import runlog
from fieldpulse.operators.clean import STUDY_MAIN_SPEC, SURVEY_MAIN_SPEC
from fieldpulse.sources import catalog, store
from fieldpulse.sources.files import Files
from fieldpulse.sources.landing import landed_study_main, landed_survey_main, write_csv_sheet
from fieldpulse.sources.versions import VersionConflict, Versions
from fieldpulse.streaming.ledger import ExportLedger
from fieldpulse.streaming.refresh import current_version, gold, run_refresh_once


def test_latest_file_by_name(spark, scratch):
    os.makedirs(scratch)
    for name in ("KegiatanSurvey_2025_01.xlsx", "KegiatanSurvey_2024_12.xlsx", "KegiatanStudy_2026.xlsx",
                 "other.txt"):
        with open(os.path.join(scratch, name), "w") as f:
            f.write("x")
    # written last (newest mtime) but not last by name
    with open(os.path.join(scratch, "KegiatanSurvey_2024_01.xlsx"), "w") as f:
        f.write("x")
    got = store.latest_file(spark, scratch, "KegiatanSurvey", ".xlsx")
    assert got.endswith("KegiatanSurvey_2025_01.xlsx")
    assert store.latest_file(spark, scratch, "Nothing", ".xlsx") is None


def land(spark, sheet, path, bad=None):
    write_csv_sheet(sheet, path, bad)
    return store.Sheet(path, SURVEY_MAIN_SPEC if "NAMA_KEGIATAN" in sheet.columns else STUDY_MAIN_SPEC, sheet.schema)


def test_ingest_isolates_bad_sheet_and_logs(spark, ws, scratch):
    landing, silver, log = (os.path.join(scratch, x) for x in ("landing", "silver", "log"))
    sheet = landed_survey_main(ws.activity).limit(50)
    sheets = {"survey_main": land(spark, sheet, os.path.join(landing, "main")),
              "survey_receiver": (os.path.join(landing, "missing"), None)}
    res = {r["table"]: r for r in store.ingest_sheets(spark, sheets, silver, log, "survey", ws.as_of)}
    assert res["survey_main"]["rows"] == 50 and res["survey_main"]["error"] is None
    assert res["survey_receiver"]["error"]
    logged = spark.read.parquet(log).collect()
    assert len(logged) == 1 and logged[0].rows_total == 50 and logged[0].source == "survey"
    loaded = store.read_table(spark, silver, "survey_main")
    assert loaded.count() == 50 and dict(loaded.dtypes)["NILAI_AFE_INVESTASI"] == "double"
    with pytest.raises(LookupError):
        store.read_table(spark, silver, "survey_receiver")
    with pytest.raises(Exception):
        store.ingest_sheets(spark, {"study_main": (os.path.join(landing, "missing"), STUDY_MAIN_SPEC)}, silver, log, "study", ws.as_of, isolate_errors=False)
    # a later load whose main sheet fails leaves the loaded one in place
    store.ingest_sheets(spark, {"survey_main": (os.path.join(landing, "missing"), SURVEY_MAIN_SPEC)}, silver, log, "survey", ws.as_of)
    assert store.read_table(spark, silver, "survey_main").count() == 50 and spark.read.parquet(log).count() == 1


def test_lines_that_do_not_fit_are_rejected(spark, scratch):
    os.makedirs(os.path.join(scratch, "s"))
    with open(os.path.join(scratch, "s", "sheet.csv"), "w") as f:
        f.write("NAMA_KEGIATAN,TAHUN,P_X,REALISASI_STATUS_PELAKSANAAN,RENCANA_WAKTU_MULAI\n"
                "a,1999,150,Belum Mulai,1998-04-03T10:11:12.5\nb,n/a,5,Selesai,1998/04/03\nc,1998,five,Selesai,\n"
                "d,1997,-5,Selesai,1998-04-03T00:00:00Z\n\"e\nf\",1996,,Selesai,03/04/1998\ng,1995\nh,1994,1,Selesai,x,too,many\n")
    columns = store.csv_header(spark, os.path.join(scratch, "s"))
    schema = store.declared_schema(columns, SURVEY_MAIN_SPEC, {"TAHUN": IntegerType()})
    sheet = store.Sheet(os.path.join(scratch, "s"), SURVEY_MAIN_SPEC, schema)
    silver, log = os.path.join(scratch, "silver"), os.path.join(scratch, "log")
    (res,) = store.ingest_sheets(spark, {"survey_main": sheet}, silver, log, "survey", "1999-06-30 12:00:00")
    assert (res["rows"], res["rejected"], res["error"]) == (3, 4, None)
    got = {r.NAMA_KEGIATAN: (r.TAHUN, r.P_X, str(r.RENCANA_WAKTU_MULAI), r.IS_DELAYED) for r in store.read_table(spark, silver, "survey_main").collect()}
    # percentages are typed, so they are clamped
    assert got == {"a": (1999, 100.0, "1998-04-03 10:11:12.500000", True), "d": (1997, 0.0, "1998-04-03 00:00:00", False), "e\nf": (1996, 0.0, "1998-04-03 00:00:00", False)}
    lines = {r.line.strip() for r in store.rejects(spark, silver, "survey_main").collect()}
    assert {line.split(",")[0] for line in lines} == {"b", "c", "g", "h"}
    with pytest.raises(Exception):  # the study book fails as a whole
        store.ingest_sheets(spark, {"study_main": sheet}, silver, log, "study", "1999-06-30 12:00:00", isolate_errors=False)
    # a header with other names fails the sheet
    other = store.Sheet(sheet.path, sheet.spec, store.declared_schema(["X", *columns[1:]], SURVEY_MAIN_SPEC))
    (res,) = store.ingest_sheets(spark, {"survey_main": other}, silver, log, "survey", "1999-06-30 12:00:00")
    assert res["error"] and store.read_table(spark, silver, "survey_main").count() == 3
    # without a declared schema the name rule types percentages
    (res,) = store.ingest_sheets(spark, {"survey_main": (sheet.path, SURVEY_MAIN_SPEC)}, silver, log, "survey", "1999-06-30 12:00:00")
    assert (res["rows"], res["rejected"]) == (4, 3)


def test_empty_sheet_loads_as_an_empty_table(spark, ws, scratch):
    sheet = landed_survey_main(ws.activity).limit(0)
    path = os.path.join(scratch, "p")
    sheet.write.parquet(path)
    (res,) = store.ingest_sheets(spark, {"survey_main": (path, SURVEY_MAIN_SPEC)}, os.path.join(scratch, "s"), os.path.join(scratch, "l"), "survey", ws.as_of, fmt="parquet")
    assert (res["rows"], res["rejected"], res["columns"]) == (0, 0, 30)
    assert store.read_table(spark, os.path.join(scratch, "s"), "survey_main").count() == 0


def test_loads_scan_each_sheet_once(spark, ws, scratch):
    """Rows and rejected lines are observed: the plan of the write has one scan and no aggregate over it."""
    sheet = land(spark, landed_survey_main(ws.activity).limit(10), os.path.join(scratch, "main"))
    df = store._loaded(spark, sheet, ws.as_of, "csv", False)
    plan = df.observe(Observation(), F.count(F.lit(1)).alias("rows"), *store._quality(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan and "HashAggregate" not in plan


def test_publish_switches_all_tables_at_once(spark, scratch):
    v = Versions(spark, scratch)
    assert v.current() is None
    one = v.publish({"a": spark.range(3), "b": spark.range(4)}, {"from": "x"}, expect=0)
    assert (one.version, one.metrics["a"], one.sources) == (1, {"rows": 3}, {"from": "x"})

    # the second version is half written: readers see the first one, whole
    fails = spark.range(5).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        v.publish({"a": spark.range(9), "b": fails})
    assert v.current() == one and [v.current().read(spark, t).count() for t in "ab"] == [3, 4]

    two = v.publish({"a": spark.range(7)}, metrics={"a": [F.max("id").alias("m")]})
    assert two.version == 3 and two.metrics["a"] == {"rows": 7, "m": 6}
    assert [two.read(spark, t).count() for t in "ab"] == [7, 4]  # b is carried over
    assert one.read(spark, "a").count() == 3  # who resolved version 1 still has it
    with pytest.raises(VersionConflict):
        v.publish({"a": spark.range(1)}, expect=1)
    assert v.current() == two

    # retention: a grace time, then the old version and the failed one go, what the kept one uses stays
    assert v.retain(keep=1) == []
    assert v.retain(keep=1, grace_seconds=0) == [1]
    assert [two.read(spark, t).count() for t in "ab"] == [7, 4]
    assert len(Files(spark).names(os.path.join(scratch, "data"))) == 2
    assert v.publish({"b": spark.range(0)}).read(spark, "b").count() == 0


def test_two_publishers_of_one_version(spark, scratch):
    v = Versions(spark, scratch)
    v.publish({"a": spark.range(1)})
    assert v.files.claim(os.path.join(scratch, "versions", "000000000002.claim"))  # somebody else has begun
    assert not v.files.claim(os.path.join(scratch, "versions", "000000000002.claim"))
    assert v.publish({"a": spark.range(2)}).version == 3 and v.current().read(spark, "a").count() == 2


def test_read_or_compute_and_snapshots(spark, scratch):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(len(calls) * 5)

    p = os.path.join(scratch, "gold")
    assert store.read_or_compute(spark, p, compute, "1").count() == 5
    assert store.read_or_compute(spark, p, compute, "1").count() == 5
    assert store.read_or_compute(spark, p, lambda: 1 / 0).count() == 5  # without a token any copy is served
    assert len(calls) == 1
    assert store.read_or_compute(spark, p, compute, "2").count() == 10  # stale: made anew
    assert store.read_or_compute(spark, p, lambda: 1 / 0, "2").count() == 10
    base = os.path.join(scratch, "silver")
    assert store.source_token(spark, base) is None
    store.write_table(spark.range(1), base)
    before = store.source_token(spark, base)
    store.write_table(spark.range(1), base)
    assert store.source_token(spark, base) != before
    snap = os.path.join(scratch, "bronze")
    store.write_snapshot(spark.range(3), snap, "20240101_000000")
    store.write_snapshot(spark.range(7), snap, "20240102_000000")
    store.write_snapshot(spark.range(7), snap, "20240102_000000")  # repeated: no second copy
    assert store.read_current(spark, snap).count() == 7


def test_counts_summary_and_schema(spark, ws):
    counts = catalog.table_row_counts(spark, {"activity": ws.activity, "_ingestion_log": None})
    got = {r.table: r.rows for r in counts.collect()}
    assert got["_ingestion_log"] == 0 and got["activity"] == ws.activity.count()
    assert catalog.ingest_summary(counts, reference_like=True).count() == 0  # the reference's LIKE '_%'
    assert [r.table for r in catalog.ingest_summary(counts).collect()] == ["activity"]
    ws.register_views()
    health = catalog.table_row_counts(spark, catalog.views_or_none(spark, ["study", "no_such_table"]))
    assert {r.table: r.rows for r in health.collect()} == {"study": ws.study.count(), "no_such_table": 0}
    text = catalog.schema_text(catalog.schema_listing(spark, ["study"])).first().text
    assert text.startswith("TABLE study:\n  - study_id (bigint)")


def test_run_bookkeeping(spark):
    files = spark.createDataFrame([
        ("r1", 1, "Survey_export.xlsx", "/l/s1"), ("r1", 2, "survey_b.xlsx", "/l/s2"),
        ("r1", 3, "Study.xlsx", "/l/t1"), ("r2", 4, "SURVEY.xlsx", "/l/s3")],
        "run_id string, seq int, name string, path string")
    got = {r.run_id: r for r in runlog.assign_datasets(files).collect()}
    assert (got["r1"].survey_path, got["r1"].study_path, got["r1"].ready) == ("/l/s2", "/l/t1", True)
    assert (got["r2"].missing, got["r2"].ready) == (["study"], False)
    results = spark.createDataFrame([("r1", 1, "f1", None), ("r1", 2, None, "e"), ("r2", 3, None, "e")],
                                    "run_id string, seq int, file string, error string")
    roll = {r.run_id: r for r in runlog.run_rollup(results).collect()}
    assert (roll["r1"].n_files, roll["r1"].n_errors, roll["r1"].success, roll["r1"].latest_file) == (1, 1, True, "f1")
    assert roll["r2"].success is False
    targets = spark.createDataFrame([("survey",), ("study",)], "name string")
    assert runlog.select_target(targets, "study").count() == 1
    with pytest.raises(runlog.UnknownTarget, match="study, survey"):
        runlog.select_target(targets, "nope")


def refresh_setup(scratch):
    landing = {t: os.path.join(scratch, "landing", t) for t in ("survey_main", "study_main")}
    sheets = {"survey_main": (landing["survey_main"], SURVEY_MAIN_SPEC), "study_main": (landing["study_main"], STUDY_MAIN_SPEC)}
    return landing, sheets, *(os.path.join(scratch, x) for x in ("silver", "gold", "ck"))


def current_survey(spark, silver):
    return current_version(spark, os.path.join(silver, "survey_main"))


def test_stream_refresh_incremental_and_idempotent(spark, ws, scratch):
    from fieldpulse.model import DOMAIN_ACTIVITY, DOMAIN_STUDY
    from fieldpulse.operators.brief import brief_long
    from fieldpulse.operators.clean import clean_sheet
    from fieldpulse.operators.risks import risk_table

    landing, sheets, silver, gold_dir, ck = refresh_setup(scratch)
    survey = landed_survey_main(ws.activity)
    landed_study_main(ws.study).write.parquet(os.path.join(landing["study_main"], "KegiatanStudy_001"))
    survey.limit(100).write.parquet(os.path.join(landing["survey_main"], "KegiatanSurvey_001"))
    assert run_refresh_once(spark, sheets, silver, gold_dir, ws.as_of, ck)
    assert current_survey(spark, silver).count() == 100
    before = gold(spark, gold_dir)

    # a newer full export lands: it replaces the current table and the gold brief follows
    survey.write.parquet(os.path.join(landing["survey_main"], "KegiatanSurvey_002"))
    assert run_refresh_once(spark, sheets, silver, gold_dir, ws.as_of, ck)
    assert current_survey(spark, silver).count() == ws.activity.count()
    now = gold(spark, gold_dir)
    cleaned = clean_sheet(survey, SURVEY_MAIN_SPEC, ws.as_of), clean_sheet(landed_study_main(ws.study), STUDY_MAIN_SPEC, ws.as_of)
    for table, expected in (("brief", brief_long(*cleaned, DOMAIN_ACTIVITY, DOMAIN_STUDY)), ("risks", risk_table(*cleaned, DOMAIN_ACTIVITY, DOMAIN_STUDY))):
        got = now.read(spark, table)
        assert "details" in got.columns or table == "brief"
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    # who resolved the gold before the switch keeps both of its tables
    total = before.read(spark, "brief").filter((F.col("section") == "survey") & (F.col("measure") == "total")).first().value
    assert total == 100 and before.read(spark, "risks").count() >= 1

    # nothing new: re-running processes no batch and changes nothing
    assert run_refresh_once(spark, sheets, silver, gold_dir, ws.as_of, ck) is False
    assert gold(spark, gold_dir) == now


def test_export_in_parts_over_several_batches(spark, ws, scratch):
    landing, sheets, silver, gold_dir, ck = refresh_setup(scratch)
    survey = landed_survey_main(ws.activity)
    many = survey.count()
    # four parts with rows and one without, one file a batch
    survey.repartition(4, "NAMA_KEGIATAN").unionByName(survey.limit(0).coalesce(1)).write.parquet(os.path.join(landing["survey_main"], "0002"))
    landed_study_main(ws.study).write.parquet(os.path.join(landing["study_main"], "0001"))
    assert run_refresh_once(spark, sheets, silver, gold_dir, ws.as_of, ck, files_per_batch=1)
    assert current_survey(spark, silver).count() == many
    ledger = ExportLedger(spark, os.path.join(silver, "survey_main"))
    (state,) = ledger.exports(landing["survey_main"]).collect()
    assert (state.export, state.files_read, state.rows, state.batches) == ("0002", 4, many, 4)
    now = gold(spark, gold_dir)

    # a late older export changes nothing, and neither does a newer one that is not closed
    survey.limit(10).write.parquet(os.path.join(landing["survey_main"], "0001"))
    survey.limit(20).write.parquet(os.path.join(landing["survey_main"], "0003"))
    marker = os.path.join(landing["survey_main"], "0003", "_SUCCESS")
    os.remove(marker)
    assert run_refresh_once(spark, sheets, silver, gold_dir, ws.as_of, ck, files_per_batch=1) is False
    assert current_survey(spark, silver).count() == many and gold(spark, gold_dir) == now
    assert {r.export: r.rows for r in ledger.exports(landing["survey_main"]).collect()} == {"0001": 10, "0002": many, "0003": 20}

    # once it is closed it becomes current, with all its rows
    open(marker, "w").close()
    assert run_refresh_once(spark, sheets, silver, gold_dir, ws.as_of, ck, files_per_batch=1)
    assert current_survey(spark, silver).count() == 20 and ledger.current_export() == "0003"

    # old rows go, the current ones stay, nothing is read again
    assert ledger.retire(keep=1) == ["0001", "0002"]
    assert run_refresh_once(spark, sheets, silver, gold_dir, ws.as_of, ck) is False
    assert current_survey(spark, silver).count() == 20


def test_replayed_batch_is_recorded_once(spark, ws, scratch):
    from fieldpulse.streaming.ledger import EXPORT, FILE

    ledger = ExportLedger(spark, scratch)
    rows = ws.study.limit(30).withColumns({EXPORT: F.lit("a b=1"), FILE: F.concat(F.lit("f"), (F.col("study_id") % 3).cast("string"))})
    for _ in range(2):
        ledger.record(rows, 5)
    assert ledger.entries().agg(F.sum("rows"), F.count("*")).first()[:] == (30, 3)
    ledger.versions.publish({}, {"export": "a b=1"})
    assert ledger.current().count() == 30 and set(ledger.current().columns) == set(ws.study.columns)


def test_continuous_refresh_publishes_with_each_whole_export(spark, ws, scratch):
    from fieldpulse.streaming.refresh import start_refresh

    landing, sheets, silver, gold_dir, ck = refresh_setup(scratch)
    landed_study_main(ws.study).write.parquet(os.path.join(landing["study_main"], "1"))
    landed_survey_main(ws.activity).repartition(3).write.parquet(os.path.join(landing["survey_main"], "1"))
    for table, (land_dir, spec) in sheets.items():
        start_refresh(spark, land_dir, table, spec, silver, gold_dir, ws.as_of, checkpoint=os.path.join(ck, table), files_per_batch=2).awaitTermination()
    assert gold(spark, gold_dir).sources == {"survey_main": "1", "study_main": "1"}


def test_refresh_snapshot_and_json(spark, ws, scratch):
    import json

    made = store.refresh_snapshot(ws.activity, ws.study, scratch, "1999-06-30T12:00:00", token="7")
    doc = json.loads(made.read(spark, "snapshot").first().document)
    assert set(doc) == {"brief", "risks", "formatted_brief", "updated_at"}
    assert doc["updated_at"] == "1999-06-30T12:00:00"
    # nulls stay: the key of a total is there, and null
    assert any(x["section"] == "survey" and x["measure"] == "total" and x["key"] is None for x in doc["brief"])
    assert doc["formatted_brief"].startswith("=== EXECUTIVE BRIEF ===")
    assert len(doc["risks"]) == made.read(spark, "risks").count()
    delay = next(r for r in doc["risks"] if r["rule"] == 1)
    assert len(delay["details"]) == 3 and set(delay["details"][0]) == {"activity_name", "work_area", "resource_p50", "days_since_planned_start"}
    assert all(r["details"] is None for r in doc["risks"] if r["rule"] != 1)
    # a fresh snapshot is served, a stale one is made anew, also from empty tables
    assert store.refresh_snapshot(ws.activity.limit(0), ws.study, scratch, "x", token="7") == made
    newer = store.refresh_snapshot(ws.activity.limit(0), ws.study.limit(0), scratch, "x", token="8")
    assert newer.version > made.version and json.loads(newer.read(spark, "snapshot").first().document)["risks"] == []


def test_ingest_all(spark, ws, scratch):
    landing = os.path.join(scratch, "landing")
    main = land(spark, landed_survey_main(ws.activity).limit(40), os.path.join(landing, "main"), {"TAHUN": F.col("TAHUN") < 0})
    ws.receiver.limit(30).write.option("header", True).csv(os.path.join(landing, "receiver"))
    study = land(spark, landed_study_main(ws.study).limit(20), os.path.join(landing, "study"))
    report = store.ingest_all(
        spark, {"survey_main": main, "survey_receiver": os.path.join(landing, "receiver"),
                "survey_shotpoint": os.path.join(landing, "not_there")},
        study, os.path.join(scratch, "silver"), os.path.join(scratch, "log"), ws.as_of)
    got = {r.table: (r.source, r.rows, r.rejected, r.error is None) for r in report.collect()}
    assert got == {"survey_main": ("survey", 40, 0, True), "survey_receiver": ("survey", 30, 0, True),
                   "survey_shotpoint": ("survey", None, None, False), "study_main": ("study", 20, 0, True)}
    log = {r.source: r.rows_total for r in spark.read.parquet(os.path.join(scratch, "log")).collect()}
    assert log == {"survey": 40, "study": 20}
    assert store.read_table(spark, os.path.join(scratch, "silver"), "survey_receiver").count() == 30


def test_stream_tick_recovers_from_a_lost_gold_rebuild(spark, ws, scratch):
    """A tick that died after its silver write but before gold is repaired by the next tick."""
    from fieldpulse.streaming.refresh import gold_is_current, start_refresh

    landing, sheets, silver, gold_dir, ck = refresh_setup(scratch)
    landed_survey_main(ws.activity).write.parquet(os.path.join(landing["survey_main"], "S_001"))
    landed_study_main(ws.study).write.parquet(os.path.join(landing["study_main"], "T_001"))
    # the "crashed" tick: streams commit their batches, the gold rebuild never happens
    for table, (land_dir, spec) in sheets.items():
        start_refresh(spark, land_dir, table, spec, silver, gold_dir, ws.as_of, checkpoint=os.path.join(ck, table),
                      refresh_each_batch=False).awaitTermination()
    assert not gold_is_current(spark, silver, gold_dir)
    # next tick: no new input, but the gold tables are rebuilt from the current exports
    assert run_refresh_once(spark, sheets, silver, gold_dir, ws.as_of, ck) is True
    assert gold_is_current(spark, silver, gold_dir)
    assert gold(spark, gold_dir).read(spark, "brief").count() > 0
    assert run_refresh_once(spark, sheets, silver, gold_dir, ws.as_of, ck) is False  # nothing to do


def test_batch_rows_are_written_without_a_sort(spark, scratch):
    """A task's memory does not grow with its part file (Spark's event log of one batch in a process of its own)."""
    import glob
    import json
    import subprocess
    import sys

    root, scratch = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), scratch.removeprefix("file:")
    os.makedirs(os.path.join(scratch, "events"))
    run = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from fieldpulse.session import build_session
from fieldpulse.streaming.ledger import EXPORT, FILE, ExportLedger
spark = build_session("local[2]", extra={{"spark.eventLog.enabled": "true", "spark.eventLog.rolling.enabled": "false",
                      "spark.eventLog.compress": "false", "spark.eventLog.dir": "file://{scratch}/events"}})
rows = spark.range(0, 5000, 1, 2).withColumns({{EXPORT: F.concat(F.lit("e"), F.col("id") % 3), FILE: F.concat(F.lit("f"), F.col("id") % 6)}})
ExportLedger(spark, "{scratch}/silver").record(rows, 0)
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    (log,) = glob.glob(os.path.join(scratch, "events", "*"))
    with open(log) as f:
        ended = [e["Task Metrics"] for e in map(json.loads, f) if e["Event"] == "SparkListenerTaskEnd"]
    writers = [m for m in ended if m["Output Metrics"]["Records Written"] == 2500]
    assert len(writers) == 2 and all(m["Peak Execution Memory"] == 0 for m in writers)


def test_batch_of_more_exports_than_open_files(spark, scratch):
    """One task with more exports than it may keep open: every row is under its own export, and the session's setting is as before."""
    from fieldpulse.streaming.ledger import EXPORT, FILE, OPEN_FILES

    ledger, key, n = ExportLedger(spark, scratch), "spark.sql.maxConcurrentOutputFileWriters", OPEN_FILES + 8
    rows = spark.range(0, 50 * n, 1, 1).withColumns({EXPORT: F.concat(F.lit("e"), F.col("id") % n), FILE: F.concat(F.lit("f"), F.col("id") % n)})
    before = spark.conf.get(key, None)
    for _ in range(2):
        ledger.record(rows, 3)
    assert spark.conf.get(key, None) == before
    assert {(r.export, r.file): r.rows for r in ledger.entries().collect()} == {(f"e{i}", f"f{i}"): 50 for i in range(n)}
    for name in ("e0", f"e{n - 1}"):
        ledger.versions.publish({}, {"export": name})
        assert sorted(r.id for r in ledger.current().collect()) == [int(name[1:]) + n * i for i in range(50)]
    spark.conf.set(key, "5")
    try:
        ledger.record(rows, 4)
        assert spark.conf.get(key) == "5"
    finally:
        spark.conf.unset(key)

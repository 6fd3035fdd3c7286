"""Plan audit of guarded statements, statement reports, logged answers, technical detail, date coercion."""

import json
import os

import pytest
from pyspark.sql import functions as F

from fieldpulse.functions.columns import coerce_timestamp
from fieldpulse.functions.parallel import spread
from fieldpulse.model import ADAPTER_DETAIL
from fieldpulse.operators import catalogue, router, sqlguard

ALLOWED = ("activity", "study", "receiver", "shotpoint", "recording")


@pytest.fixture(scope="module")
def views(spark, ws):
    ws.register_views()
    ws.raw.customer.createOrReplaceTempView("secret")
    return spark


@pytest.mark.parametrize("sql", [
    "SELECT region, COUNT(*) AS n FROM activity GROUP BY region",
    "SELECT a.activity_name, r.n_receiver FROM activity a JOIN receiver r ON a.activity_id = r.activity_id WHERE a.year IN (SELECT MAX(year) FROM activity)",
    "SELECT s.study_name FROM study s, (SELECT MAX(area_km2) AS m FROM study) x WHERE s.area_km2 = x.m",
    "SELECT 1 AS one",
])
def test_allowed_statements_run(views, sql):
    assert sqlguard.run_guarded(views, sql, ALLOWED).count() >= 1


@pytest.mark.parametrize("sql, said", [
    ("SELECT java_method('java.lang.System', 'getProperty', 'user.home') AS x FROM study", "CallMethodViaReflection"),
    ("SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS x FROM study", "CallMethodViaReflection"),
    ("SELECT study_name FROM study WHERE study_type = try_reflect('java.lang.System', 'getProperty', 'user.home')", "Refused"),
    ("SELECT a.activity_name FROM activity a, secret s", "'secret'"),
    ("SELECT activity_name FROM activity WHERE activity_id IN (SELECT c_custkey FROM activity, secret)", "'secret'"),
    ("SELECT (SELECT MAX(c_name) FROM study, secret) AS x FROM study", "'secret'"),
    ("WITH activity AS (SELECT c_name FROM study, secret) SELECT c_name FROM activity", "'secret'"),
    ("SELECT * FROM study, parquet.`{path}`", "Not a table"),
    ("SELECT TRANSFORM(study_name) USING 'cat' AS (x) FROM study", "ScriptTransformation"),
])
def test_statements_that_reach_further_are_refused(views, scratch, sql, said):
    path = os.path.join(scratch, "p")
    views.range(3).write.parquet(path)
    with pytest.raises(sqlguard.GuardError, match=said):
        sqlguard.run_guarded(views, sql.format(path=path), ALLOWED)


def test_tables_of_the_catalog(views):
    views.sql("CREATE TABLE IF NOT EXISTS guarded_t USING parquet AS SELECT 1 AS a")
    views.sql("CREATE DATABASE IF NOT EXISTS guarded_db")
    views.sql("CREATE TABLE IF NOT EXISTS guarded_db.study USING parquet AS SELECT 1 AS a")
    try:
        assert sqlguard.run_guarded(views, "SELECT a FROM guarded_t", ("guarded_t",)).count() == 1
        # the name alone is allowed, not that of another database
        with pytest.raises(sqlguard.GuardError, match="guarded_db.study"):
            sqlguard.run_guarded(views, "SELECT x.a FROM guarded_t y, guarded_db.study x", ("guarded_t", "study"))
    finally:
        views.sql("DROP TABLE guarded_t")
        views.sql("DROP DATABASE guarded_db CASCADE")


def test_statement_report(views):
    rows = [("1", "SELECT region FROM activity", True), ("2", "SELECT region FROM activity WHERE year = 1", True), ("3", "SELECT region FROM activity WHERE year = 1", False),
            ("4", "SELECT nothing FROM activity", True), ("5", "DROP TABLE activity", True), ("6", "SELECT 1 / 0 AS x FROM activity WHERE 1 / 0 > activity_id", True)]
    report = sqlguard.statement_report(views, views.createDataFrame(rows, "id string, sql string, expects_rows boolean"), ALLOWED)
    got = {r.id: (r.success, r.passed, r.error) for r in report.collect()}
    assert got == {"1": (True, True, None), "2": (True, False, None), "3": (True, True, None), "4": (False, False, "UNRESOLVED_COLUMN.WITH_SUGGESTION"),
                   "5": (False, False, sqlguard.MSG_START), "6": (False, False, "DIVIDE_BY_ZERO")}
    one = sqlguard.report_summary(report).first()
    assert (one.statements, one.succeeded, one.passed, one.success_pct) == (6, 3, 2, 50.0) and one.avg_seconds >= 0
    empty = sqlguard.report_summary(sqlguard.statement_report(views, views.createDataFrame([], "id string, sql string, expects_rows boolean"), ALLOWED)).first()
    assert (empty.statements, empty.success_pct) == (0, None)


def test_logged_routes_follow_the_json_parser(spark):
    answers = ['{"route": "qualitative", "tables": "study_main", "intent": "x"}', '```json\n{"route": "composite"}\n```', "{bad json", 'so {"route": "precomputed"} it is',
               'Sure ```{"route": "precomputed"}``` ok', '{"route": "no such"}', "{}", "[]", "", None, "text", '{"route": "qualitative"} x', '{"route": "qualitative"} {}',
               '{"route": "qualitative"}, {}', '{}],[{}', '{}} {', '{"route": null}', "```\nno object\n```", '``` {"a": 1} then {"route": "qualitative"} ```', "\t\n{\"route\": \"composite\"} "]

    def expected(answer):
        text = (answer or "").strip()
        if "```" in text and "{" in text and "}" in text:
            text = text[text.index("{"):text.rindex("}") + 1]
        try:
            obj = json.loads(text)
        except json.JSONDecodeError:
            return ("quantitative", "llm_fallback")
        if not isinstance(obj, dict):
            return ("quantitative", "llm_fallback")
        return (obj.get("route") if obj.get("route") in router.VALID_ROUTES else "quantitative", "llm")

    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    got = {r.i: (r.p.route, r.p.method, r.p.tables, r.p.intent) for r in df.select("i", router.parse_logged_route(F.col("a"), F.lit("daftar survei")).alias("p")).collect()}
    assert {i: g[:2] for i, g in got.items()} == {i: expected(a) for i, a in enumerate(answers)}
    assert got[0][2:] == ("study_main", "x") and got[2][2:] == ("survey_main", "daftar survei")


def test_technical_detail_is_one_row_an_activity(spark, ws):
    got = catalogue.q29_technical_detail(ws.activity, ws.receiver, ws.shotpoint, ws.recording, "ACT-12")
    assert set(ADAPTER_DETAIL.survey_cols) <= set(got.columns)
    named = ws.activity.where(F.col("activity_name").startswith("ACT-12"))
    assert got.count() == named.count() == got.select("activity_id").distinct().count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 3
    # the three detail tables together have every line
    assert sum(df.count() for df in (ws.receiver, ws.shotpoint, ws.recording)) == ws.raw.lineitem.count()


def test_year_range_reaches_the_scan(ws):
    plan = catalogue.q01_count_in_year(ws.activity, dated_by="planned_start")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_building_plans_runs_nothing(spark, ws):
    tracker, docs = spark.sparkContext.statusTracker(), ws.raw.documents
    spark.sparkContext.setJobGroup("plans", "plans")
    try:
        router.route_questions(spread(docs), "text")
        sqlguard.audit_statements(docs.groupBy("doc_id").agg(F.first("text").alias("text")), "text")
        assert not tracker.getJobIdsForGroup("plans")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("text, value", [
    ("1998-04-03T00:00:00.000", "1998-04-03 00:00:00"), ("1998-04-03T10:11:12Z", "1998-04-03 10:11:12"), ("1998-04-03 10:11:12.5", "1998-04-03 10:11:12.500000"),
    ("1998-04-03T10:11:12+07:00", "1998-04-03 03:11:12"), ("1998-04-03T00:30:00-0130", "1998-04-03 02:00:00"), ("1998/04/03", "1998-04-03 00:00:00"), ("1998/4/3 01:02:03", "1998-04-03 01:02:03"),
    (" 1998-04-03 ", "1998-04-03 00:00:00"), ("03/04/1998", "1998-04-03 00:00:00"), ("3/4/1998 10:11:12", "1998-04-03 10:11:12"), ("1998-04-03 10:11", "1998-04-03 10:11:00"),
    ("1998", None), ("1998-04", None), ("10:11:12", None), ("1998-02-30", None), ("1998-04-03 25:00:00", None), ("garbage", None), ("", None), (None, None), ("1998-04-03 tail", None),
])
def test_dates(spark, text, value):
    row = spark.createDataFrame([(text,)], "t string").select(coerce_timestamp("t").alias("t")).first()
    assert (None if row.t is None else str(row.t)) == value

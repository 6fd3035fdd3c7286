"""Statement extraction, audit, guarded execution and attempt roll-up."""

import pytest
from pyspark.sql import functions as F

from fieldpulse.operators import sqlguard

EXTRACT_CASES = [
    ("```sql\nselect * from survey_main;\n```", "SELECT * from survey_main"),
    ("Here you go: with x as (select 1) select * from x; trailing", "WITH x as (select 1) select * from x"),
    ("  SELECT a FROM study_main  ", "SELECT a FROM study_main"),
    ("no statement here; really", "no statement here"),
    ("", ""),
    (None, ""),
    ("selection is not select", "SELECT"),
    ("```\nSELECT 1\n```", "SELECT 1"),
    ("Withé select 2", "SELECT 2"),
]

AUDIT_CASES = [
    ("SELECT * FROM survey_main", True, ""),
    ("  select 1", True, ""),
    ("DELETE FROM survey_main", False, sqlguard.MSG_START),
    ("SELECT 1; DROP TABLE x", False, sqlguard.MSG_FORBIDDEN + r"\bDROP\b"),
    ("SELECT * FROM survey_main -- c", False, sqlguard.MSG_FORBIDDEN + "--"),
    ("SELECT 1; SELECT 2;", False, sqlguard.MSG_FORBIDDEN + ";.*;"),
    ("SELECT 1;\nSELECT 2;", True, ""),
    ("SELECT * FROM survey_main s JOIN study_main t ON 1=1", True, ""),
    ("SELECT * FROM _ingestion_log", True, ""),
    ("SELECT * FROM Survey_Main", False,
     sqlguard.MSG_INVALID + "{'Survey_Main'}" + sqlguard.MSG_VALID
     + "{'study_main', 'survey_main', 'survey_receiver', 'survey_recording', 'survey_shotpoint'}"),
    ("WITH x AS (SELECT 1) SELECT * FROM x", False,
     sqlguard.MSG_INVALID + "{'x'}" + sqlguard.MSG_VALID
     + "{'study_main', 'survey_main', 'survey_receiver', 'survey_recording', 'survey_shotpoint'}"),
    ("SELECT created_at FROM study_main", True, ""),
    ("SELECT 1 FROM study_main WHERE x = 'update'", False, sqlguard.MSG_FORBIDDEN + r"\bUPDATE\b"),
]


def test_extract(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXTRACT_CASES)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", sqlguard.extract_sql(F.col("t")).alias("s")).collect()}
    for i, (_, want) in enumerate(EXTRACT_CASES):
        assert got[i] == want, EXTRACT_CASES[i]


def test_audit(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(AUDIT_CASES)], "i int, t string")
    got = {r.i: r.a for r in df.select("i", sqlguard.audit_sql(F.col("t")).alias("a")).collect()}
    for i, (_, ok, reason) in enumerate(AUDIT_CASES):
        assert (got[i].is_valid, got[i].reason) == (ok, reason), AUDIT_CASES[i]


def test_run_guarded(spark, ws):
    ws.register_views()
    allowed = ("activity", "study")
    df = sqlguard.run_guarded(spark, "SELECT status, COUNT(*) AS n FROM activity GROUP BY status", allowed)
    assert df.count() == 3
    with pytest.raises(sqlguard.GuardError):
        sqlguard.run_guarded(spark, "DROP TABLE activity", allowed)
    with pytest.raises(sqlguard.GuardError, match="Invalid table"):
        sqlguard.run_guarded(spark, "SELECT * FROM orders", allowed)


def test_attempt_log(spark):
    rows = [("q1", 1, "s1", "boom"), ("q1", 2, "s2", None), ("q1", 3, "s3", None),
            ("q2", 1, "a", "e1"), ("q2", 2, "b", "e2"), ("q2", 3, "c", "e3"), ("q2", 4, "d", None),
            ("q3", 1, "only", "bad")]
    df = spark.createDataFrame(rows, "qid string, attempt int, sql string, error string")
    got = {r.qid: r for r in sqlguard.attempt_log(df, "qid", "attempt").collect()}
    assert (got["q1"].attempts, got["q1"].success, got["q1"].last_sql, got["q1"].last_error) == (2, True, "s2", None)
    assert (got["q2"].attempts, got["q2"].success, got["q2"].last_sql, got["q2"].last_error) == (3, False, "c", "e3")
    assert (got["q3"].attempts, got["q3"].success) == (1, False)


def test_cte_names_accepted_only_when_not_strict(spark):
    stmts = ["WITH x AS (SELECT 1 FROM study_main), y AS (SELECT 2) SELECT * FROM x JOIN y ON 1=1",
             "WITH x AS (SELECT 1) SELECT * FROM nope"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(stmts)], "i int, t string")
    strict = {r.i: r.a for r in df.select("i", sqlguard.audit_sql(F.col("t")).alias("a")).collect()}
    loose = {r.i: r.a for r in df.select("i", sqlguard.audit_sql(F.col("t"), strict=False).alias("a")).collect()}
    assert strict[0].is_valid is False and "{'x', 'y'}" in strict[0].reason
    assert loose[0].is_valid is True
    assert loose[1].is_valid is False and "{'nope'}" in loose[1].reason

"""Registered queries: executive brief (B), risk rules (R), load validation (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldpulse.operators import brief, risks, validate
from fieldpulse.plans.oracle import with_adapter
from fieldpulse.plans.registry import REGISTRY
from fieldpulse.plans.sqltext import sql_str, unpivot

R = REGISTRY

SURVEY_KPI_SQL = """
  SELECT COUNT(*) AS total,
         COUNT(CASE WHEN status LIKE 'Running%' THEN 1 END) AS running,
         COUNT(CASE WHEN status = 'Done' THEN 1 END) AS done,
         COUNT(CASE WHEN status = 'Not started' THEN 1 END) AS not_started,
         ROUND(SUM(planned_amount), 0) AS total_planned,
         ROUND(SUM(realised_amount), 0) AS total_realised,
         ROUND(SUM(resource_p50), 2) AS total_resource,
         ROUND(AVG(progress_pct), 1) AS avg_progress,
         COUNT(CASE WHEN kind = 'BUILDING' THEN 1 END) AS kind_2d,
         COUNT(CASE WHEN kind = 'MACHINERY' THEN 1 END) AS kind_3d,
         COUNT(CASE WHEN kind = 'FURNITURE' THEN 1 END) AS kind_other,
         COUNT(CASE WHEN area = 'Onshore' THEN 1 END) AS onshore,
         COUNT(CASE WHEN area = 'Offshore' THEN 1 END) AS offshore
  FROM activity"""

STUDY_KPI_SQL = """
  SELECT COUNT(*) AS total,
         COUNT(CASE WHEN status = 'Not started' THEN 1 END) AS not_started,
         COUNT(CASE WHEN status = 'Done' THEN 1 END) AS done,
         ROUND(SUM(planned_budget), 0) AS total_budget,
         ROUND(SUM(realised_budget), 0) AS realised_budget
  FROM study"""

REGION_SQL = """
  SELECT region, COUNT(*) AS n_activities, ROUND(AVG(progress_pct), 1) AS avg_progress,
         ROUND(SUM(resource_p50), 1) AS total_resource, ROUND(SUM(planned_amount), 0) AS total_planned
  FROM activity GROUP BY region"""

HOLDING_SQL = """
  SELECT holding, COUNT(*) AS n_activities, ROUND(AVG(progress_pct), 1) AS avg_progress,
         ROUND(SUM(resource_p50), 1) AS total_resource
  FROM activity GROUP BY holding ORDER BY n_activities DESC, holding ASC NULLS LAST LIMIT 5"""


@R.query("b01_survey_kpis", with_adapter(SURVEY_KPI_SQL), ("B-01", "A-04", "F-09", "A-02"), headline=True)
def _b01(ws):
    return brief.survey_kpis(ws.activity)


@R.query("b02_study_kpis", with_adapter(STUDY_KPI_SQL), ("B-02",))
def _b02(ws):
    return brief.study_kpis(ws.study)


@R.query("b03_studies_by_type", with_adapter(
    "SELECT study_type, COUNT(*) AS n_studies FROM study GROUP BY study_type"), ("B-03", "A-08"))
def _b03(ws):
    return brief.studies_by_type(ws.study)


@R.query("b04_by_region", with_adapter(REGION_SQL), ("B-04", "A-05"), headline=True)
def _b04(ws):
    return brief.by_region(ws.activity)


@R.query("b05_top_holdings", with_adapter(HOLDING_SQL), ("B-05", "A-09"))
def _b05(ws):
    return brief.top_holdings(ws.activity)


B06_CTES = f"""
k AS ({SURVEY_KPI_SQL}),
rg AS ({REGION_SQL}),
hd AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n_activities DESC, holding ASC NULLS LAST) AS rank FROM ({HOLDING_SQL})),
sk AS ({STUDY_KPI_SQL}),
st AS (SELECT study_type, COUNT(*) AS n_studies FROM study GROUP BY study_type)"""

B06_BODY = f"""
{unpivot("k", "survey", "NULL", list(brief.SURVEY_KPI_NAMES))}
UNION ALL
{unpivot("rg", "region", "region", ["n_activities", "avg_progress", "total_resource", "total_planned"])}
UNION ALL
{unpivot("hd", "holding", "holding", ["n_activities", "avg_progress", "total_resource", "rank"])}
UNION ALL
{unpivot("sk", "study", "NULL", ["total", "not_started", "done", "total_budget", "realised_budget"])}
UNION ALL
{unpivot("st", "study_type", "study_type", ["n_studies"])}
"""


@R.query("b06_brief_long", with_adapter(B06_BODY, ctes=B06_CTES), ("B-06",), headline=True)
def _b06(ws):
    return brief.brief_long(ws.activity, ws.study)


@R.query("b07_brief_text", None, ("B-07", "A-12"))
def _b07(ws):
    a, s = ws.activity, ws.study
    return brief.brief_text(brief.brief_long(a, s), risks.risk_table(a, s), as_of_label=ws.as_of)


# ---------------------------------------------------------------- risk rules
_DELAYED = "FROM activity WHERE is_delayed AND resource_p50 > 0"


@R.query("r01_delayed_summary", with_adapter(
    f"SELECT COUNT(*) AS n_delayed, SUM(resource_p50) AS total_resource {_DELAYED}"), ("R-01", "A-07"))
def _r01(ws):
    return risks.delayed_summary(ws.activity)


@R.query("r01_delayed_top3", with_adapter(
    f"SELECT activity_id, activity_name, work_area, resource_p50, days_since_planned_start {_DELAYED} "
    "ORDER BY resource_p50 DESC, activity_id LIMIT 3"), ("R-01", "A-10"))
def _r01t(ws):
    return risks.delayed_top(ws.activity)


_ABSORB = """SELECT ROUND(SUM(realised_amount), 0) AS realised, ROUND(SUM(planned_amount), 0) AS planned
             FROM activity WHERE planned_amount > 0"""


@R.query("r02_absorption_summary", with_adapter(
    f"SELECT realised, planned, realised / planned * 100 AS pct FROM ({_ABSORB})"), ("R-02", "F-10"))
def _r02(ws):
    return risks.absorption_summary(ws.activity)


@R.query("r03_study_status", with_adapter(
    "SELECT COUNT(*) AS total, COUNT(CASE WHEN status = 'Not started' THEN 1 END) AS not_started FROM study"),
    ("R-03",))
def _r03(ws):
    return risks.study_status_summary(ws.study)


_PERMIT = """FROM activity WHERE status = 'Not started'
  AND (permit_a_pct < 100 OR permit_b_pct < 100 OR procurement_pct < 100)
  AND planned_start IS NOT NULL"""


@R.query("r04_permit_blocked", with_adapter(f"SELECT COUNT(*) AS n {_PERMIT}"), ("R-04", "F-07"))
def _r04(ws):
    return risks.permit_blocked(ws.activity).agg(F.count(F.lit(1)).alias("n"))


def _risk_sql(threshold: float, study_filter: str = "") -> str:
    return with_adapter(*risk_parts(threshold, study_filter)[::-1])


def risk_parts(threshold: float = risks.ABSORPTION_THRESHOLD_PCT, study_filter: str = "") -> tuple[str, str]:
    """CTEs and body of the risk table's DuckDB text."""
    r = risks
    return f"""
s1 AS (SELECT COUNT(*) AS n, SUM(resource_p50) AS total {_DELAYED}),
s2 AS (SELECT realised, planned, realised / planned * 100 AS pct FROM ({_ABSORB})),
s3 AS (SELECT COUNT(*) AS total, COUNT(CASE WHEN status = 'Not started' THEN 1 END) AS nb FROM study {study_filter}),
s4 AS (SELECT COUNT(*) AS n {_PERMIT})""", f"""
SELECT 1 AS rule, {sql_str(r.SEVERITY_HIGH)} AS severity, {sql_str(r.CATEGORY_DELAY)} AS category,
       CAST(n AS VARCHAR) || ' delayed activities with total potential ' || format('{{:.1f}}', total) || ' MMBOE' AS message,
       {sql_str(r.ACTION_DELAY)} AS action FROM s1 WHERE n > 0
UNION ALL
SELECT 2, {sql_str(r.SEVERITY_MEDIUM)}, {sql_str(r.CATEGORY_ABSORPTION)},
       'Realised spend is only ' || format('{{:.1f}}', pct) || '% ($' || format('{{:,.0f}}', realised) || ' of $' || format('{{:,.0f}}', planned) || ')',
       {sql_str(r.ACTION_ABSORPTION)} FROM s2 WHERE COALESCE(planned, 0) > 0 AND pct < {threshold}
UNION ALL
SELECT 3, {sql_str(r.SEVERITY_HIGH)}, {sql_str(r.CATEGORY_STUDIES)},
       'All ' || CAST(total AS VARCHAR) || ' studies are still ''not started''',
       {sql_str(r.ACTION_STUDIES)} FROM s3 WHERE total > 0 AND total = nb
UNION ALL
SELECT 4, {sql_str(r.SEVERITY_MEDIUM)}, {sql_str(r.CATEGORY_PERMITS)},
       CAST(n AS VARCHAR) || ' activities held up by incomplete permits',
       {sql_str(r.ACTION_PERMITS)} FROM s4 WHERE n > 0
"""


_RISK_COLS = ("rule", "severity", "category", "message", "action")


@R.query("r05_risk_table", _risk_sql(risks.ABSORPTION_THRESHOLD_PCT), ("R-05", "R-01", "R-02", "R-03", "R-04"),
         headline=True)
def _r05(ws):
    return risks.risk_table(ws.activity, ws.study).select(*_RISK_COLS)


@R.query("r05_risk_table_threshold50", _risk_sql(50.0), ("R-02", "R-05"))
def _r05b(ws):
    return risks.risk_table(ws.activity, ws.study, threshold_pct=50.0).select(*_RISK_COLS)


@R.query("r05_risk_table_open_studies", _risk_sql(
    risks.ABSORPTION_THRESHOLD_PCT, "WHERE status = 'Not started'"), ("R-03", "R-05"))
def _r05c(ws):
    open_studies = ws.study.filter(F.col("status") == "Not started")
    return risks.risk_table(ws.activity, open_studies).select(*_RISK_COLS)


@R.query("r01_rule_details", with_adapter(
    f"SELECT 1 AS rule, activity_name, work_area, resource_p50, days_since_planned_start {_DELAYED} "
    "ORDER BY resource_p50 DESC, activity_id LIMIT 3"), ("R-01", "A-10"))
def _r01d(ws):
    return risks.rule_delay(ws.activity).select("rule", F.inline("details"))


# ---------------------------------------------------------------- validation
@R.query("v01_06_validation", with_adapter(
    ctes="a AS (SELECT COUNT(*) AS n, ROUND(SUM(planned_amount), 0) AS planned, "
         "ROUND(SUM(resource_p50), 2) AS resource FROM activity)", body="""
SELECT 'total_activities' AS "check", CAST(NULL AS VARCHAR) AS key, CAST(n AS DOUBLE) AS value FROM a
UNION ALL SELECT 'total_planned', NULL, planned FROM a
UNION ALL SELECT 'total_resource', NULL, resource FROM a
UNION ALL SELECT 'activities_per_status', status, CAST(COUNT(*) AS DOUBLE) FROM activity GROUP BY 1, 2
UNION ALL SELECT 'total_studies', NULL, CAST(COUNT(*) AS DOUBLE) FROM study
UNION ALL SELECT 'studies_per_type', study_type, CAST(COUNT(*) AS DOUBLE) FROM study GROUP BY 1, 2
"""), ("V-01", "V-02", "V-03", "V-04", "V-05", "V-06", "A-11"))
def _v(ws):
    return validate.validation_checks(ws.activity, ws.study)

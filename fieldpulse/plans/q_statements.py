"""Registered queries: logged classifier answers (T-03) and the report over a set of statements (T-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldpulse.operators import router, sqlguard
from fieldpulse.plans.oracle import with_adapter
from fieldpulse.plans.q_text import ADAPTER_TABLES, _infer_tables_sql
from fieldpulse.plans.registry import REGISTRY

R = REGISTRY

# Logged classifier answers around the users' questions: well-formed, fenced, broken, loose in prose, no object, unknown route.
_ANSWERS = (
    """'{"route": "qualitative", "tables": "both", "intent": "i"}'""",
    """'```json' || chr(10) || '{"route": "composite"}' || chr(10) || '```'""",
    """'{bad json'""",
    """'I say {"route": "precomputed"} here'""",
    """'Sure: ```{"route": "precomputed", "intent": null}``` ok'""",
    """'{"route": "other"}'""",
    """'[1]'""",
    "text",
    "NULL",
    """'  {"route": "qualitative"}  '""",
    """'{"route": "qualitative"} {}'""",
)
_ANSWER = "CASE (conv_id * 3 + turn) % 11 " + " ".join(f"WHEN {i} THEN {a}" for i, a in enumerate(_ANSWERS)) + " END"
_OBJECT = r"regexp_extract(answer, '(?s)\{.*\}')"


@R.query("t03_logged_routes", f"""
WITH q AS (SELECT conv_id, turn, text, {_ANSWER} AS answer FROM conversations WHERE role = 'user'),
x AS (SELECT *, CASE WHEN contains(answer, '```') AND {_OBJECT} <> '' THEN {_OBJECT} ELSE trim(answer) END AS o FROM q),
y AS (SELECT *, CASE WHEN json_valid(o) THEN coalesce(json_type(o) = 'OBJECT', false) ELSE false END AS good FROM x),
z AS (SELECT *, CASE WHEN good THEN json_extract_string(o, '$.route') END AS r FROM y)
SELECT conv_id, turn, CASE WHEN r IN ('quantitative', 'qualitative', 'precomputed', 'composite') THEN r ELSE 'quantitative' END AS route,
       CASE WHEN good THEN 'llm' ELSE 'llm_fallback' END AS method,
       CASE WHEN good THEN json_extract_string(o, '$.tables') ELSE {_infer_tables_sql('text')} END AS tables,
       CASE WHEN good THEN json_extract_string(o, '$.intent') ELSE text END AS intent
FROM z""", ("T-03",))
def _t03(ws):
    q = ws.raw.conversations.filter(F.col("role") == "user")
    return (q.withColumn("answer", F.expr(_ANSWER)).select("conv_id", "turn", router.parse_logged_route(F.col("answer"), F.col("text")).alias("p"))
            .select("conv_id", "turn", "p.route", "p.method", "p.tables", "p.intent"))


# a set of statements for each region: sound, without rows, against a table that is not allowed, and broken
_STATEMENTS = """
SELECT r_name || ' ' || k AS id, s || ' = ''' || r_name || '''' AS sql, k <> 'none' AS expects_rows FROM region, (VALUES
  ('all', 'SELECT activity_name FROM activity WHERE region'),
  ('none', 'SELECT study_name FROM study WHERE study_type'),
  ('other', 'SELECT a.activity_name FROM activity a, region r WHERE r.r_name'),
  ('broken', 'SELECT no_such_column FROM activity WHERE region')) AS v(k, s)"""


@R.query("t13_statement_report", with_adapter(ctes=f"st AS ({_STATEMENTS}), per AS (SELECT region, COUNT(*) AS n FROM activity GROUP BY 1)", body="""
SELECT id, sql, NOT (id LIKE '%other' OR id LIKE '%broken') AS success,
       CASE WHEN id LIKE '%all' THEN coalesce(per.n, 0) WHEN id LIKE '%none' THEN 0 END AS rows, expects_rows,
       (id LIKE '%all' AND coalesce(per.n, 0) > 0) OR id LIKE '%none' AS passed,
       CASE WHEN id LIKE '%other' THEN 'Invalid table(s): {''region''}. Valid tables: {''activity'', ''receiver'', ''recording'', ''shotpoint'', ''study''}'
            WHEN id LIKE '%broken' THEN 'UNRESOLVED_COLUMN.WITH_SUGGESTION' END AS error
FROM st LEFT JOIN per ON st.id = per.region || ' all'"""), ("T-13", "T-06"))
def _t13(ws):
    ws.register_views()
    ws.raw.region.createOrReplaceTempView("region")
    return sqlguard.statement_report(ws.spark, ws.spark.sql(_STATEMENTS), ADAPTER_TABLES).drop("seconds")

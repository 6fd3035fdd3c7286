"""Registered queries: routing, statement audit, reports and text merges (T-01..T-12).

Inputs: ``conversations`` (user turns are questions, assistant turns are
answers/attempts), ``documents`` (free text to extract and audit statements
from), ``pages`` (raw HTML), ``events`` (a request log: type as route, value
as elapsed seconds, ``props.k`` as rows returned).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldpulse.functions.regex import portable
from fieldpulse.operators import report, router, sqlguard
from fieldpulse.operators.catalogue import q02_total_planned, q16_high_potential_low_progress, \
    q21_technical_approval_share
from fieldpulse.plans.oracle import with_adapter
from fieldpulse.plans.registry import REGISTRY
from fieldpulse.plans.sqltext import sql_str

R = REGISTRY


# ------------------------------------------------------------ DuckDB renderings
def _route_case(text: str) -> tuple[str, str, str]:
    """CASE expressions (route, pattern, fixed tables) of the first matching rule."""
    routes, pats, fixed = [], [], []
    for route, patterns, tables in router.KEYWORD_RULES:
        for p in patterns:
            cond = f"regexp_matches(lower({text}), {sql_str(portable(p))})"
            routes.append(f"WHEN {cond} THEN {sql_str(route)}")
            pats.append(f"WHEN {cond} THEN {sql_str(p)}")
            fixed.append(f"WHEN {cond} THEN {sql_str(tables) if tables else 'NULL'}")
    return ("CASE " + " ".join(routes) + " END", "CASE " + " ".join(pats) + " END",
            "CASE " + " ".join(fixed) + " END")


def _infer_tables_sql(text: str) -> str:
    low = f"lower({text})"
    sv = " OR ".join(f"contains({low}, {sql_str(w)})" for w in router.SURVEY_KEYWORDS)
    st = " OR ".join(f"contains({low}, {sql_str(w)})" for w in router.STUDY_KEYWORDS)
    return (f"CASE WHEN ({sv}) AND ({st}) THEN 'both' WHEN ({st}) THEN 'study_main' "
            f"WHEN ({sv}) THEN 'survey_main' ELSE 'both' END")


_STRIP = sql_str(sqlguard._STRIP)


def _re2(pattern: str) -> str:
    """RE2 spelling of a Spark pattern: RE2's (?i) already folds Unicode case, and has no (?u)."""
    return sql_str(pattern.replace("(?isu)", "(?is)").replace("(?iu)", "(?i)"))


def _extract_sql_ctes(src: str, text: str, out: str) -> str:
    """CTE chain computing T-04 over ``src.text`` into ``out`` (keeps all src columns)."""
    fence, start = _re2(sqlguard._FENCE), _re2(sqlguard._START)
    return f"""{out}_a AS (
  SELECT *, COALESCE({text}, '') AS _raw FROM {src}),
{out}_b AS (
  SELECT *, CASE WHEN regexp_matches(_raw, {fence}) THEN regexp_extract(_raw, {fence}, 1) ELSE _raw END AS _cand
  FROM {out}_a),
{out}_c AS (
  SELECT *, regexp_replace(CASE WHEN regexp_extract(_cand, {start}, 1) != ''
                                THEN upper(regexp_extract(_cand, {start}, 1)) || regexp_extract(_cand, {start}, 2)
                                ELSE _cand END, {_STRIP}, '', 'g') AS _clean
  FROM {out}_b),
{out} AS (
  SELECT * EXCLUDE (_raw, _cand, _clean),
         CASE WHEN contains(_clean, ';') THEN regexp_replace(split_part(_clean, ';', 1), {_STRIP}, '', 'g')
              ELSE _clean END AS sql
  FROM {out}_c)"""


def _set_repr_sql(lst: str) -> str:
    return f"'{{' || array_to_string(list_transform(list_sort({lst}), lambda x: '''' || x || ''''), ', ') || '}}'"


def _audit_ctes(src: str, out: str, allowed: tuple[str, ...]) -> str:
    allowed_sql = "[" + ", ".join(sql_str(t) for t in allowed) + "]"
    allowed_log = "[" + ", ".join(sql_str(t) for t in allowed + (sqlguard.LOG_TABLE,)) + "]"
    frm, join = _re2(sqlguard._FROM), _re2(sqlguard._JOIN)
    whens = " ".join(
        f"WHEN regexp_matches(_up, {sql_str(portable(p))}) THEN {sql_str(sqlguard.MSG_FORBIDDEN + p)}"
        for p in sqlguard.FORBIDDEN_PATTERNS)
    return f"""{out}_a AS (
  SELECT *, regexp_replace(upper(COALESCE(sql, '')), {_STRIP}, '', 'g') AS _up,
         list_sort(list_distinct(list_concat(regexp_extract_all(COALESCE(sql, ''), {frm}, 1),
                                             regexp_extract_all(COALESCE(sql, ''), {join}, 1)))) AS _tables
  FROM {src}),
{out}_b AS (
  SELECT *, list_sort(list_filter(_tables, lambda x: NOT list_contains({allowed_log}, x))) AS _invalid
  FROM {out}_a),
{out} AS (
  SELECT * EXCLUDE (_up, _tables, _invalid),
         CASE WHEN NOT (starts_with(_up, 'SELECT') OR starts_with(_up, 'WITH')) THEN {sql_str(sqlguard.MSG_START)}
              {whens}
              WHEN len(_invalid) > 0 THEN {sql_str(sqlguard.MSG_INVALID)} || {_set_repr_sql('_invalid')}
                   || {sql_str(sqlguard.MSG_VALID)} || {_set_repr_sql(allowed_sql)}
              ELSE '' END AS reason,
         array_to_string(_tables, ',') AS tables, array_to_string(_invalid, ',') AS invalid_tables
  FROM {out}_b)"""


def _wrap(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body.strip()


# ------------------------------------------------------------------- routing
_R, _P, _FIX = _route_case("text")


@R.query("t01_03_route_questions", _wrap(f"""
q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')""", f"""
SELECT conv_id, turn, COALESCE({_R}, 'quantitative') AS route,
       COALESCE({_FIX}, {_infer_tables_sql('text')}) AS tables,
       {_P} AS matched_pattern,
       CASE WHEN {_P} IS NOT NULL THEN 'keyword' ELSE 'fallback' END AS method
FROM q"""), ("T-01", "T-02", "T-03"), headline=True)
def _t01(ws):
    q = ws.raw.conversations.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text"))
    return (router.route_questions(q, "text")
            .select("conv_id", "turn", "route", "tables", "matched_pattern", "method"))


@R.query("t02_infer_tables_documents", f"SELECT doc_id, {_infer_tables_sql('text')} AS tables FROM documents",
         ("T-02",))
def _t02(ws):
    from fieldpulse.functions.parallel import spread

    d = spread(ws.raw.documents.select("doc_id", "text"))
    return d.select("doc_id", router.infer_tables(F.col("text")).alias("tables"))


# ---------------------------------------------------------- extraction/audit
_AUDIT_DOCS = _wrap(
    _extract_sql_ctes("documents", "text", "ex") + ",\n" + _audit_ctes("ex", "au", sqlguard.DOMAIN_TABLES),
    "SELECT doc_id, sql, reason = '' AS is_valid, reason, tables, invalid_tables FROM au")


@R.query("t04_05_audit_documents", _AUDIT_DOCS, ("T-04", "T-05"), headline=True)
def _t04(ws):
    d = sqlguard.audit_statements(ws.raw.documents.select("doc_id", "text"), "text")
    return d.select("doc_id", "sql", "is_valid", "reason",
                    F.concat_ws(",", "tables").alias("tables"),
                    F.concat_ws(",", "invalid_tables").alias("invalid_tables"))


# Fixed value: the adapter's relations, the allow-list when auditing statements over them.
ADAPTER_TABLES = ("activity", "study", "receiver", "shotpoint", "recording")
_GUARDED = ("SELECT region, COUNT(*) AS n_activities, ROUND(SUM(resource_p50), 2) AS total_resource "
            "FROM activity GROUP BY region")


@R.query("t06_guarded_statement", with_adapter(_GUARDED), ("T-06",))
def _t06(ws):
    ws.register_views()
    return sqlguard.run_guarded(ws.spark, _GUARDED, ADAPTER_TABLES)


_ATTEMPTS = _wrap(
    "asst AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),\n"
    + _extract_sql_ctes("asst", "text", "ex") + ",\n" + _audit_ctes("ex", "au", sqlguard.DOMAIN_TABLES) + """,
tries AS (
  SELECT conv_id, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, sql,
         CASE WHEN reason = '' THEN NULL ELSE 'Validation: ' || reason END AS error
  FROM au QUALIFY rn <= 3),
g AS (
  SELECT conv_id, MIN(CASE WHEN error IS NULL THEN rn END) AS first_ok, COUNT(*) AS n FROM tries GROUP BY conv_id)""",
    """SELECT g.conv_id, CAST(COALESCE(g.first_ok, g.n) AS INTEGER) AS attempts, g.first_ok IS NOT NULL AS success,
       t.sql AS last_sql, CASE WHEN g.first_ok IS NOT NULL THEN NULL ELSE t.error END AS last_error
FROM g JOIN tries t ON t.conv_id = g.conv_id AND t.rn = COALESCE(g.first_ok, g.n)""")


@R.query("t07_attempt_log", _ATTEMPTS, ("T-07",))
def _t07(ws):
    a = sqlguard.audit_statements(
        ws.raw.conversations.filter(F.col("role") == "assistant").select("conv_id", "turn", "text"), "text")
    a = a.withColumn("error", F.when(F.col("is_valid"), F.lit(None).cast("string"))
                     .otherwise(F.concat(F.lit("Validation: "), F.col("reason"))))
    return sqlguard.attempt_log(a, "conv_id", "turn")


# ------------------------------------------------------------------- reports
def _simple_sql(cols: list[tuple[str, str]], src: str) -> str:
    parts = []
    for name, kind in cols:
        lab = sql_str(f"**{report.label(name)}**: ")
        if kind == "int":
            v = f"format('{{:,}}', {name})"
        else:
            v = (f"CASE WHEN abs({name}) > 1000000 THEN '$' || format('{{:,.0f}}', {name}) "
                 f"WHEN abs({name}) > 100 THEN format('{{:,.1f}}', {name}) "
                 f"ELSE format('{{:.1f}}', {name}) || '%' END")
        parts.append(f"{lab} || {v}")
    return f"SELECT {' || chr(10) || '.join(parts)} AS answer FROM ({src})"


@R.query("t08_simple_result_share", with_adapter(_simple_sql(
    [("approved", "int"), ("total", "int"), ("pct", "float")],
    "SELECT COUNT(CASE WHEN technical_approval = 'Yes' THEN 1 END) AS approved, COUNT(*) AS total, "
    "ROUND(CAST(COUNT(CASE WHEN technical_approval = 'Yes' THEN 1 END) AS DOUBLE) * 100 / COUNT(*), 1) AS pct "
    "FROM activity")), ("T-08",))
def _t08(ws):
    return report.simple_result(q21_technical_approval_share(ws.activity))


@R.query("t08_simple_result_money", with_adapter(_simple_sql(
    [("total_planned", "float")], "SELECT ROUND(SUM(planned_amount), 0) AS total_planned FROM activity")),
    ("T-08",))
def _t08b(ws):
    return report.simple_result(q02_total_planned(ws.activity))


@R.query("t09_list_report", None, ("T-09",))
def _t09(ws):
    df = q16_high_potential_low_progress(ws.activity)
    return report.list_report(df, [F.desc("resource"), F.asc("activity_name")])


@R.query("t10_result_digest", None, ("T-10",))
def _t10(ws):
    df = q16_high_potential_low_progress(ws.activity)
    return report.result_digest(df, [F.desc("resource"), F.asc("activity_name")])


# ----------------------------------------------------------- page text merge
def _page_sql() -> str:
    k = report.PAGE_TOTAL_CHARS // len("\n\n---  ---\n") + 1
    x = "html"
    body = f"regexp_extract({x}, '(?is)<body[^>]*>(.*)</body>', 1)"
    t = f"CASE WHEN {body} = '' THEN {x} ELSE {body} END"
    t = f"regexp_replace({t}, '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
                    ("&amp;", "&")):
        t = f"replace({t}, {sql_str(ent)}, {sql_str(ch)})"
    t = f"trim(regexp_replace({t}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
    return f"""
WITH p AS (
  SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1) AS g, page_id,
         chr(10) || chr(10) || '--- ' || CAST(page_id AS VARCHAR) || ' ---' || chr(10)
           || substring({t}, 1, {report.PAGE_PIECE_CHARS}) AS piece
  FROM pages),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY page_id) AS rn FROM p QUALIFY rn <= {k}),
m AS (SELECT g, string_agg(piece, '' ORDER BY rn) AS t FROM r GROUP BY g)
SELECT g AS "group", substring(t, 1, {report.PAGE_TOTAL_CHARS}) AS text,
       length(substring(t, 1, {report.PAGE_TOTAL_CHARS})) AS n_chars
FROM m"""


@R.query("t11_page_text_merge", _page_sql(), ("T-11",))
def _t11(ws):
    p = ws.raw.pages
    return report.merge_page_text(p, report.page_host(F.col("url")), "page_id",
                                  F.col("page_id").cast("string"), report.html_text(F.col("html")))


@R.query("t12_request_metrics", """
SELECT event_type AS route, COUNT(*) AS requests, ROUND(AVG(value), 2) AS avg_elapsed_s,
       ROUND(MAX(value), 2) AS max_elapsed_s,
       ROUND(AVG(CAST(json_extract_string(props, '$.k') AS INTEGER)), 2) AS avg_rows,
       ROUND(AVG(CAST(event_type = 'error' AS DOUBLE)) * 100, 2) AS error_rate_pct
FROM events GROUP BY event_type""", ("T-12",))
def _t12(ws):
    e = ws.raw.events
    return report.request_metrics(e, F.col("event_type"), F.col("value"),
                                  F.get_json_object("props", "$.k").cast("int"),
                                  F.col("event_type") == "error")

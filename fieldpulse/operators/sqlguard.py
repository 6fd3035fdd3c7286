"""Statement extraction, audit and guarded execution (T-04..T-07).

``extract_sql`` and ``audit_sql`` are Column expressions, so a whole table of
logged answers or statements is processed in one map-only pass. ``run_guarded``
is the user-facing entry for one statement: audit, then ``spark.sql`` over the
registered views; it returns a lazy DataFrame (no collect of the result).
"""

from __future__ import annotations

import time

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldpulse.functions.parallel import spread
from fieldpulse.functions.regex import SPACE, SPACE_CHARS, WORD, portable, prefilter

# ---------------------------------------------------------------------------
# The reference's statement audit.
# ---------------------------------------------------------------------------
FORBIDDEN_PATTERNS = (
    r"\bDROP\b", r"\bDELETE\b", r"\bINSERT\b", r"\bUPDATE\b",
    r"\bALTER\b", r"\bCREATE\b", r"\bTRUNCATE\b", r"\bEXEC\b",
    r"\bGRANT\b", r"\bREVOKE\b", r"--", r";.*;",
)
DOMAIN_TABLES = ("survey_main", "survey_receiver", "survey_recording", "survey_shotpoint", "study_main")
LOG_TABLE = "_ingestion_log"
MSG_START = "Query must start with SELECT or WITH"
MSG_FORBIDDEN = "Forbidden SQL pattern detected: "
MSG_INVALID = "Invalid table(s): "
MSG_VALID = ". Valid tables: "
MAX_ATTEMPTS = 3  # two retries after the first try

_STRIP = rf"^[{SPACE}]+|[{SPACE}]+$"
# Portable spellings of the extraction patterns. (?u) makes Java's (?i) fold
# Unicode case as Python's re.IGNORECASE on str does.
_FENCE = rf"(?isu)```(?:sql)?[{SPACE}]*(.*?)[{SPACE}]*```"
_START = rf"(?is)(SELECT|WITH)((?:[^{WORD}].*)?)$"   # both groups (used by the DuckDB oracle)
_START_AT = rf"(?iu)(?:SELECT|WITH)(?:[^{WORD}]|$)"   # first keyword only (stops at the first hit)
_FROM = rf"(?iu)(?:^|[^{WORD}])FROM[{SPACE}]+([{WORD}]+)"
_JOIN = rf"(?iu)(?:^|[^{WORD}])JOIN[{SPACE}]+([{WORD}]+)"
_ANY_FORBIDDEN = "|".join(f"(?:{portable(p)})" for p in FORBIDDEN_PATTERNS)
# Names defined by a WITH clause: "WITH a AS (", ", b AS (" (only used when strict=False).
_CTE = rf"(?iu)(?:(?:^|[^{WORD}])WITH|,)[{SPACE}]*([{WORD}]+)[{SPACE}]+AS[{SPACE}]*\("


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace (ends only, no regex)."""
    return F.trim(c, F.lit(SPACE_CHARS))


def extract_sql(raw: Column) -> Column:
    """T-04: SQL text out of a free-text answer.

    Fenced block if any (else the whole text); from the first SELECT/WITH
    keyword on, keyword upper-cased; stripped; cut at the first ``;``.
    NULL or empty input gives ``''``. The keyword is located with one
    ``regexp_instr`` (which stops at the first hit) rather than a pattern that
    captures the rest of the text.
    """
    raw = F.coalesce(raw, F.lit(""))
    cand = F.when(raw.contains("```") & raw.rlike(_FENCE), F.regexp_extract(raw, _FENCE, 1)).otherwise(raw)
    pos = F.regexp_instr(cand, F.lit(_START_AT))
    kw_len = F.when(F.upper(F.substr(cand, pos, F.lit(6))) == "SELECT", F.lit(6)).otherwise(F.lit(4))
    body = F.concat(F.upper(F.substr(cand, pos, kw_len)), F.substr(cand, pos + kw_len))
    cleaned = py_strip(F.when(pos > 0, body).otherwise(cand))
    return F.when(cleaned.contains(";"), py_strip(F.substring_index(cleaned, ";", 1))).otherwise(cleaned)


def _set_repr(arr: Column) -> Column:
    """Render a string array like a Python set of names (sorted, so deterministic)."""
    return F.concat(F.lit("{"), F.concat_ws(", ", F.transform(
        F.array_sort(arr), lambda x: F.concat(F.lit("'"), x, F.lit("'")))), F.lit("}"))


def referenced_tables(sql: Column) -> Column:
    """Distinct names following FROM or JOIN (only the first name after each).

    The two regex scans only run on text whose upper-cased form contains
    FROM or JOIN (a byte search); other text has no table reference.
    """
    up = F.upper(sql)
    found = F.array_distinct(F.concat(F.regexp_extract_all(sql, F.lit(_FROM), 1),
                                      F.regexp_extract_all(sql, F.lit(_JOIN), 1)))
    return F.when(up.contains("FROM") | up.contains("JOIN"), found).otherwise(F.array().cast("array<string>"))


def audit_sql(sql: Column, allowed: tuple[str, ...] = DOMAIN_TABLES, strict: bool = True) -> Column:
    """T-05: struct(is_valid, reason, tables, invalid_tables) for each statement.

    Same order of checks as the reference: start keyword, the forbidden
    patterns in list order (on the upper-cased text), then the table
    allow-list (case-sensitive; the log table is always allowed). With the
    default ``strict=True`` a CTE name read after FROM fails the allow-list,
    as in the reference; ``strict=False`` also accepts the names the
    statement defines in its WITH clause.
    """
    sql = F.coalesce(sql, F.lit(""))
    up = py_strip(F.upper(sql))
    tables = referenced_tables(sql)
    allowed_arr = F.array(*[F.lit(t) for t in allowed])
    permitted = F.array_union(allowed_arr, F.array(F.lit(LOG_TABLE)))
    if not strict:
        permitted = F.array_union(permitted, F.regexp_extract_all(sql, F.lit(_CTE), 1))
    invalid = F.array_sort(F.array_except(tables, permitted))
    # A forbidden pattern can only occur where its literal core does (DROP,
    # --, ;): that ``contains`` gate is a fast byte search. Only rows passing
    # it run the combined regex (``And`` short-circuits), and only rows that
    # really match run the ordered chain naming the first pattern; rows that
    # pass the gate without a real match fall through to the table check.
    first_forbidden = None
    for p in FORBIDDEN_PATTERNS:
        hit, msg = up.rlike(portable(p)), F.lit(MSG_FORBIDDEN + p)
        first_forbidden = F.when(hit, msg) if first_forbidden is None else first_forbidden.when(hit, msg)
    reason = F.when(~(up.startswith("SELECT") | up.startswith("WITH")), F.lit(MSG_START))
    gate = prefilter(up, FORBIDDEN_PATTERNS)
    any_hit = up.rlike(_ANY_FORBIDDEN) if gate is None else (gate & up.rlike(_ANY_FORBIDDEN))
    reason = reason.when(any_hit, first_forbidden)
    reason = reason.when(F.size(invalid) > 0, F.concat(
        F.lit(MSG_INVALID), _set_repr(invalid), F.lit(MSG_VALID), _set_repr(allowed_arr)))
    reason = reason.otherwise(F.lit(""))
    return F.struct((reason == "").alias("is_valid"), reason.alias("reason"),
                    F.array_sort(tables).alias("tables"), invalid.alias("invalid_tables"))


def audit_statements(df: DataFrame, text_col: str, allowed: tuple[str, ...] = DOMAIN_TABLES) -> DataFrame:
    """T-04 + T-05 over a table of free-text answers (rows spread over all task slots)."""
    return (spread(df).withColumn("sql", extract_sql(F.col(text_col)))
            .withColumn("_a", audit_sql(F.col("sql"), allowed))
            .select("*", F.col("_a.is_valid").alias("is_valid"), F.col("_a.reason").alias("reason"),
                    F.col("_a.tables").alias("tables"), F.col("_a.invalid_tables").alias("invalid_tables"))
            .drop("_a"))


class GuardError(ValueError):
    """Raised when a statement fails the audit."""


#: Plan nodes and expressions that reach beyond tables: other programs, reflection, code registered by the user.
REFUSED_NODES = ("ScriptTransformation", "CallMethodViaReflection", "TryReflect", "ScalaUDF", "PythonUDF", "PythonUDAF", "PythonUDTF", "HiveGenericUDF",
                 "HiveSimpleUDF", "HiveGenericUDTF", "HiveUDAFFunction")
#: Leaves without a table behind them.
PLAIN_LEAVES = ("LocalRelation", "OneRowRelation", "Range", "CTERelationRef", "EmptyRelation")
MSG_REFUSED, MSG_PATH = "Refused in the plan: ", "Not a table of the catalog: "


def plan_references(spark: SparkSession, df: DataFrame) -> tuple[set[str], set[str]]:
    """(tables, other) that an analysed query reaches, subqueries included.

    Tables are views and catalog tables by name (with their database unless it
    is the current one); what lies below a view is the view's own business. ``other``
    has refused nodes, and relations that are no tables (files read by path).
    """
    tables, other = set(), set()
    here = spark.catalog.currentDatabase()
    holds_plan = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression", True, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())

    def name(identifier) -> str:
        database = identifier.database()
        own = database.isEmpty() or database.get() == here
        return identifier.table() if own else f"{database.get()}.{identifier.table()}"

    def each(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def checked(node) -> str:
        kind = node.getClass().getSimpleName()
        if kind in REFUSED_NODES:
            other.add(MSG_REFUSED + kind)
        return kind

    def expression(e) -> None:
        checked(e)
        if holds_plan.isInstance(e):
            plan(e.plan())
        for child in each(e.children()):
            expression(child)

    def plan(node) -> None:
        kind = checked(node)
        if kind == "View":
            tables.add(name(node.desc().identifier()))
            return
        children = each(node.children())
        if not children and kind not in PLAIN_LEAVES:
            found = None
            if kind == "LogicalRelation" and node.catalogTable().isDefined():
                found = name(node.catalogTable().get().identifier())
            elif kind == "HiveTableRelation":
                found = name(node.tableMeta().identifier())
            elif kind == "DataSourceV2Relation" and node.identifier().isDefined():
                found = node.name()
            if found is None:
                other.add(MSG_PATH + kind)
            else:
                tables.add(found)
        for e in each(node.expressions()):
            expression(e)
        for child in children:
            plan(child)

    plan(df._jdf.queryExecution().analyzed())
    return tables, other


def run_guarded(spark: SparkSession, sql: str, allowed: tuple[str, ...] = DOMAIN_TABLES,
                strict: bool = True) -> DataFrame:
    """T-06: audit one statement, then run it with ``spark.sql`` (lazily).

    The text audit comes first (as in the reference). The statement is then analysed, which
    runs nothing, and audited once more by its plan: every table that it really reaches,
    also by comma joins, subqueries and qualified names, must be allowed, and it may not
    read files by path, call other programs or use reflection.
    """
    verdict = spark.range(1).select(audit_sql(F.lit(sql), allowed, strict).alias("a")).first()["a"]
    if not verdict["is_valid"]:
        raise GuardError(verdict["reason"])
    df = spark.sql(sql)
    tables, other = plan_references(spark, df)
    invalid = sorted(t for t in tables if t not in (*allowed, LOG_TABLE))
    if invalid:
        raise GuardError(f"{MSG_INVALID}{{{', '.join(map(repr, invalid))}}}{MSG_VALID}{{{', '.join(map(repr, sorted(allowed)))}}}")
    if other:
        raise GuardError("; ".join(sorted(other)))
    return df


#: Statements that one report runs at most: it is a test of a written set, one query each.
MOST_STATEMENTS = 1000
REPORT_SCHEMA = "id string, sql string, success boolean, rows long, expects_rows boolean, passed boolean, error string, seconds double"


def statement_report(spark: SparkSession, statements: DataFrame, allowed: tuple[str, ...] = DOMAIN_TABLES, strict: bool = True) -> DataFrame:
    """T-13: run each statement of (id, sql, expects_rows) under guard: success, rows, passed, error, seconds.

    A statement passes if it runs and has rows exactly where that is expected. Its
    rows are counted where they are made and stay there. The set is a written one: more
    than ``MOST_STATEMENTS`` is an error.
    """
    asked = statements.select("id", "sql", "expects_rows").orderBy("id").limit(MOST_STATEMENTS + 1).collect()
    if len(asked) > MOST_STATEMENTS:
        raise ValueError(f"more than {MOST_STATEMENTS} statements")
    out = []
    for row in asked:
        begin, rows, error = time.perf_counter(), None, None
        try:
            rows = run_guarded(spark, row["sql"], allowed, strict).count()
        except GuardError as exc:
            error = str(exc)
        except PySparkException as exc:  # reported, as the reference's test run does
            error = exc.getCondition() or type(exc).__name__
        passed = error is None and (rows > 0) == row["expects_rows"]
        out.append((str(row["id"]), row["sql"], error is None, rows, row["expects_rows"], passed, error, time.perf_counter() - begin))
    return spark.createDataFrame(out, REPORT_SCHEMA)


def report_summary(report: DataFrame) -> DataFrame:
    """T-13: one row: statements, succeeded, passed, their shares in percent, and mean seconds."""
    n, ok, good = F.count(F.lit(1)), F.count_if("success"), F.count_if("passed")
    return report.agg(n.alias("statements"), ok.alias("succeeded"), good.alias("passed"), F.round(F.try_divide(ok * 100, n), 1).alias("success_pct"),
                      F.round(F.try_divide(good * 100, n), 1).alias("passed_pct"), F.round(F.avg("seconds"), 3).alias("avg_seconds"))


def attempt_log(attempts: DataFrame, key: str, order: str, sql_col: str = "sql",
                error_col: str = "error", max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """T-07: roll up generation attempts per question.

    ``attempts`` has one row per attempt (``error`` NULL or '' = success).
    Attempts stop at the first success and after ``max_attempts``; the result
    per key is the number of attempts used, success, and the last attempt's
    statement and error. The per-key ``row_number() <= max_attempts`` filter
    is planned as a map-side group limit, so a key with millions of attempts
    never reaches one task whole.
    """
    w = Window.partitionBy(key).orderBy(order)
    ok = F.coalesce(F.col(error_col), F.lit("")) == ""
    tried = (attempts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_attempts)
             .withColumn("_ok", ok))
    g = tried.groupBy(key).agg(
        F.min(F.when(F.col("_ok"), F.col("_rn"))).alias("_first_ok"),
        F.sort_array(F.collect_list(F.struct("_rn", F.col(sql_col).alias("s"),
                                             F.col(error_col).alias("e")))).alias("_tries"))
    used = F.coalesce(F.col("_first_ok"), F.size("_tries"))
    last = F.element_at("_tries", used.cast("int"))
    return g.select(key, used.cast("int").alias("attempts"), F.col("_first_ok").isNotNull().alias("success"),
                    last["s"].alias("last_sql"),
                    F.when(F.col("_first_ok").isNotNull(), F.lit(None).cast("string"))
                    .otherwise(last["e"]).alias("last_error"))

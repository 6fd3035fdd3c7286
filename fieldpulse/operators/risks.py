"""Rule-based risk alerts (R-01..R-05).

Each rule function returns a DataFrame of zero or one row with the columns
``rule, severity, category, message, action`` (R-01 adds ``details``).
``risk_table`` computes all four from one aggregate instead of unioning the
rule functions (which would evaluate the activity plan once per rule). Rules
only aggregate; the only "list" they carry is R-01's top three, taken by
``orderBy().limit(3)`` (bounded per partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.model import ADAPTER_ACTIVITY, ADAPTER_STUDY, ActivityModel, StudyModel

# Rule texts (English renderings of the reference's rule texts).
SEVERITY_HIGH = "HIGH"
SEVERITY_MEDIUM = "MEDIUM"
CATEGORY_DELAY = "Activity delay"
CATEGORY_ABSORPTION = "Low budget absorption"
CATEGORY_STUDIES = "Studies not started"
CATEGORY_PERMITS = "Permit bottleneck"
ACTION_DELAY = "Escalate permits and procurement for the activities with the highest potential"
ACTION_ABSORPTION = "Review the procurement timeline and speed up the spending process"
ACTION_STUDIES = "Coordinate an immediate kick-off with operators; prioritise reprocessing (shortest duration)"
ACTION_PERMITS = "Escalate forest-use permits to the ministry; run contractor procurement in parallel"
ABSORPTION_THRESHOLD_PCT = 25.0
TOP_DETAILS = 3


def _fmt1(c) -> F.Column:
    """Python ``f"{x:.1f}"``: one decimal, no separators, rounded half-even on the binary value.

    ``format_number`` (DecimalFormat, half-even on the exact value) rounds
    like Python; its thousands separators are removed.
    """
    return F.regexp_replace(F.format_number(c, 1), ",", "")


def delayed_activities(activity: DataFrame, m: ActivityModel = ADAPTER_ACTIVITY) -> DataFrame:
    return activity.filter(m.c("is_delayed") & (m.c("resource_p50") > 0))


def delayed_summary(activity: DataFrame, m: ActivityModel = ADAPTER_ACTIVITY) -> DataFrame:
    """R-01 measures: one row (count, total resource) even when nothing is delayed."""
    return delayed_activities(activity, m).agg(
        F.count(F.lit(1)).alias("n_delayed"),
        F.sum(m.c("resource_p50")).alias("total_resource"))


def delayed_top(activity: DataFrame, m: ActivityModel = ADAPTER_ACTIVITY,
                k: int = TOP_DETAILS) -> DataFrame:
    """R-01 details: the ``k`` delayed activities with most resource (tie: id)."""
    return (delayed_activities(activity, m)
            .select(m.c("id").alias("activity_id"), m.c("name").alias("activity_name"),
                    m.c("work_area").alias("work_area"), m.c("resource_p50").alias("resource_p50"),
                    m.c("days_since_planned_start").alias("days_since_planned_start"))
            .orderBy(F.desc("resource_p50"), F.asc("activity_id"))
            .limit(k))


def _id_type(activity: DataFrame, m: ActivityModel) -> str:
    return activity.schema[m.id].dataType.simpleString()


def rule_delay(activity: DataFrame, m: ActivityModel = ADAPTER_ACTIVITY) -> DataFrame:
    """R-01: HIGH when any delayed activity has resource > 0."""
    idt = _id_type(activity, m)
    summary = delayed_summary(activity, m).select(
        F.lit(0).alias("part"), "n_delayed", "total_resource",
        F.lit(None).cast("struct<activity_name:string,work_area:string,resource_p50:double,"
                         f"days_since_planned_start:bigint,activity_id:{idt}>").alias("d"))
    top = delayed_top(activity, m).select(
        F.lit(1).alias("part"), F.lit(None).cast("bigint").alias("n_delayed"),
        F.lit(None).cast("double").alias("total_resource"),
        F.struct(F.col("activity_name"), F.col("work_area"), F.col("resource_p50"),
                 F.col("days_since_planned_start").cast("bigint").alias("days_since_planned_start"),
                 F.col("activity_id")).alias("d"))
    folded = summary.unionByName(top).agg(
        F.max("n_delayed").alias("n"), F.max("total_resource").alias("total"),
        F.sort_array(F.collect_list(F.struct(
            (-F.col("d.resource_p50")).alias("o"), F.col("d.activity_id").alias("i"),
            F.col("d").alias("d")))).alias("ds"))
    return folded.filter(F.col("n") > 0).select(
        F.lit(1).alias("rule"), F.lit(SEVERITY_HIGH).alias("severity"),
        F.lit(CATEGORY_DELAY).alias("category"),
        F.concat(F.col("n").cast("string"), F.lit(" delayed activities with total potential "),
                 _fmt1(F.col("total")), F.lit(" MMBOE")).alias("message"),
        F.transform(F.filter("ds", lambda x: x["d"].isNotNull()),
                    lambda x: x["d"].dropFields("activity_id")).alias("details"),
        F.lit(ACTION_DELAY).alias("action"))


def absorption_summary(activity: DataFrame, m: ActivityModel = ADAPTER_ACTIVITY) -> DataFrame:
    """R-02 measures over activities with a planned amount > 0 (one row)."""
    a = activity.filter(m.c("planned_amount") > 0).agg(
        F.round(F.sum(m.c("realised_amount")), 0).alias("realised"),
        F.round(F.sum(m.c("planned_amount")), 0).alias("planned"))
    return a.withColumn("pct", F.try_divide(F.col("realised"), F.col("planned")) * 100)


def rule_absorption(activity: DataFrame, m: ActivityModel = ADAPTER_ACTIVITY,
                    threshold_pct: float = ABSORPTION_THRESHOLD_PCT) -> DataFrame:
    """R-02: MEDIUM when realised/planned spend is below ``threshold_pct``."""
    a = absorption_summary(activity, m)
    return a.filter(F.coalesce(F.col("planned"), F.lit(0.0)) > 0).filter(
        F.col("pct") < threshold_pct).select(
        F.lit(2).alias("rule"), F.lit(SEVERITY_MEDIUM).alias("severity"),
        F.lit(CATEGORY_ABSORPTION).alias("category"),
        F.concat(F.lit("Realised spend is only "), _fmt1(F.col("pct")), F.lit("% ($"),
                 F.format_number(F.col("realised"), 0), F.lit(" of $"),
                 F.format_number(F.col("planned"), 0), F.lit(")")).alias("message"),
        F.lit(ACTION_ABSORPTION).alias("action"))


def study_status_summary(study: DataFrame, s: StudyModel = ADAPTER_STUDY) -> DataFrame:
    return study.agg(F.count(F.lit(1)).alias("total"),
                     F.count(F.when(s.c("status") == s.not_started, F.lit(1))).alias("not_started"))


def rule_studies(study: DataFrame, s: StudyModel = ADAPTER_STUDY) -> DataFrame:
    """R-03: HIGH when every study (at least one) is not started."""
    a = study_status_summary(study, s)
    return a.filter((F.col("total") > 0) & (F.col("total") == F.col("not_started"))).select(
        F.lit(3).alias("rule"), F.lit(SEVERITY_HIGH).alias("severity"),
        F.lit(CATEGORY_STUDIES).alias("category"),
        F.concat(F.lit("All "), F.col("total").cast("string"),
                 F.lit(" studies are still 'not started'")).alias("message"),
        F.lit(ACTION_STUDIES).alias("action"))


def permit_blocked(activity: DataFrame, m: ActivityModel = ADAPTER_ACTIVITY) -> DataFrame:
    """Not-started activities with a planned start and any permit/procurement step < 100 %."""
    return activity.filter(
        (m.c("status") == m.not_started)
        & ((m.c("permit_a_pct") < 100) | (m.c("permit_b_pct") < 100) | (m.c("procurement_pct") < 100))
        & m.c("planned_start").isNotNull())


def rule_permits(activity: DataFrame, m: ActivityModel = ADAPTER_ACTIVITY) -> DataFrame:
    """R-04: MEDIUM when any such activity exists."""
    a = permit_blocked(activity, m).agg(F.count(F.lit(1)).alias("n"))
    return a.filter(F.col("n") > 0).select(
        F.lit(4).alias("rule"), F.lit(SEVERITY_MEDIUM).alias("severity"),
        F.lit(CATEGORY_PERMITS).alias("category"),
        F.concat(F.col("n").cast("string"),
                 F.lit(" activities held up by incomplete permits")).alias("message"),
        F.lit(ACTION_PERMITS).alias("action"))


def _rule_row(rule: int, severity: str, category: str, message, action: str, details=None) -> F.Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                    F.lit(category).alias("category"), message.alias("message"),
                    (details if details is not None else F.lit(None).cast(_DETAILS_TYPE)).alias("details"),
                    F.lit(action).alias("action"))


_DETAIL_FIELDS = ("activity_name:string,work_area:string,resource_p50:double,"
                  "days_since_planned_start:bigint")
_DETAILS_TYPE = f"array<struct<{_DETAIL_FIELDS}>>"


def risk_table(activity: DataFrame, study: DataFrame, m: ActivityModel = ADAPTER_ACTIVITY,
               s: StudyModel = ADAPTER_STUDY,
               threshold_pct: float = ABSORPTION_THRESHOLD_PCT) -> DataFrame:
    """R-05: the fired rules as rows ``rule, severity, category, message, details, action``.

    All four rules come from ONE aggregate: the activity measures of R-01,
    R-02 and R-04 are conditional sums/counts in a single pass over activity,
    R-01's three details come from a bounded ``orderBy().limit(3)``, R-03's
    counts from one pass over study; the three inputs are unioned and folded
    into one row, from which the fired rules are exploded. (The rule
    functions above give the same rows one rule at a time.)
    """
    delayed = m.c("is_delayed") & (m.c("resource_p50") > 0)
    planned_pos = m.c("planned_amount") > 0
    blocked = ((m.c("status") == m.not_started)
               & ((m.c("permit_a_pct") < 100) | (m.c("permit_b_pct") < 100) | (m.c("procurement_pct") < 100))
               & m.c("planned_start").isNotNull())
    nul_l, nul_d = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    nul_id = F.lit(None).cast(_id_type(activity, m))  # tie-break key keeps the id's own type
    detail_t = f"struct<{_DETAIL_FIELDS}>"
    measures = activity.agg(
        F.count(F.when(delayed, F.lit(1))).alias("d_n"),
        F.sum(F.when(delayed, m.c("resource_p50"))).alias("d_total"),
        F.round(F.sum(F.when(planned_pos, m.c("realised_amount"))), 0).alias("ab_realised"),
        F.round(F.sum(F.when(planned_pos, m.c("planned_amount"))), 0).alias("ab_planned"),
        F.count(F.when(blocked, F.lit(1))).alias("p_n"),
    ).select("*", nul_l.alias("s_total"), nul_l.alias("s_open"), nul_id.alias("o"),
             F.lit(None).cast(detail_t).alias("d"))
    top = delayed_top(activity, m).select(
        nul_l.alias("d_n"), nul_d.alias("d_total"), nul_d.alias("ab_realised"), nul_d.alias("ab_planned"),
        nul_l.alias("p_n"), nul_l.alias("s_total"), nul_l.alias("s_open"),
        F.col("activity_id").alias("o"),
        F.struct(F.col("activity_name"), F.col("work_area"), F.col("resource_p50"),
                 F.col("days_since_planned_start").cast("bigint").alias("days_since_planned_start")).alias("d"))
    st = study_status_summary(study, s).select(
        nul_l.alias("d_n"), nul_d.alias("d_total"), nul_d.alias("ab_realised"), nul_d.alias("ab_planned"),
        nul_l.alias("p_n"), F.col("total").alias("s_total"), F.col("not_started").alias("s_open"),
        nul_id.alias("o"), F.lit(None).cast(detail_t).alias("d"))
    one = measures.unionByName(top).unionByName(st).agg(
        *[F.max(c).alias(c) for c in ("d_n", "d_total", "ab_realised", "ab_planned", "p_n", "s_total", "s_open")],
        F.sort_array(F.collect_list(F.when(F.col("d").isNotNull(), F.struct(
            (-F.col("d.resource_p50")).alias("k"), F.col("o").alias("o"), F.col("d").alias("d"))))).alias("ds"))
    pct = F.try_divide(F.col("ab_realised"), F.col("ab_planned")) * 100
    rules = F.array(
        F.when(F.col("d_n") > 0, _rule_row(
            1, SEVERITY_HIGH, CATEGORY_DELAY,
            F.concat(F.col("d_n").cast("string"), F.lit(" delayed activities with total potential "),
                     _fmt1(F.col("d_total")), F.lit(" MMBOE")),
            ACTION_DELAY, F.transform("ds", lambda x: x["d"]))),
        F.when((F.coalesce(F.col("ab_planned"), F.lit(0.0)) > 0) & (pct < threshold_pct), _rule_row(
            2, SEVERITY_MEDIUM, CATEGORY_ABSORPTION,
            F.concat(F.lit("Realised spend is only "), _fmt1(pct), F.lit("% ($"),
                     F.format_number(F.col("ab_realised"), 0), F.lit(" of $"),
                     F.format_number(F.col("ab_planned"), 0), F.lit(")")),
            ACTION_ABSORPTION)),
        F.when((F.col("s_total") > 0) & (F.col("s_total") == F.col("s_open")), _rule_row(
            3, SEVERITY_HIGH, CATEGORY_STUDIES,
            F.concat(F.lit("All "), F.col("s_total").cast("string"), F.lit(" studies are still 'not started'")),
            ACTION_STUDIES)),
        F.when(F.col("p_n") > 0, _rule_row(
            4, SEVERITY_MEDIUM, CATEGORY_PERMITS,
            F.concat(F.col("p_n").cast("string"), F.lit(" activities held up by incomplete permits")),
            ACTION_PERMITS)),
    )
    return one.select(F.inline(F.filter(rules, lambda r: r.isNotNull())))

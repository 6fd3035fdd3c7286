"""The catalogue of thirty worked portfolio questions (Q-01..Q-30) and joins (J-01..J-03).

Each question is a small declarative DataFrame plan over the activity or study
relation, written against model roles so it runs on the reference's domain
tables as well as on the adapter. Parameters the reference hard-codes (year,
region, kind, name pattern, limits) are function arguments with the adapter's
equivalents as defaults. Every top-k carries a key as tie-break so results are
deterministic; NULLs sort last in both directions, like the reference engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.columns import has_text
from fieldpulse.model import (
    ADAPTER_ACTIVITY, ADAPTER_DETAIL, ADAPTER_STUDY, ActivityModel, DetailModel, StudyModel,
)

A, S = ADAPTER_ACTIVITY, ADAPTER_STUDY


def _n() -> F.Column:
    return F.count(F.lit(1))


def _desc(c: str) -> F.Column:
    return F.desc_nulls_last(c)


def q01_count_in_year(a: DataFrame, year: int = 1998, m: ActivityModel = A, dated_by: str | None = None) -> DataFrame:
    """``dated_by``: a timestamp role whose year the year column is; its range then reaches the scan."""
    if dated_by is not None:
        begin, end = (F.lit(f"{y:04d}-01-01 00:00:00").cast(a.schema[getattr(m, dated_by)].dataType) for y in (year, year + 1))
        a = a.filter((m.c(dated_by) >= begin) & (m.c(dated_by) < end))
    return a.filter(m.c("year") == year).agg(_n().alias("n_activities"))


def q02_total_planned(a: DataFrame, m: ActivityModel = A) -> DataFrame:
    return a.agg(F.round(F.sum(m.c("planned_amount")), 0).alias("total_planned"))


def q03_count_done(a: DataFrame, m: ActivityModel = A) -> DataFrame:
    return a.filter(m.c("status") == m.done).agg(_n().alias("n_done"))


def q04_list_kind(a: DataFrame, kind: str | None = None, m: ActivityModel = A) -> DataFrame:
    return (a.filter(m.c("kind") == (kind or m.kind_b))
            .select(m.c("name").alias("activity_name"), m.c("work_area").alias("work_area"),
                    m.c("region").alias("region"), m.c("status").alias("status"))
            .orderBy(F.asc_nulls_last("activity_name")))


def q05_studies_not_started(s: DataFrame, st: StudyModel = S) -> DataFrame:
    return s.filter(st.c("status") == st.not_started).agg(_n().alias("n_not_started"))


def q06_total_study_budget(s: DataFrame, st: StudyModel = S) -> DataFrame:
    return s.agg(F.round(F.sum(st.c("planned_budget")), 0).alias("total_budget"))


def _distinct(c: F.Column, approx: bool) -> F.Column:
    """Exact distinct count, or the HyperLogLog++ estimate (bounded memory) when ``approx``."""
    return F.approx_count_distinct(c) if approx else F.count_distinct(c)


def q07_distinct_exploration_areas(a: DataFrame, m: ActivityModel = A, approx: bool = False) -> DataFrame:
    return (a.filter(m.c("block_status") == m.exploration)
            .agg(_distinct(m.c("work_area"), approx).alias("n_work_areas")))


def q08_region_spend(a: DataFrame, region: str = "ASIA", m: ActivityModel = A) -> DataFrame:
    return (a.filter(m.c("region") == region)
            .agg(F.round(F.sum(m.c("planned_amount")), 0).alias("total_planned"),
                 _n().alias("n_activities")))


def q09_delayed_list(a: DataFrame, m: ActivityModel = A) -> DataFrame:
    return (a.filter(m.c("is_delayed"))
            .select(m.c("name").alias("activity_name"), m.c("work_area").alias("work_area"),
                    m.c("region").alias("region"), m.c("planned_start").alias("planned_start"),
                    m.c("resource_p50").alias("resource"),
                    m.c("days_since_planned_start").alias("days_late"))
            .orderBy(_desc("resource"), F.asc_nulls_last("activity_name")))


def q10_offshore_running(a: DataFrame, m: ActivityModel = A) -> DataFrame:
    return (a.filter((m.c("area") == m.offshore) & m.c("status").startswith(m.running_prefix))
            .select(m.c("name").alias("activity_name"), m.c("work_area").alias("work_area"),
                    m.c("progress_pct").alias("progress")))


def q11_resource_per_region(a: DataFrame, m: ActivityModel = A) -> DataFrame:
    return (a.groupBy(m.c("region").alias("region"))
            .agg(_n().alias("n_activities"),
                 F.round(F.sum(m.c("resource_p50")), 2).alias("total_resource"),
                 F.round(F.sum(m.c("planned_amount")), 0).alias("total_planned"))
            .orderBy(_desc("total_resource")))


def q12_per_holding(a: DataFrame, m: ActivityModel = A) -> DataFrame:
    return (a.groupBy(m.c("holding").alias("holding"))
            .agg(_n().alias("n_activities"),
                 F.round(F.sum(m.c("planned_amount")), 0).alias("total_planned"),
                 F.round(F.sum(m.c("resource_p50")), 2).alias("total_resource"))
            .orderBy(_desc("n_activities")))


def q13_study_types_budget(s: DataFrame, st: StudyModel = S) -> DataFrame:
    return (s.groupBy(st.c("study_type").alias("study_type"))
            .agg(_n().alias("n_studies"),
                 F.round(F.sum(st.c("planned_budget")), 0).alias("total_budget"))
            .orderBy(_desc("n_studies")))


def q14_carry_over_not_started(s: DataFrame, st: StudyModel = S) -> DataFrame:
    return (s.filter((st.c("proposal_status") == st.carry_over) & (st.c("status") == st.not_started))
            .groupBy(st.c("study_area").alias("study_area"))
            .agg(_n().alias("n_studies"))
            .orderBy(_desc("n_studies")))


def q15_top_resource(a: DataFrame, k: int = 5, m: ActivityModel = A) -> DataFrame:
    return (a.orderBy(_desc(m.resource_p50), F.asc(m.id)).limit(k)
            .select(m.c("name").alias("activity_name"), m.c("work_area").alias("work_area"),
                    m.c("holding").alias("holding"), m.c("resource_p50").alias("resource"),
                    m.c("resource_oil").alias("resource_oil"), m.c("resource_gas").alias("resource_gas"),
                    m.c("status").alias("status"), m.c("play").alias("play")))


def q16_high_potential_low_progress(a: DataFrame, min_resource: float = 50, max_progress: float = 50,
                                    m: ActivityModel = A) -> DataFrame:
    return (a.filter((m.c("resource_p50") > min_resource) & (m.c("progress_pct") < max_progress))
            .select(m.c("name").alias("activity_name"), m.c("work_area").alias("work_area"),
                    m.c("resource_p50").alias("resource"), m.c("progress_pct").alias("progress"),
                    m.c("status").alias("status"))
            .orderBy(_desc("resource"), F.asc_nulls_last("activity_name")))


def q17_onshore_vs_offshore(a: DataFrame, m: ActivityModel = A) -> DataFrame:
    return (a.groupBy(m.c("area").alias("area"))
            .agg(_n().alias("n_activities"),
                 F.round(F.sum(m.c("planned_amount")), 0).alias("total_planned"),
                 F.round(F.sum(m.c("realised_amount")), 0).alias("total_realised"),
                 F.round(F.avg(m.c("progress_pct")), 1).alias("avg_progress")))


def q18_with_obstacle(a: DataFrame, m: ActivityModel = A) -> DataFrame:
    return (a.filter(has_text(m.c("obstacle")))
            .select(m.c("name").alias("activity_name"), m.c("work_area").alias("work_area"),
                    m.c("region").alias("region"), m.c("obstacle").alias("obstacle"),
                    m.c("status").alias("status")))


def q19_holding_performance(a: DataFrame, min_count: int = 1, m: ActivityModel = A) -> DataFrame:
    return (a.groupBy(m.c("holding").alias("holding"))
            .agg(_n().alias("n_activities"),
                 F.round(F.avg(m.c("progress_pct")), 1).alias("avg_progress"),
                 F.round(F.sum(m.c("planned_amount")), 0).alias("total_planned"),
                 F.round(F.sum(m.c("resource_p50")), 2).alias("total_resource"))
            .filter(F.col("n_activities") >= min_count)
            .orderBy(_desc("avg_progress")))


def q20_kind_in_region(a: DataFrame, kind: str | None = None, region: str = "EUROPE",
                       m: ActivityModel = A) -> DataFrame:
    return (a.filter((m.c("kind") == (kind or m.kind_b)) & (m.c("region") == region))
            .select(m.c("name").alias("activity_name"), m.c("work_area").alias("work_area"),
                    m.c("planned_qty").alias("target_qty"), m.c("realised_qty").alias("realised_qty"),
                    m.c("status").alias("status")))


def q21_technical_approval_share(a: DataFrame, m: ActivityModel = A) -> DataFrame:
    approved = F.count(F.when(m.c("technical_approval") == m.approved, F.lit(1)))
    return a.agg(approved.alias("approved"), _n().alias("total"),
                 F.round(F.try_divide(approved.cast("double") * 100, _n()), 1).alias("pct"))


def q22_status_breakdown(a: DataFrame, m: ActivityModel = A) -> DataFrame:
    return (a.groupBy(m.c("status").alias("status")).agg(_n().alias("n_activities"))
            .orderBy(_desc("n_activities")))


def q23_prospects_and_leads(a: DataFrame, m: ActivityModel = A) -> DataFrame:
    p, l_ = F.sum(m.c("prospects")), F.sum(m.c("leads"))
    return a.agg(p.alias("total_prospects"), l_.alias("total_leads"), (p + l_).alias("total_structures"))


def q24_top_planned(a: DataFrame, k: int = 10, m: ActivityModel = A) -> DataFrame:
    return (a.filter(m.c("planned_amount") > 0)
            .orderBy(_desc(m.planned_amount), F.asc(m.id)).limit(k)
            .select(m.c("name").alias("activity_name"), m.c("work_area").alias("work_area"),
                    m.c("holding").alias("holding"),
                    F.round(m.c("planned_amount"), 0).alias("planned"), m.c("status").alias("status")))


def q25_studies_per_holding(s: DataFrame, k: int = 10, st: StudyModel = S) -> DataFrame:
    return (s.groupBy(st.c("holding").alias("holding"))
            .agg(_n().alias("n_studies"),
                 F.round(F.sum(st.c("planned_budget")), 0).alias("total_budget"))
            .orderBy(_desc("n_studies"), F.asc_nulls_last("holding")).limit(k))


def q26_studies_per_validator(s: DataFrame, st: StudyModel = S) -> DataFrame:
    return (s.filter(has_text(st.c("validator")))
            .groupBy(st.c("validator").alias("validator")).agg(_n().alias("n_studies"))
            .orderBy(_desc("n_studies")))


def q27_exploration_area(s: DataFrame, st: StudyModel = S, approx: bool = False) -> DataFrame:
    """Sum beside a distinct count: Spark plans one distinct aggregate as two
    levels (partial sums per work area, then the count), without ``Expand``."""
    return (s.filter(st.c("block_status") == st.exploration)
            .agg(F.round(F.sum(st.c("area_km2")), 2).alias("total_area_km2"),
                 _distinct(st.c("work_area"), approx).alias("n_work_areas")))


# The two spellings of "carbonate" the reference searches for.
CARBONATE_WORDS = ("carbonate", "karbonat")


def q28_carbonate_play(a: DataFrame, words: tuple[str, ...] = CARBONATE_WORDS,
                       m: ActivityModel = A) -> DataFrame:
    play = F.lower(m.c("play"))
    cond = None
    for w in words:
        c = play.contains(w)
        cond = c if cond is None else (cond | c)
    return (a.filter(cond)
            .select(m.c("name").alias("activity_name"), m.c("work_area").alias("work_area"),
                    m.c("play").alias("play"), m.c("resource_p50").alias("resource")))


def technical_detail(a: DataFrame, receiver: DataFrame, shotpoint: DataFrame,
                     name_contains: str | None = None, m: ActivityModel = A,
                     d: DetailModel = ADAPTER_DETAIL) -> DataFrame:
    """J-01 / Q-29: activity ⟕ receiver ⟕ shotpoint on the activity key, as SQL joins do.

    No de-duplication: an activity with r receiver rows and s shot-point rows
    yields r*s rows, exactly like the reference's two chained LEFT JOINs. The
    name filter is applied to the activity side first (Catalyst keeps it below
    the joins). AQE splits a skewed key's partition across tasks.
    """
    base = a
    if name_contains is not None:
        base = base.filter(F.lower(m.c("name")).contains(name_contains.lower()))
    base = base.select(m.c("id").alias("_k"), m.c("name").alias("activity_name"),
                       m.c("kind").alias("kind"))
    r = receiver.select(F.col(d.key).alias("_rk"), *d.receiver_cols)
    s = shotpoint.select(F.col(d.key).alias("_sk"), *d.shotpoint_cols)
    return (base.join(r, base._k == r._rk, "left")
            .join(s, base._k == s._sk, "left")
            .drop("_k", "_rk", "_sk"))


def detail_rollup(a: DataFrame, receiver: DataFrame, shotpoint: DataFrame, recording: DataFrame,
                  m: ActivityModel = A, d: DetailModel = ADAPTER_DETAIL, own: tuple[str, ...] = ()) -> DataFrame:
    """J-01 + J-02 over the whole portfolio, one row per activity (with its ``own`` columns).

    Each detail table is first reduced to one row per activity key (partial
    aggregation before its shuffle), then left-joined: output size equals the
    activity count whatever the key skew, instead of the r*s*c fan-out of
    joining raw detail rows.
    """
    def roll(df: DataFrame, prefix: str, cols: tuple[str, ...]) -> DataFrame:
        # sums of doubles depend on summation order in their last bits; they
        # are reported rounded (4 decimals), as the reference rounds its sums
        return df.groupBy(F.col(d.key).alias(f"_{prefix}k")).agg(
            F.count(F.lit(1)).alias(f"{prefix}_rows"),
            *[F.round(F.sum(c), 4).alias(f"{prefix}_sum_{c}") for c in cols])

    r = roll(receiver, "rcv", d.receiver_cols)
    s = roll(shotpoint, "shot", d.shotpoint_cols)
    c = roll(recording, "rec", d.recording_cols)
    base = a.select(m.c("id").alias("activity_id"), m.c("name").alias("activity_name"),
                    m.c("kind").alias("kind"), *own)
    out = (base.join(r, base.activity_id == r._rcvk, "left")
           .join(s, base.activity_id == s._shotk, "left")
           .join(c, base.activity_id == c._reck, "left")
           .drop("_rcvk", "_shotk", "_reck"))
    counts = {f"{p}_rows": F.coalesce(F.col(f"{p}_rows"), F.lit(0).cast("bigint"))
              for p in ("rcv", "shot", "rec")}
    return out.withColumns(counts)


def q29_technical_detail(a: DataFrame, receiver: DataFrame, shotpoint: DataFrame, recording: DataFrame,
                         name_contains: str, m: ActivityModel = A, d: DetailModel = ADAPTER_DETAIL) -> DataFrame:
    """Q-29 / J-02: the technical detail of the activities whose name has a text, one row an activity.

    The name filter also reduces the three detail tables: each is semi-joined with the keys
    it leaves, before its rows are rolled up and shuffled (AQE broadcasts the keys
    when they turn out small). Survey-side parameters are the model's ``survey_cols``.
    """
    named = a.filter(F.lower(m.c("name")).contains(name_contains.lower()))
    keys = named.select(m.c("id").alias("_key"))

    def asked(df: DataFrame) -> DataFrame:
        return df.join(keys, F.col(d.key) == F.col("_key"), "left_semi")

    return detail_rollup(named, asked(receiver), asked(shotpoint), asked(recording), m, d, d.survey_cols)


def q30_cross_table_totals(a: DataFrame, s: DataFrame) -> DataFrame:
    """J-03: both table counts and their sum in one row, without a join.

    The two counts are tagged, unioned and folded by one global aggregate.
    """
    tagged = (a.agg(_n().alias("n")).select(F.lit("a").alias("t"), "n")
              .unionByName(s.agg(_n().alias("n")).select(F.lit("s").alias("t"), "n")))
    na = F.sum(F.when(F.col("t") == "a", F.col("n")))
    ns = F.sum(F.when(F.col("t") == "s", F.col("n")))
    return tagged.agg(na.alias("total_activities"), ns.alias("total_studies"),
                      (na + ns).alias("grand_total"))

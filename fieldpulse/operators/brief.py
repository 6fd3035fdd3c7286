"""Executive brief: KPI rows, breakdowns and the long-form gold table (B-01..B-07).

Every function takes the cleaned relations and returns a lazy DataFrame. The
combined brief (``brief_long``) reads the activity relation once: one
``GROUPING SETS ((), (region), (holding))`` aggregate feeds the KPI row, the
region breakdown and the holding ranking, so the (expensive, multi-join)
activity plan runs a single time. Partial aggregation happens map-side before
the only shuffle, so a hot region or holding key costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.model import ADAPTER_ACTIVITY, ADAPTER_STUDY, ActivityModel, StudyModel
from fieldpulse.operators.report import py_str_double


def _count_when(pred) -> F.Column:
    return F.count(F.when(pred, F.lit(1)))


#: Slices in which holdings are ranked first.
SLICES = 64

SURVEY_KPI_NAMES = ("total", "running", "done", "not_started", "total_planned",
                    "total_realised", "total_resource", "avg_progress", "kind_2d",
                    "kind_3d", "kind_other", "onshore", "offshore")


def survey_kpi_measures(m: ActivityModel) -> list:
    """The 13 survey measures of the brief, as aggregate expressions."""
    status, kind, area = m.c("status"), m.c("kind"), m.c("area")
    return [
        F.count(F.lit(1)).alias("total"),
        _count_when(status.startswith(m.running_prefix)).alias("running"),
        _count_when(status == m.done).alias("done"),
        _count_when(status == m.not_started).alias("not_started"),
        F.round(F.sum(m.c("planned_amount")), 0).alias("total_planned"),
        F.round(F.sum(m.c("realised_amount")), 0).alias("total_realised"),
        F.round(F.sum(m.c("resource_p50")), 2).alias("total_resource"),
        F.round(F.avg(m.c("progress_pct")), 1).alias("avg_progress"),
        _count_when(kind == m.kind_a).alias("kind_2d"),
        _count_when(kind == m.kind_b).alias("kind_3d"),
        _count_when(kind == m.kind_c).alias("kind_other"),
        _count_when(area == m.onshore).alias("onshore"),
        _count_when(area == m.offshore).alias("offshore"),
    ]


def survey_kpis(activity: DataFrame, m: ActivityModel = ADAPTER_ACTIVITY) -> DataFrame:
    """B-01: one row, always (also on an empty table: counts 0, sums NULL)."""
    return activity.agg(*survey_kpi_measures(m))


def study_kpis(study: DataFrame, s: StudyModel = ADAPTER_STUDY) -> DataFrame:
    """B-02."""
    status = s.c("status")
    return study.agg(
        F.count(F.lit(1)).alias("total"),
        _count_when(status == s.not_started).alias("not_started"),
        _count_when(status == s.done).alias("done"),
        F.round(F.sum(s.c("planned_budget")), 0).alias("total_budget"),
        F.round(F.sum(s.c("realised_budget")), 0).alias("realised_budget"),
    )


def studies_by_type(study: DataFrame, s: StudyModel = ADAPTER_STUDY) -> DataFrame:
    """B-03: count per study type, largest first."""
    return (study.groupBy(s.c("study_type").alias("study_type"))
            .agg(F.count(F.lit(1)).alias("n_studies"))
            .orderBy(F.desc("n_studies"), F.asc_nulls_last("study_type")))


def region_measures(m: ActivityModel) -> list:
    return [
        F.count(F.lit(1)).alias("n_activities"),
        F.round(F.avg(m.c("progress_pct")), 1).alias("avg_progress"),
        F.round(F.sum(m.c("resource_p50")), 1).alias("total_resource"),
        F.round(F.sum(m.c("planned_amount")), 0).alias("total_planned"),
    ]


def by_region(activity: DataFrame, m: ActivityModel = ADAPTER_ACTIVITY) -> DataFrame:
    """B-04: per region count, mean progress, resource and planned spend."""
    return (activity.groupBy(m.c("region").alias("region"))
            .agg(*region_measures(m))
            .orderBy(F.desc_nulls_last("total_resource"), F.asc_nulls_last("region")))


def top_holdings(activity: DataFrame, m: ActivityModel = ADAPTER_ACTIVITY, k: int = 5) -> DataFrame:
    """B-05: the ``k`` holdings with most activities (ties broken by name)."""
    return (activity.groupBy(m.c("holding").alias("holding"))
            .agg(F.count(F.lit(1)).alias("n_activities"),
                 F.round(F.avg(m.c("progress_pct")), 1).alias("avg_progress"),
                 F.round(F.sum(m.c("resource_p50")), 1).alias("total_resource"))
            .orderBy(F.desc("n_activities"), F.asc_nulls_last("holding"))
            .limit(k))


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _measure_array_sql(measures: list[tuple[str, str] | str]) -> str:
    """SQL text: array of (measure, value double) structs.

    Built as one SQL expression string (parsed once by ``F.expr``) rather
    than Column by Column: same plan, a fraction of the driver round trips.
    """
    pairs = [(m, m) if isinstance(m, str) else m for m in measures]
    items = ", ".join(f"named_struct('measure', '{name}', 'value', CAST({_q(src)} AS DOUBLE))"
                      for name, src in pairs)
    return f"array({items})"


def _long(df: DataFrame, section: str, key_col, measures: list[str]) -> DataFrame:
    """Unpivot measure columns into (section, key, measure, value double)."""
    key = F.lit(None).cast("string") if key_col is None else F.col(key_col).cast("string")
    return df.select(F.lit(section).alias("section"), key.alias("key"),
                     F.inline(F.expr(_measure_array_sql(measures))))


def long_by_grouping(g: DataFrame, cases: dict[int, tuple[str, str | None, list]]) -> DataFrame:
    """Long form of a grouping-sets result in ONE projection.

    ``cases`` maps a ``gid`` to ``(section, key column, measures)``. Splitting
    the aggregate into one filtered branch per grouping set instead would let
    the optimizer push each ``gid`` filter below the aggregate and re-run the
    whole input plan once per branch.
    """
    sec, key, arr = [], [], []
    for gid, (name, key_col, measures) in cases.items():
        sec.append(f"WHEN gid = {gid} THEN '{name}'")
        key.append(f"WHEN gid = {gid} THEN " + ("CAST(NULL AS STRING)" if key_col is None
                                                else f"CAST({_q(key_col)} AS STRING)"))
        arr.append(f"WHEN gid = {gid} THEN {_measure_array_sql(measures)}")
    return g.select(F.expr("CASE " + " ".join(sec) + " END").alias("section"),
                    F.expr("CASE " + " ".join(key) + " END").alias("key"),
                    F.inline(F.expr("CASE " + " ".join(arr) + " END")))


def brief_long(activity: DataFrame, study: DataFrame,
               m: ActivityModel = ADAPTER_ACTIVITY, s: StudyModel = ADAPTER_STUDY,
               top_k: int = 5) -> DataFrame:
    """B-06: the whole brief as one long-form table, one scan per source relation.

    Sections: ``survey`` (13 KPIs), ``region`` (4 measures per region),
    ``holding`` (top-k holdings, 3 measures + rank), ``study`` (5 KPIs) and
    ``study_type`` (count per type).
    """
    measures = survey_kpi_measures(m) + [
        F.round(F.avg(m.c("progress_pct")), 1).alias("g_avg_progress_1"),
        F.round(F.sum(m.c("resource_p50")), 1).alias("g_total_resource_1"),
        F.grouping_id().alias("gid"),
    ]
    # Grouping keys are projected by name first: groupingSets on aliased
    # expressions would treat each alias as a separate grouping expression.
    keyed = activity.withColumns({"g_region": m.c("region"), "g_holding": m.c("holding")})
    g = keyed.groupingSets([[], ["g_region"], ["g_holding"]], "g_region", "g_holding").agg(*measures)
    # gid bits: region is the high bit, holding the low bit (1 = rolled up):
    # 3 = grand total, 1 = per region, 2 = per holding. The holdings are ranked in
    # two steps, first within slices by hash: the last window has at most
    # SLICES * top_k of them, however many there are.
    is_holding, by = F.col("gid") == 2, (F.desc("total"), F.asc_nulls_last("g_holding"))
    g = g.withColumn("slice", F.pmod(F.xxhash64("g_region", "g_holding"), F.lit(SLICES)))
    for part in (F.col("slice"), F.when(is_holding, F.lit(-1).cast("bigint")).otherwise(F.col("slice"))):
        w = Window.partitionBy("gid", part).orderBy(*by)
        g = g.withColumn("rank", F.when(is_holding, F.row_number().over(w))).filter(~is_holding | (F.col("rank") <= top_k))
    region_measures_ = [("n_activities", "total"), ("avg_progress", "g_avg_progress_1"),
                        ("total_resource", "g_total_resource_1"), ("total_planned", "total_planned")]
    holding_measures = [("n_activities", "total"), ("avg_progress", "g_avg_progress_1"),
                        ("total_resource", "g_total_resource_1"), ("rank", "rank")]
    survey_long = long_by_grouping(g, {
        3: ("survey", None, list(SURVEY_KPI_NAMES)),
        1: ("region", "g_region", region_measures_),
        2: ("holding", "g_holding", holding_measures)})
    st_status = s.c("status")
    sg = study.withColumn("g_type", s.c("study_type")).groupingSets(
        [[], ["g_type"]], "g_type").agg(
        F.count(F.lit(1)).alias("total"),
        _count_when(st_status == s.not_started).alias("not_started"),
        _count_when(st_status == s.done).alias("done"),
        F.round(F.sum(s.c("planned_budget")), 0).alias("total_budget"),
        F.round(F.sum(s.c("realised_budget")), 0).alias("realised_budget"),
        F.grouping_id().alias("gid"))
    study_long = long_by_grouping(sg, {
        1: ("study", None, ["total", "not_started", "done", "total_budget", "realised_budget"]),
        0: ("study_type", "g_type", [("n_studies", "total")])})
    return survey_long.unionByName(study_long)


# ---------------------------------------------------------------------------
# B-07: the brief as text. The inputs are the small gold rows (a handful of
# regions and risks), assembled with ordered collect_list + concat_ws.
# ---------------------------------------------------------------------------

def _fmt0(c) -> F.Column:
    return F.format_number(F.coalesce(c, F.lit(0.0)), 0)


def brief_text(long: DataFrame, risks: DataFrame | None = None, as_of_label: str = "") -> DataFrame:
    """B-07: one row, one column ``brief``: the formatted executive brief.

    ``long`` is the long-form brief (B-06), ``risks`` the risk table (R-05).
    The brief's rows (bounded: KPIs, one row per region, top-k holdings, one
    per study type) are gathered into one array by a single aggregate and
    the text is rendered with array functions, so the brief's source plan
    runs once. Numbers are formatted as the reference's f-strings do
    (``format_number`` rounds half-even on the binary value like Python;
    plain floats render like ``str()``).
    """
    rows = long.agg(F.collect_list(F.struct("section", "key", "measure", "value")).alias("r"))
    r = F.col("r")

    def val(section: str, measure: str, key=None) -> F.Column:
        def pick(x):
            c = (x["section"] == section) & (x["measure"] == measure)
            return c if key is None else c & (x["key"] == key)
        return F.try_element_at(F.filter(r, pick), F.lit(1))["value"]

    def n(section: str, measure: str) -> F.Column:
        return F.coalesce(val(section, measure).cast("bigint"), F.lit(0)).cast("string")

    planned, realised = val("survey", "total_planned"), val("survey", "total_realised")
    pct = F.when(F.coalesce(planned, F.lit(0.0)) > 0, realised / planned * 100).otherwise(F.lit(0.0))
    types = F.sort_array(F.transform(
        F.filter(r, lambda x: x["section"] == "study_type"),
        lambda x: F.struct((-x["value"]).alias("o"), F.coalesce(x["key"], F.lit("nan")).alias("k"),
                           x["value"].cast("bigint").alias("n"))))
    regions = F.sort_array(F.transform(
        F.filter(r, lambda x: (x["section"] == "region") & (x["measure"] == "total_resource")),
        lambda x: F.struct((-F.coalesce(x["value"], F.lit(0.0))).alias("o"), x["key"].alias("k"))))
    region_lines = F.concat_ws("", F.transform(regions, lambda g: F.concat(
        F.lit("\n- "), F.coalesce(g["k"], F.lit("nan")), F.lit(": "),
        val("region", "n_activities", g["k"]).cast("bigint").cast("string"), F.lit(" activities, "),
        py_str_double(val("region", "total_resource", g["k"])), F.lit(" resource, avg progress "),
        py_str_double(val("region", "avg_progress", g["k"])), F.lit("%"))))
    text = F.concat(
        F.lit("=== EXECUTIVE BRIEF ===\nAs of: " + as_of_label + "\n\nACTIVITIES ("), n("survey", "total"),
        F.lit("):\n- Running: "), n("survey", "running"), F.lit(" | Done: "), n("survey", "done"),
        F.lit(" | Not started: "), n("survey", "not_started"),
        F.lit("\n- Kinds: 3D ("), n("survey", "kind_3d"), F.lit("), 2D ("), n("survey", "kind_2d"),
        F.lit("), Other ("), n("survey", "kind_other"),
        F.lit(")\n- Area: Onshore ("), n("survey", "onshore"), F.lit("), Offshore ("), n("survey", "offshore"),
        F.lit(")\n- Planned: $"), _fmt0(planned), F.lit(" | Realised: $"), _fmt0(realised),
        F.lit(" ("), F.regexp_replace(F.format_number(pct, 1), ",", ""), F.lit("%)"),
        F.lit("\n- Resource: "),
        F.format_number(F.coalesce(val("survey", "total_resource"), F.lit(0.0)), 1),
        F.lit(" (P50)\n- Avg progress: "),
        F.coalesce(py_str_double(val("survey", "avg_progress")), F.lit("None")), F.lit("%"),
        F.lit("\n\nSTUDIES ("), n("study", "total"), F.lit("):\n- Not started: "), n("study", "not_started"),
        F.lit(" | Done: "), n("study", "done"), F.lit("\n- Budget: $"), _fmt0(val("study", "total_budget")),
        F.lit("\n- Types: "), F.concat_ws(", ", F.transform(
            types, lambda x: F.concat(x["k"], F.lit(" ("), x["n"].cast("string"), F.lit(")")))),
        F.lit("\n\nBY REGION:"), region_lines)
    pieces = rows.select(F.lit(0).alias("o"), text.alias("t"))
    if risks is not None:
        rk = F.concat_ws("", F.transform(
            F.sort_array(F.collect_list(F.struct("rule", "severity", "message", "action"))),
            lambda x: F.concat(F.lit("\n- ["), x["severity"], F.lit("] "), x["message"],
                               F.lit("\n  -> Action: "), x["action"])))
        pieces = pieces.unionByName(risks.agg(rk.alias("x")).select(
            F.lit(1).alias("o"),
            F.when(F.col("x") != "", F.concat(F.lit("\n\nRISK ALERTS:"), F.col("x"))).otherwise(F.lit(""))
            .alias("t")))
    body = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]))
    return pieces.agg(F.concat(body, F.lit("\n=======================")).alias("brief"))

"""Brief and risk rules: empty tables, tie determinism, firing conditions."""

from pyspark.sql import functions as F

from fieldpulse.operators import brief, catalogue, risks


def test_empty_tables_give_one_kpi_row_and_no_risk(spark, ws):
    a = ws.activity.limit(0)
    s = ws.study.limit(0)
    k = brief.survey_kpis(a).collect()
    assert len(k) == 1 and k[0].total == 0 and k[0].total_planned is None
    assert brief.study_kpis(s).first().total == 0
    assert risks.risk_table(a, s).count() == 0


def test_single_scan_brief_equals_separate_queries(spark, ws):
    long = {(r.section, r.key, r.measure): r.value for r in brief.brief_long(ws.activity, ws.study).collect()}
    for r in brief.by_region(ws.activity).collect():
        assert long[("region", r.region, "n_activities")] == r.n_activities
        assert long[("region", r.region, "total_resource")] == r.total_resource
    top = brief.top_holdings(ws.activity).collect()
    for i, r in enumerate(top, start=1):
        assert long[("holding", r.holding, "rank")] == i
    k = brief.survey_kpis(ws.activity).first()
    assert long[("survey", None, "total")] == k.total


def test_top_k_ties_are_deterministic(spark, ws):
    runs = [[r.activity_name for r in catalogue.q15_top_resource(ws.activity.repartition(n)).collect()]
            for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]
    h = [[r.holding for r in brief.top_holdings(ws.activity.repartition(n)).collect()] for n in (2, 5)]
    assert h[0] == h[1]


def test_study_rule_fires_only_when_all_not_started(spark, ws):
    assert risks.rule_studies(ws.study).count() == 0
    open_only = ws.study.filter(F.col("status") == "Not started")
    assert risks.rule_studies(open_only).count() == 1


def test_absorption_threshold(spark, ws):
    pct = risks.absorption_summary(ws.activity).first().pct
    assert risks.rule_absorption(ws.activity, threshold_pct=pct + 1).count() == 1
    assert risks.rule_absorption(ws.activity, threshold_pct=pct - 1).count() == 0


def test_delay_rule_details_are_top_three(spark, ws):
    r = risks.rule_delay(ws.activity).first()
    top = risks.delayed_top(ws.activity).collect()
    assert [d.activity_name for d in r.details] == [t.activity_name for t in top]
    assert len(r.details) <= 3


def test_brief_text_renders(spark, ws):
    a, s = ws.activity, ws.study
    t = brief.brief_text(brief.brief_long(a, s), risks.risk_table(a, s)).first().brief
    assert t.startswith("=== EXECUTIVE BRIEF ===")
    assert "BY REGION:" in t and "RISK ALERTS:" in t
    k = brief.survey_kpis(a).first()
    assert f"ACTIVITIES ({k.total}):" in t and f"Not started: {k.not_started}" in t
    regions = brief.by_region(a).collect()
    first = regions[0]
    assert f"\n- {first.region}: {first.n_activities} activities, {first.total_resource} resource" in t
    assert t.index(regions[0].region + ":") < t.index(regions[-1].region + ":")
    types = ", ".join(f"{x.study_type} ({x.n_studies})" for x in brief.studies_by_type(s).collect())
    assert f"- Types: {types}" in t


def test_cross_table_totals_without_join(spark, ws):
    r = catalogue.q30_cross_table_totals(ws.activity, ws.study).first()
    assert r.grand_total == r.total_activities + r.total_studies == ws.activity.count() + ws.study.count()


def test_detail_fanout_matches_sql_semantics(spark, ws):
    """Q-29's pair form (library only) against the reference's SQL, run by Spark SQL, on the small fixture."""
    ws.register_views()
    for name in (None, "act-77"):
        d = catalogue.technical_detail(ws.activity, ws.receiver, ws.shotpoint, name_contains=name)
        where = "" if name is None else f"WHERE LOWER(a.activity_name) LIKE '%{name}%'"
        ref = spark.sql(
            "SELECT a.activity_name, a.kind, r.n_receiver, r.receiver_spacing, s.n_shot, s.charge, s.charge_depth "
            "FROM activity a LEFT JOIN receiver r ON a.activity_id = r.activity_id "
            f"LEFT JOIN shotpoint s ON a.activity_id = s.activity_id {where}")
        assert d.exceptAll(ref).count() == 0 and ref.exceptAll(d).count() == 0
        assert d.count() == ref.count()

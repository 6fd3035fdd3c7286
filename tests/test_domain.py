"""The operators on the reference's own column names (landed, cleaned domain sheets)."""

import pytest
from pyspark.sql import functions as F

from fieldpulse.model import DOMAIN_ACTIVITY as DA, DOMAIN_STUDY as DS
from fieldpulse.operators import brief, catalogue as c, risks
from fieldpulse.operators.clean import STUDY_MAIN_SPEC, SURVEY_MAIN_SPEC, clean_sheet
from fieldpulse.sources.landing import landed_study_main, landed_survey_main


@pytest.fixture(scope="module")
def dom(spark, ws):
    a = clean_sheet(landed_survey_main(ws.activity), SURVEY_MAIN_SPEC, ws.as_of)
    s = clean_sheet(landed_study_main(ws.study), STUDY_MAIN_SPEC, ws.as_of)
    return a, s


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_every_catalogue_question_runs_on_domain_tables(dom):
    a, s = dom
    activity_qs = [c.q01_count_in_year, c.q02_total_planned, c.q03_count_done, c.q04_list_kind,
                   c.q07_distinct_exploration_areas, c.q08_region_spend, c.q09_delayed_list,
                   c.q10_offshore_running, c.q11_resource_per_region, c.q12_per_holding,
                   c.q15_top_resource, c.q16_high_potential_low_progress, c.q17_onshore_vs_offshore,
                   c.q18_with_obstacle, c.q19_holding_performance, c.q20_kind_in_region,
                   c.q21_technical_approval_share, c.q22_status_breakdown, c.q23_prospects_and_leads,
                   c.q24_top_planned, c.q28_carbonate_play]
    for q in activity_qs:
        q(a, m=DA).collect()
    for q in [c.q05_studies_not_started, c.q06_total_study_budget, c.q13_study_types_budget,
              c.q14_carry_over_not_started, c.q25_studies_per_holding, c.q26_studies_per_validator,
              c.q27_exploration_area]:
        q(s, st=DS).collect()
    c.q30_cross_table_totals(a, s).collect()


def test_domain_results_agree_with_adapter(dom, ws):
    a, s = dom
    # statuses are mapped 1:1 and trimmed by cleaning, so status counts agree
    from fieldpulse.sources.landing import STATUS_TO_DOMAIN

    dom_counts = {r.status: r.n_activities for r in c.q22_status_breakdown(a, m=DA).collect()}
    ad_counts = {STATUS_TO_DOMAIN[r.status]: r.n_activities for r in c.q22_status_breakdown(ws.activity).collect()}
    assert dom_counts == ad_counts
    # holdings are trimmed by cleaning, so per-holding counts agree
    assert rows(c.q12_per_holding(a, m=DA).select("holding", "n_activities")) == \
        rows(c.q12_per_holding(ws.activity).select("holding", "n_activities"))
    assert rows(c.q21_technical_approval_share(a, m=DA)) == rows(c.q21_technical_approval_share(ws.activity))
    assert rows(c.q23_prospects_and_leads(a, m=DA)) == rows(c.q23_prospects_and_leads(ws.activity))
    assert c.q05_studies_not_started(s, st=DS).first()[0] == c.q05_studies_not_started(ws.study).first()[0]
    k_dom, k_ad = brief.survey_kpis(a, DA).first(), brief.survey_kpis(ws.activity).first()
    assert (k_dom.total, k_dom.running, k_dom.done, k_dom.not_started) == \
        (k_ad.total, k_ad.running, k_ad.done, k_ad.not_started)


def test_brief_and_risks_on_domain_tables(dom):
    a, s = dom
    long = brief.brief_long(a, s, DA, DS)
    assert long.filter((F.col("section") == "survey") & (F.col("measure") == "total")).first().value == a.count()
    rules = {r.rule for r in risks.risk_table(a, s, DA, DS).collect()}
    assert rules <= {1, 2, 3, 4} and 1 in rules
    assert risks.rule_delay(a, DA).count() == 1

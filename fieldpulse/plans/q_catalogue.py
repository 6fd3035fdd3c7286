"""Registered queries: the 30 worked questions (Q) and the joins (J)."""

from __future__ import annotations

from fieldpulse.operators import catalogue as c
from fieldpulse.plans.oracle import with_adapter as W
from fieldpulse.plans.registry import REGISTRY

R = REGISTRY

_SPECS = [
    # name, operators, builder, oracle body
    ("q01_count_in_year", ("Q-01", "F-02", "A-01"), lambda ws: c.q01_count_in_year(ws.activity, dated_by="planned_start"),
     "SELECT COUNT(*) AS n_activities FROM activity WHERE year = 1998"),
    ("q02_total_planned", ("Q-02", "A-02"), lambda ws: c.q02_total_planned(ws.activity),
     "SELECT ROUND(SUM(planned_amount), 0) AS total_planned FROM activity"),
    ("q03_count_done", ("Q-03", "F-02"), lambda ws: c.q03_count_done(ws.activity),
     "SELECT COUNT(*) AS n_done FROM activity WHERE status = 'Done'"),
    ("q04_list_kind", ("Q-04", "F-01"), lambda ws: c.q04_list_kind(ws.activity),
     "SELECT activity_name, work_area, region, status FROM activity WHERE kind = 'MACHINERY' "
     "ORDER BY activity_name"),
    ("q05_studies_not_started", ("Q-05",), lambda ws: c.q05_studies_not_started(ws.study),
     "SELECT COUNT(*) AS n_not_started FROM study WHERE status = 'Not started'"),
    ("q06_total_study_budget", ("Q-06",), lambda ws: c.q06_total_study_budget(ws.study),
     "SELECT ROUND(SUM(planned_budget), 0) AS total_budget FROM study"),
    ("q07_distinct_exploration_areas", ("Q-07", "A-03"), lambda ws: c.q07_distinct_exploration_areas(ws.activity),
     "SELECT COUNT(DISTINCT work_area) AS n_work_areas FROM activity WHERE block_status = 'Exploration'"),
    ("q08_region_spend", ("Q-08",), lambda ws: c.q08_region_spend(ws.activity),
     "SELECT ROUND(SUM(planned_amount), 0) AS total_planned, COUNT(*) AS n_activities "
     "FROM activity WHERE region = 'ASIA'"),
    ("q09_delayed_list", ("Q-09", "F-03", "A-08"), lambda ws: c.q09_delayed_list(ws.activity),
     "SELECT activity_name, work_area, region, planned_start, resource_p50 AS resource, "
     "days_since_planned_start AS days_late FROM activity WHERE is_delayed ORDER BY resource_p50 DESC"),
    ("q10_offshore_running", ("Q-10", "F-04"), lambda ws: c.q10_offshore_running(ws.activity),
     "SELECT activity_name, work_area, progress_pct AS progress FROM activity "
     "WHERE area = 'Offshore' AND status LIKE 'Running%'"),
    ("q11_resource_per_region", ("Q-11",), lambda ws: c.q11_resource_per_region(ws.activity),
     "SELECT region, COUNT(*) AS n_activities, ROUND(SUM(resource_p50), 2) AS total_resource, "
     "ROUND(SUM(planned_amount), 0) AS total_planned FROM activity GROUP BY region ORDER BY total_resource DESC"),
    ("q12_per_holding", ("Q-12",), lambda ws: c.q12_per_holding(ws.activity),
     "SELECT holding, COUNT(*) AS n_activities, ROUND(SUM(planned_amount), 0) AS total_planned, "
     "ROUND(SUM(resource_p50), 2) AS total_resource FROM activity GROUP BY holding ORDER BY n_activities DESC"),
    ("q13_study_types_budget", ("Q-13",), lambda ws: c.q13_study_types_budget(ws.study),
     "SELECT study_type, COUNT(*) AS n_studies, ROUND(SUM(planned_budget), 0) AS total_budget "
     "FROM study GROUP BY study_type ORDER BY n_studies DESC"),
    ("q14_carry_over_not_started", ("Q-14",), lambda ws: c.q14_carry_over_not_started(ws.study),
     "SELECT study_area, COUNT(*) AS n_studies FROM study WHERE proposal_status = 'Carry Over' "
     "AND status = 'Not started' GROUP BY study_area ORDER BY n_studies DESC"),
    ("q15_top_resource", ("Q-15", "A-09", "F-11"), lambda ws: c.q15_top_resource(ws.activity),
     "SELECT activity_name, work_area, holding, resource_p50 AS resource, resource_oil, resource_gas, "
     "status, play FROM activity ORDER BY resource_p50 DESC, activity_id LIMIT 5"),
    ("q16_high_potential_low_progress", ("Q-16", "F-06"), lambda ws: c.q16_high_potential_low_progress(ws.activity),
     "SELECT activity_name, work_area, resource_p50 AS resource, progress_pct AS progress, status "
     "FROM activity WHERE resource_p50 > 50 AND progress_pct < 50 ORDER BY resource_p50 DESC"),
    ("q17_onshore_vs_offshore", ("Q-17",), lambda ws: c.q17_onshore_vs_offshore(ws.activity),
     "SELECT area, COUNT(*) AS n_activities, ROUND(SUM(planned_amount), 0) AS total_planned, "
     "ROUND(SUM(realised_amount), 0) AS total_realised, ROUND(AVG(progress_pct), 1) AS avg_progress "
     "FROM activity GROUP BY area"),
    ("q18_with_obstacle", ("Q-18", "F-08", "C-10"), lambda ws: c.q18_with_obstacle(ws.activity),
     "SELECT activity_name, work_area, region, obstacle, status FROM activity WHERE obstacle IS NOT NULL "
     "AND TRIM(obstacle) != '' AND obstacle != 'nan'"),
    ("q19_holding_performance", ("Q-19", "A-06"), lambda ws: c.q19_holding_performance(ws.activity),
     "SELECT holding, COUNT(*) AS n_activities, ROUND(AVG(progress_pct), 1) AS avg_progress, "
     "ROUND(SUM(planned_amount), 0) AS total_planned, ROUND(SUM(resource_p50), 2) AS total_resource "
     "FROM activity GROUP BY holding HAVING COUNT(*) >= 1 ORDER BY avg_progress DESC"),
    ("q20_kind_in_region", ("Q-20",), lambda ws: c.q20_kind_in_region(ws.activity),
     "SELECT activity_name, work_area, planned_qty AS target_qty, realised_qty, status FROM activity "
     "WHERE kind = 'MACHINERY' AND region = 'EUROPE'"),
    ("q21_technical_approval_share", ("Q-21", "F-09", "F-10"), lambda ws: c.q21_technical_approval_share(ws.activity),
     "SELECT COUNT(CASE WHEN technical_approval = 'Yes' THEN 1 END) AS approved, COUNT(*) AS total, "
     "ROUND(CAST(COUNT(CASE WHEN technical_approval = 'Yes' THEN 1 END) AS DOUBLE) * 100 / COUNT(*), 1) AS pct "
     "FROM activity"),
    ("q22_status_breakdown", ("Q-22",), lambda ws: c.q22_status_breakdown(ws.activity),
     "SELECT status, COUNT(*) AS n_activities FROM activity GROUP BY status ORDER BY n_activities DESC"),
    ("q23_prospects_and_leads", ("Q-23",), lambda ws: c.q23_prospects_and_leads(ws.activity),
     "SELECT CAST(SUM(prospects) AS BIGINT) AS total_prospects, CAST(SUM(leads) AS BIGINT) AS total_leads, "
     "CAST(SUM(prospects) + SUM(leads) AS BIGINT) AS total_structures FROM activity"),
    ("q24_top_planned", ("Q-24", "F-11"), lambda ws: c.q24_top_planned(ws.activity),
     "SELECT activity_name, work_area, holding, ROUND(planned_amount, 0) AS planned, status FROM activity "
     "WHERE planned_amount > 0 ORDER BY planned_amount DESC, activity_id LIMIT 10"),
    ("q25_studies_per_holding", ("Q-25",), lambda ws: c.q25_studies_per_holding(ws.study),
     "SELECT holding, COUNT(*) AS n_studies, ROUND(SUM(planned_budget), 0) AS total_budget FROM study "
     "GROUP BY holding ORDER BY n_studies DESC, holding ASC NULLS LAST LIMIT 10"),
    ("q26_studies_per_validator", ("Q-26", "C-10"), lambda ws: c.q26_studies_per_validator(ws.study),
     "SELECT validator, COUNT(*) AS n_studies FROM study WHERE validator IS NOT NULL AND TRIM(validator) != '' "
     "AND validator != 'nan' GROUP BY validator ORDER BY n_studies DESC"),
    ("q27_exploration_area", ("Q-27", "A-03"), lambda ws: c.q27_exploration_area(ws.study),
     "SELECT ROUND(SUM(area_km2), 2) AS total_area_km2, COUNT(DISTINCT work_area) AS n_work_areas "
     "FROM study WHERE block_status = 'Exploration'"),
    ("q28_carbonate_play", ("Q-28", "F-05", "F-07"), lambda ws: c.q28_carbonate_play(ws.activity),
     "SELECT activity_name, work_area, play, resource_p50 AS resource FROM activity "
     "WHERE LOWER(play) LIKE '%carbonate%' OR LOWER(play) LIKE '%karbonat%'"),
    ("q30_cross_table_totals", ("Q-30", "J-03"), lambda ws: c.q30_cross_table_totals(ws.activity, ws.study),
     "SELECT (SELECT COUNT(*) FROM activity) AS total_activities, (SELECT COUNT(*) FROM study) AS total_studies, "
     "(SELECT COUNT(*) FROM activity) + (SELECT COUNT(*) FROM study) AS grand_total"),
    # Q-29 / J-01 over the whole tables: the reference's two LEFT JOINs emit
    # receiver x shot-point pairs per activity (quadratic for a hot key), so the
    # registered form reduces each detail table to one row per activity first.
    # The pair form, catalogue.technical_detail, is tested against Spark SQL on
    # the small fixture.
    ("j01_j02_detail_rollup", ("Q-29", "J-01", "J-02"),
     lambda ws: c.detail_rollup(ws.activity, ws.receiver, ws.shotpoint, ws.recording),
     """SELECT a.activity_id, a.activity_name, a.kind,
               COALESCE(r.rcv_rows, 0) AS rcv_rows, r.rcv_sum_n_receiver, r.rcv_sum_receiver_spacing,
               COALESCE(s.shot_rows, 0) AS shot_rows, s.shot_sum_n_shot, s.shot_sum_charge, s.shot_sum_charge_depth,
               COALESCE(c.rec_rows, 0) AS rec_rows, c.rec_sum_fold, c.rec_sum_far_offset
        FROM activity a
        LEFT JOIN (SELECT activity_id, COUNT(*) AS rcv_rows, ROUND(SUM(n_receiver), 4) AS rcv_sum_n_receiver,
                          ROUND(SUM(receiver_spacing), 4) AS rcv_sum_receiver_spacing FROM receiver GROUP BY 1) r
               ON a.activity_id = r.activity_id
        LEFT JOIN (SELECT activity_id, COUNT(*) AS shot_rows, ROUND(SUM(n_shot), 4) AS shot_sum_n_shot,
                          ROUND(SUM(charge), 4) AS shot_sum_charge, ROUND(SUM(charge_depth), 4) AS shot_sum_charge_depth
                   FROM shotpoint GROUP BY 1) s ON a.activity_id = s.activity_id
        LEFT JOIN (SELECT activity_id, COUNT(*) AS rec_rows, ROUND(SUM(fold), 4) AS rec_sum_fold,
                          ROUND(SUM(far_offset), 4) AS rec_sum_far_offset FROM recording GROUP BY 1) c
               ON a.activity_id = c.activity_id"""),
    ("q29_technical_detail", ("Q-29", "J-01", "J-02"),
     lambda ws: c.q29_technical_detail(ws.activity, ws.receiver, ws.shotpoint, ws.recording, "act-1"),
     """SELECT a.activity_id, a.activity_name, a.kind, a.planned_qty, a.realised_qty, a.resource_oil, a.resource_gas, a.prospects, a.leads, a.play,
               COALESCE(r.n, 0) AS rcv_rows, r.x AS rcv_sum_n_receiver, r.y AS rcv_sum_receiver_spacing,
               COALESCE(s.n, 0) AS shot_rows, s.x AS shot_sum_n_shot, s.y AS shot_sum_charge, s.z AS shot_sum_charge_depth,
               COALESCE(c.n, 0) AS rec_rows, c.x AS rec_sum_fold, c.y AS rec_sum_far_offset
        FROM activity a
        LEFT JOIN (SELECT activity_id, COUNT(*) AS n, ROUND(SUM(n_receiver), 4) AS x, ROUND(SUM(receiver_spacing), 4) AS y FROM receiver GROUP BY 1) r ON a.activity_id = r.activity_id
        LEFT JOIN (SELECT activity_id, COUNT(*) AS n, ROUND(SUM(n_shot), 4) AS x, ROUND(SUM(charge), 4) AS y, ROUND(SUM(charge_depth), 4) AS z FROM shotpoint GROUP BY 1) s ON a.activity_id = s.activity_id
        LEFT JOIN (SELECT activity_id, COUNT(*) AS n, ROUND(SUM(fold), 4) AS x, ROUND(SUM(far_offset), 4) AS y FROM recording GROUP BY 1) c ON a.activity_id = c.activity_id
        WHERE LOWER(a.activity_name) LIKE '%act-1%'"""),
]


def _register(name, ops, build, body):
    R.query(name, W(body), ops, headline=name in _HEADLINE)(build)


_HEADLINE = {"q11_resource_per_region", "q16_high_potential_low_progress", "j01_j02_detail_rollup"}

for _spec in _SPECS:
    _register(*_spec)

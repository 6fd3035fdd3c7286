"""Post-load validation checks (V-01..V-06) as one long-form table.

``(check, key, value)``: total activities, total studies, total planned spend,
total resource, activities per status, studies per type. One grouping-sets
aggregate per relation, so each relation is scanned once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.model import ADAPTER_ACTIVITY, ADAPTER_STUDY, ActivityModel, StudyModel


def validation_checks(activity: DataFrame, study: DataFrame,
                      m: ActivityModel = ADAPTER_ACTIVITY, s: StudyModel = ADAPTER_STUDY) -> DataFrame:
    a = activity.withColumn("g_status", m.c("status")).groupingSets(
        [[], ["g_status"]], "g_status").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(m.c("planned_amount")), 0).alias("planned"),
        F.round(F.sum(m.c("resource_p50")), 2).alias("resource"),
        F.grouping_id().alias("gid"))
    b = study.withColumn("g_type", s.c("study_type")).groupingSets(
        [[], ["g_type"]], "g_type").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))

    def rows(df, cases):
        # One projection per aggregate (see brief.long_by_grouping): the
        # measure array is picked by grouping id, so the input runs once.
        arr = None
        for gid, pairs in cases.items():
            items = F.array(*[F.struct(F.lit(name).alias("check"), key.cast("string").alias("key"),
                                       val.cast("double").alias("value")) for name, key, val in pairs])
            arr = F.when(F.col("gid") == gid, items) if arr is None else arr.when(F.col("gid") == gid, items)
        return df.select(F.inline(arr))

    none = F.lit(None).cast("string")
    checks_a = rows(a, {
        1: [("total_activities", none, F.col("n")), ("total_planned", none, F.col("planned")),
            ("total_resource", none, F.col("resource"))],
        0: [("activities_per_status", F.col("g_status"), F.col("n"))]})
    checks_b = rows(b, {
        1: [("total_studies", none, F.col("n"))],
        0: [("studies_per_type", F.col("g_type"), F.col("n"))]})
    return checks_a.unionByName(checks_b)

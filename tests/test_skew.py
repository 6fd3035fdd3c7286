"""Hot keys: one key holding a third of the rows must not change any result."""

from pyspark.sql import functions as F

from fieldpulse.operators import brief, catalogue, report, sqlguard


def test_detail_rollup_with_a_hot_activity(spark, ws):
    hot = ws.activity.agg(F.min("activity_id")).first()[0]
    rcv = ws.receiver
    n = rcv.count()
    # add n/2 extra receiver rows for one activity: it then holds a third of the rows
    extra = spark.range(n // 2).select(F.lit(hot).cast("long").alias("activity_id"),
                                       (F.col("id") % 7).cast("double").alias("n_receiver"),
                                       F.lit(1.0).alias("receiver_spacing"))
    skewed = rcv.unionByName(extra)
    out = catalogue.detail_rollup(ws.activity, skewed, ws.shotpoint, ws.recording)
    assert out.count() == ws.activity.count()                     # one row per activity, whatever the skew
    got = out.filter(F.col("activity_id") == hot).first()
    pdf = skewed.filter(F.col("activity_id") == hot).toPandas()
    assert got.rcv_rows == len(pdf)
    assert got.rcv_sum_n_receiver == round(pdf.n_receiver.sum(), 4)


def test_brief_with_a_hot_region(spark, ws):
    a = ws.activity.withColumn("region", F.when(F.col("activity_id") % 3 == 0, F.lit("HOT"))
                               .otherwise(F.col("region")))
    long = {(r.section, r.key, r.measure): r.value for r in brief.brief_long(a, ws.study).collect()}
    pdf = a.select("region", "resource_p50").toPandas()
    want = pdf.groupby("region").size()
    for region, count in want.items():
        assert long[("region", region, "n_activities")] == count
    assert long[("survey", None, "total")] == len(pdf)


def test_attempt_log_with_a_hot_question(spark):
    rows = [("hot", i, f"s{i}", "err") for i in range(1, 3001)] + [("cold", 1, "ok", None)]
    df = spark.createDataFrame(rows, "qid string, attempt int, sql string, error string").repartition(8)
    got = {r.qid: r for r in sqlguard.attempt_log(df, "qid", "attempt").collect()}
    assert (got["hot"].attempts, got["hot"].success, got["hot"].last_sql) == (3, False, "s3")
    assert (got["cold"].attempts, got["cold"].success) == (1, True)


def test_page_merge_with_a_hot_host(spark):
    rows = [(i, "https://hot.example.com/p", f"<body>page {i} " + "x" * 50 + "</body>") for i in range(600)]
    rows += [(1000, "https://cold.example.org/", "<body>lone</body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    out = {r.group: r for r in report.merge_page_text(
        df, report.page_host(F.col("url")), "page_id", F.col("page_id").cast("string"),
        report.html_text(F.col("html"))).collect()}
    pieces = "".join(f"\n\n--- {i} ---\npage {i} " + "x" * 50 for i in range(600))
    assert out["hot.example.com"].text == pieces[:report.PAGE_TOTAL_CHARS]
    assert out["cold.example.org"].text == "\n\n--- 1000 ---\nlone"

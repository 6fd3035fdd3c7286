"""Result reports and text merges."""

import json

from pyspark.sql import functions as F

from fieldpulse.operators import report


def test_simple_result_formats_like_python(spark):
    df = spark.createDataFrame([(1234567, 2345678.5, 42.25)], "total_count long, money double, pct double")
    got = report.simple_result(df).first().answer
    want = "\n".join([f"**Total Count**: {1234567:,}", f"**Money**: ${2345678.5:,.0f}",
                      f"**Pct**: {42.25:.1f}%"])
    assert got == want
    df2 = spark.createDataFrame([(150.55,)], "avg_p50_x double")
    assert report.simple_result(df2).first().answer == f"**{'avg p50 x'.title()}**: {150.55:,.1f}"


def test_list_report(spark):
    df = spark.range(25).select(F.col("id").alias("k"), F.lit("nan").alias("blank"),
                                (F.col("id") * 1.5).alias("v"))
    text = report.list_report(df, [F.asc("k")]).first().report
    lines = text.split("\n")
    assert lines[0] == "Found 25 results:"
    assert lines[2] == "1. k: 0 | v: 0.0"
    assert lines[11] == "10. k: 9 | v: 13.5"
    assert text.endswith("... and 15 more results.")
    empty = report.list_report(df.limit(0), [F.asc("k")]).first().report
    assert empty == report.TEXT_NO_DATA


def test_digest(spark):
    df = spark.range(30).select(F.col("id").alias("k"))
    r = report.result_digest(df, [F.desc("k")]).first()
    data, more = r.digest.split("\n")
    assert [x["k"] for x in json.loads(data)] == list(range(29, 9, -1))
    assert more == "... and 10 more rows" and r.row_count == 30


def test_html_text(spark):
    html = ("<html><head><title>T</title><script>var a='<p>x</p>';</script></head>"
            "<body><style>p{}</style><p>Hello &amp; <b>bye</b></p>\n<script>x()</script> end</body></html>")
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(report.html_text(F.col("h"))).first()[0] == "Hello & bye end"


def test_page_merge_bounded_and_cut(spark):
    rows = [(i, "https://a.example.com/p" if i % 2 else "http://b.example.org/x", "<body>" + "w" * 4000 + "</body>")
            for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.group: r for r in report.merge_page_text(
        df, report.page_host(F.col("url")), "page_id", F.col("page_id").cast("string"),
        report.html_text(F.col("html"))).collect()}
    assert set(out) == {"a.example.com", "b.example.org"}
    t = out["b.example.org"].text
    assert len(t) == report.PAGE_TOTAL_CHARS
    assert t.startswith("\n\n--- 0 ---\n" + "w" * 100)
    assert "\n\n--- 2 ---\n" in t


def test_python_float_rendering(spark):
    """Brute force against Python ``str(float)`` (T-09 renders cells like the reference's str())."""
    import random

    random.seed(11)
    vals = [0.0, -0.0, 1.0, 0.1, 1 / 3, 1e-4, 9.99e-05, 1e15, 1e16, 12345678.9, 150.55, 2.675,
            1.7976931348623157e308, 1e-300, -1e22, float("nan"), float("inf"), float("-inf")]
    vals += [round(random.uniform(-1e6, 1e6), random.randint(0, 6)) for _ in range(300)]
    vals += [random.uniform(0, 1) for _ in range(150)] + [random.uniform(-1e12, 1e12) for _ in range(150)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = {r.i: r.s for r in df.select("i", report.py_str_double(F.col("v")).alias("s")).collect()}
    assert [got[i] for i in range(len(vals))] == [str(v) for v in vals]


def test_number_formats_match_python_fstrings(spark):
    """Half-even on the binary value, as Python formats: ties such as 0.25 or 42.25 round to even."""
    from fieldpulse.operators.risks import _fmt1

    vals = [0.25, 0.35, 0.15, 2.675, 42.25, 343760.05, 1234567.25, 1e6 + 0.5, 2.5, 3.5, -2.5, 40.1, 99.95, 0.0, 123.45]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    rows = {r.i: r for r in df.select("i", _fmt1(F.col("v")).alias("a"), F.format_number("v", 0).alias("b"),
                                      report.format_cell(F.col("v"), df.schema["v"].dataType).alias("c")).collect()}
    for i, v in enumerate(vals):
        assert rows[i].a == f"{v:.1f}", v
        assert rows[i].b == f"{v:,.0f}", v
        want = f"${v:,.0f}" if abs(v) > 1_000_000 else (f"{v:,.1f}" if abs(v) > 100 else f"{v:.1f}%")
        assert rows[i].c == want, v


def test_list_report_pair_filter(spark):
    df = spark.createDataFrame([(1, None, "\t", "nan", "None", 2.5, "x")],
                               "a int, b string, c string, d string, e string, f double, g string")
    line = report.list_report(df, [F.asc("a")]).first().report.split("\n")[2]
    # the reference keeps a pair when the value is not None, str(value).strip() and != "nan"; five at most
    assert line == "1. a: 1 | e: None | f: 2.5 | g: x"

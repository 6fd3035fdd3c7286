"""Routing rules: the reference's 20 labelled questions, UI shortcuts, and a brute-force check.

The brute-force side evaluates the same fixed patterns with Python's ``re`` (the
engine the rules were written for) and must agree with the Spark columns on
every string, including Unicode word-boundary and whitespace edge cases.
"""

import re

import pytest
from pyspark.sql import functions as F

from fieldpulse.operators import router

# Fixed test values: the reference's labelled questions (FIXTURES §3).
LABELLED = [
    ("Berapa total kegiatan survei tahun ini?", "quantitative", "keyword"),
    ("Berapa total investasi AFE seluruh survei?", "quantitative", "keyword"),
    ("Survei mana saja yang terlambat?", "quantitative", "fallback"),
    ("Top 5 survei dengan potensi resource terbesar", "quantitative", "keyword"),
    ("Berikan executive brief kondisi terkini", "precomputed", "keyword"),
    ("Bandingkan kinerja per holding company", "quantitative", "keyword"),
    ("Total potensi resource per region", "quantitative", "keyword"),
    ("Berapa studi yang masih belum mulai?", "quantitative", "keyword"),
    ("Studi tipe apa yang paling banyak?", "quantitative", "fallback"),
    ("Berapa total anggaran studi tahun ini?", "quantitative", "keyword"),
    ("Daftar semua survei seismik 3D", "quantitative", "keyword"),
    ("Survei mana yang punya potensi besar tapi progress rendah?", "quantitative", "keyword"),
    ("Daftar survei offshore yang sedang berjalan", "quantitative", "keyword"),
    ("Survei apa saja yang play-nya karbonat?", "quantitative", "fallback"),
    ("Bandingkan onshore dan offshore", "quantitative", "keyword"),
    ("Daftar survei dengan kendala operasional", "quantitative", "keyword"),
    ("Status pelaksanaan survei breakdown", "quantitative", "keyword"),
    ("Berapa total prospect dan lead di seluruh survei?", "quantitative", "keyword"),
    ("Validator yang menangani paling banyak studi", "quantitative", "fallback"),
    ("Berapa total kegiatan survei dan studi keseluruhan?", "quantitative", "keyword"),
]
UI_SHORTCUTS = [
    "Berikan executive brief terkini", "Berapa total kegiatan survei tahun ini?",
    "Survei mana yang terlambat?", "Top 5 potensi resource terbesar",
    "Berapa total investasi AFE seluruh survei?", "Perbandingan progress per holding",
    "Distribusi survei per region", "Berapa studi yang belum mulai?", "Bandingkan onshore vs offshore",
    "Apa saja kendala operasional lapangan?", "Executive brief", "Total survei tahun ini",
    "Survei terlambat", "Top 5 resource", "Risk alerts",
]


def python_route(q: str):
    """Brute force: the fixed rules evaluated with Python ``re``, first match wins."""
    low = q.lower()
    for route, patterns, tables in router.KEYWORD_RULES:
        for p in patterns:
            if re.search(p, low):
                return route, p
    return router.DEFAULT_ROUTE, None


def python_tables(q: str) -> str:
    low = q.lower()
    sv = any(w in low for w in router.SURVEY_KEYWORDS)
    st = any(w in low for w in router.STUDY_KEYWORDS)
    return "both" if sv == st else ("study_main" if st else "survey_main")


def edge_strings() -> list[str]:
    words = set()
    for _, patterns, _ in router.KEYWORD_RULES:
        for p in patterns:
            words.update(re.findall(r"[a-z][a-z\-]+", p))
    out = []
    for w in sorted(words):
        out += [w, f"x {w} y", f"é{w}", f"{w}é", f"{w}_", f"_{w}", f"{w} x", f"ü {w}.",
                f"{w}1", f"1{w}", f"({w})", w.upper(), f"{w}\n{w}"]
    out += ["top 5", "top5", "top 7", "top ٣", "progress\nrendah", "progress x rendah",
            "per  region", "per\tholding", "apa kendala", "status pelaksanaan",
            "kondisi\x0bterkini", "rata-rata", "rata rata", "lab report", "label", "g&g x"]
    return out


@pytest.fixture(scope="module")
def routed(spark):
    rows = [(i, q) for i, (q, _, _) in enumerate(LABELLED)]
    df = spark.createDataFrame(rows, "i int, question string")
    return {r.i: r for r in router.route_questions(df).collect()}


def test_labelled_questions_route_as_expected(routed):
    for i, (q, route, by) in enumerate(LABELLED):
        assert routed[i].route == route, q
        assert routed[i].method == by, q
    accuracy = sum(routed[i].route == r for i, (_, r, _) in enumerate(LABELLED)) / len(LABELLED)
    assert accuracy == 1.0


def test_router_accuracy_report(spark):
    df = spark.createDataFrame([(q, r) for q, r, _ in LABELLED], "question string, expected_route string")
    rep = {r.method: r for r in router.router_accuracy(router.route_questions(df)).collect()}
    assert rep["keyword"].n == 16 and rep["fallback"].n == 4
    assert rep["keyword"].accuracy_pct == 100.0 and rep["fallback"].accuracy_pct == 100.0


def test_spark_rules_equal_python_rules(spark):
    texts = [q for q, _, _ in LABELLED] + UI_SHORTCUTS + edge_strings()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, question string")
    got = {r.i: r for r in router.route_questions(df).collect()}
    for i, t in enumerate(texts):
        route, pattern = python_route(t)
        assert (got[i].route, got[i].matched_pattern) == (route, pattern), repr(t)
        expected_tables = "both" if route == "precomputed" else python_tables(t)
        assert got[i].tables == expected_tables, repr(t)


def test_table_inference_is_substring(spark):
    df = spark.createDataFrame([("label",), ("studi survei",), ("nothing",), ("play",)], "q string")
    got = [r.t for r in df.select(router.infer_tables(F.col("q")).alias("t")).collect()]
    assert got == ["study_main", "both", "both", "survey_main"]


def test_logged_route_parsing(spark):
    df = spark.createDataFrame([
        ('```json\n{"route": "qualitative", "tables": ["both"]}\n```',),
        ('{"route": "nonsense"}',),
        ("not json",)], "a string")
    out = [r.r for r in df.select(router.parse_logged_route(F.col("a"), F.lit("q")).alias("r")).collect()]
    assert (out[0].route, out[0].method) == ("qualitative", "llm")
    assert out[1].route == "quantitative"
    assert (out[2].route, out[2].method) == ("quantitative", "llm_fallback")

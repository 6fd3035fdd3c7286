"""Cleaning edge cases on hand-made frames (FIXTURES §4)."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldpulse.functions.columns import has_text
from fieldpulse.operators.clean import STUDY_MAIN_SPEC, SURVEY_MAIN_SPEC, clean_sheet, with_load_quality

AS_OF = "2026-01-03 00:00:00"
SCHEMA = ("NAMA_KEGIATAN string, REALISASI_STATUS_PELAKSANAAN string, RENCANA_WAKTU_MULAI string, "
          "P_REALISASI_KEGIATAN double, P_IZIN_UKL_UPL string, NILAI_AFE_INVESTASI string, "
          "REGION_SKK string, KENDALA_OPERASIONAL_LAPANGAN string")
ROWS = [
    ("a", " Belum Mulai", "2025-01-01 00:00:00", 150.0, "150", "abc", None, None),
    ("b", "Belum Mulai", None, -5.0, "-5", "1,000", "\t a \n", "  "),
    ("c", "Belum Mulai", "2027-01-01", None, None, " 1.5 ", "x", "nan"),
    ("d", "Belum Mulai", "2026-01-01 12:00:00", float("nan"), "x", None, "y", "x"),
    ("e", "Selesai", "garbage", 50.0, "50", "2", "z", None),
    ("f", "Belum Mulai", "2026-01-05", 10.0, "10", "3", "z", None),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return {r["NAMA_KEGIATAN"]: r for r in clean_sheet(df, SURVEY_MAIN_SPEC, AS_OF).collect()}


def test_delay_reads_untrimmed_status(cleaned):
    assert cleaned["a"]["IS_DELAYED"] is False          # ' Belum Mulai' is never delayed
    assert cleaned["a"]["REALISASI_STATUS_PELAKSANAAN"] == "Belum Mulai"  # but stored trimmed


def test_null_planned_start(cleaned):
    assert cleaned["b"]["IS_DELAYED"] is False
    assert cleaned["b"]["DAYS_SINCE_PLANNED_START"] == 0


def test_future_planned_start(cleaned):
    assert cleaned["c"]["IS_DELAYED"] is False
    assert cleaned["c"]["DAYS_SINCE_PLANNED_START"] == 0


def test_elapsed_not_calendar_days(cleaned):
    assert cleaned["d"]["IS_DELAYED"] is True
    assert cleaned["d"]["DAYS_SINCE_PLANNED_START"] == 1


def test_percent_clamp(cleaned):
    assert [cleaned[k]["P_REALISASI_KEGIATAN"] for k in "abcd"] == [100.0, 0.0, 0.0, 0.0]


def test_text_percent_not_clamped(cleaned):
    assert cleaned["a"]["P_IZIN_UKL_UPL"] == "150"
    assert cleaned["b"]["P_IZIN_UKL_UPL"] == "-5"


def test_amount_coercion(cleaned):
    assert [cleaned[k]["NILAI_AFE_INVESTASI"] for k in "abcd"] == [0.0, 0.0, 1.5, 0.0]


def test_dates(cleaned):
    assert cleaned["e"]["RENCANA_WAKTU_MULAI"] is None
    assert cleaned["f"]["RENCANA_WAKTU_MULAI"] == datetime(2026, 1, 5)
    assert cleaned["c"]["RENCANA_WAKTU_MULAI"] == datetime(2027, 1, 1)


def test_text_standardised(cleaned):
    assert cleaned["a"]["REGION_SKK"] == "nan"
    assert cleaned["b"]["REGION_SKK"] == "a"


def test_keeps_sql_nulls_when_asked(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = {r.NAMA_KEGIATAN: r for r in clean_sheet(df, SURVEY_MAIN_SPEC, AS_OF, null_token=None).collect()}
    assert out["a"].REGION_SKK is None                               # text stays NULL
    assert out["d"].NILAI_AFE_INVESTASI is None                      # missing amount stays NULL
    assert out["a"].NILAI_AFE_INVESTASI is None                      # unparseable amount -> NULL
    assert out["c"].P_REALISASI_KEGIATAN is None and out["d"].P_REALISASI_KEGIATAN is None
    assert out["a"].P_REALISASI_KEGIATAN == 100.0 and out["c"].NILAI_AFE_INVESTASI == 1.5


def test_has_text(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("nan",), ("x",)], "v string")
    assert [r.v for r in df.filter(has_text("v")).collect()] == ["x"]


def test_all_planned_null_and_missing_column(spark):
    df = spark.createDataFrame([("a", "Belum Mulai", None)], "NAMA_KEGIATAN string, "
                               "REALISASI_STATUS_PELAKSANAAN string, RENCANA_WAKTU_MULAI string")
    r = clean_sheet(df, SURVEY_MAIN_SPEC, AS_OF).first()
    assert (r.IS_DELAYED, r.DAYS_SINCE_PLANNED_START) == (False, 0)
    no_planned = spark.createDataFrame([("a", "Belum Mulai")], "NAMA_KEGIATAN string, "
                                       "REALISASI_STATUS_PELAKSANAAN string")
    r = clean_sheet(no_planned, SURVEY_MAIN_SPEC, AS_OF).first()
    assert (r.IS_DELAYED, r.DAYS_SINCE_PLANNED_START) == (False, 0)


def test_missing_status_fails_the_sheet(spark):
    df = spark.createDataFrame([("a", "2025-01-01")], "NAMA_KEGIATAN string, RENCANA_WAKTU_MULAI string")
    with pytest.raises(Exception):
        clean_sheet(df, SURVEY_MAIN_SPEC, AS_OF).collect()


def test_study_rules(spark):
    df = spark.createDataFrame([("s", "abc", "150", "2026-02-01", " G&G ")],
                               "NAMA_STUDI string, RENCANA_ANGGARAN_AFE_INVESTASI string, "
                               "P_PROGRESS_PELAKSANAAN string, TGL_MULAI string, TIPE_STUDI string")
    r = clean_sheet(df, STUDY_MAIN_SPEC, AS_OF).first()
    assert r.RENCANA_ANGGARAN_AFE_INVESTASI == 0.0
    assert r.P_PROGRESS_PELAKSANAAN == 150.0      # study percentages are not clamped
    assert r.TGL_MULAI == datetime(2026, 2, 1)
    assert r.TIPE_STUDI == "G&G"
    assert "IS_DELAYED" not in r.asDict()


def test_load_quality_observed_without_second_scan(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    observed, obs = with_load_quality(clean_sheet(df, SURVEY_MAIN_SPEC, AS_OF))
    observed.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == len(ROWS)


def test_nan_amount_text(spark):
    from fieldpulse.functions.columns import coerce_number

    df = spark.createDataFrame([("nan",), ("inf",)], "v string")
    vals = [r[0] for r in df.select(coerce_number("v")).collect()]
    assert vals[0] == 0.0 and math.isinf(vals[1])


def test_number_coercion_matches_pandas(spark):
    """Brute force: pandas ``to_numeric(errors='coerce').fillna(0)`` is the reference behaviour."""
    import pandas as pd

    from fieldpulse.functions.columns import coerce_number

    cases = ["1", " 1.5 ", "+5", "-5", ".5", "5.", "1e5", "1E-3", "1.5d", "1.5f", "0x1p3", "inf", "-inf",
             "Infinity", "INF", "nan", "NaN", "1,000", "1_000", "abc", "", " ", "\t2\n", "1e", "e5", "--1",
             "1.2.3", "1e400", "0x10", "+inf", "  -0.0 ", "007", "1e+2", "-.5e-1"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, s string")
    got = {r.i: r.v for r in df.select("i", coerce_number("s").alias("v")).collect()}
    for i, v in enumerate(cases):
        want = float(pd.to_numeric(pd.Series([v], dtype=object), errors="coerce").fillna(0).iloc[0])
        assert got[i] == want, (v, got[i], want)


def test_strip_is_python_strip(spark):
    from fieldpulse.functions.columns import strip_ws

    values = ["\t a \n", " b　", " c\x0b", " d e ", "", "\x1ce\x1f"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.s for r in df.select("i", strip_ws("v").alias("s")).collect()}
    assert [got[i] for i in range(len(values))] == [v.strip() for v in values]

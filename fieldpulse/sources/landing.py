"""Landed sheets in the reference's layout, derived from the test tables.

The reference lands spreadsheet exports whose cells are messy: numbers as
text with thousands separators or padding, ``nan`` cells, percentages outside
0..100, unparseable dates, statuses with stray whitespace. These builders
derive sheets with exactly those defects from the adapter relations, chosen
deterministically by the row key, so the cleaning rules (which are
name-driven, on the reference's column names) run verbatim on data that grows
with the input tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.model import ADAPTER_ACTIVITY as A, ADAPTER_STUDY as S

# The reference's status vocabulary, keyed by the adapter's.
STATUS_TO_DOMAIN = {
    "Not started": "Belum Mulai",
    "Running (partial)": "Sedang Jalan (Sudah Recording)",
    "Done": "Selesai",
}
BLOCK_TO_DOMAIN = {"Exploration": "EKSPLORASI", "Exploitation": "EKSPLOITASI"}


def _map(c: Column, mapping: dict[str, str]) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def messy_number_text(value: Column, key: Column) -> Column:
    """Number as text; 1 in 17 rows get each of: word, thousands separator, padding, NULL, 'nan'."""
    r = key % 17
    return (F.when(r == 0, F.lit("abc")).when(r == 1, F.lit("1,000"))
            .when(r == 2, F.concat(F.lit(" "), value.cast("string"), F.lit(" ")))
            .when(r == 3, F.lit(None).cast("string")).when(r == 4, F.lit("nan"))
            .otherwise(value.cast("string")))


def messy_percent(value: Column, key: Column) -> Column:
    r = key % 19
    return (F.when(r == 0, F.lit(150.0)).when(r == 1, F.lit(-5.0))
            .when(r == 2, F.lit(float("nan"))).when(r == 3, F.lit(None).cast("double"))
            .otherwise(value.cast("double")))


def messy_timestamp_text(ts: Column, key: Column) -> Column:
    r = key % 13
    return (F.when(r == 0, F.lit("garbage")).when(r == 1, F.date_format(ts, "dd/MM/yyyy"))
            .when(r == 2, F.lit(None).cast("string"))
            .when(r == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
            .when(r == 4, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(r == 5, F.date_format(ts, "yyyy-MM-dd HH:mm:ss'.25+07:00'"))
            .when(r == 6, F.date_format(ts, "yyyy/MM/dd"))
            .when(r == 7, F.date_format(ts, "yyyy"))
            .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")))


def padded_text(value: Column, key: Column, modulus: int) -> Column:
    r = key % modulus
    return (F.when(r == 0, F.lit(None).cast("string"))
            .when(r == 1, F.concat(F.lit("\t "), value, F.lit(" \n")))
            .otherwise(value))


def landed_survey_main(activity: DataFrame) -> DataFrame:
    """The activity relation as a raw ``survey_main`` sheet (reference column names)."""
    k = F.col(A.id)
    status = _map(F.col(A.status), STATUS_TO_DOMAIN)
    r23 = k % 23
    return activity.select(
        F.col(A.name).alias("NAMA_KEGIATAN"),
        F.col(A.year).alias("TAHUN"),
        padded_text(F.col(A.work_area), k, 29).alias("WK"),
        F.col(A.work_area).alias("KKKS"),
        F.when(k % 31 == 0, F.concat(F.lit("  "), F.col(A.holding))).otherwise(F.col(A.holding)).alias("HOLDING"),
        F.when(k % 37 == 0, F.lit(None).cast("string")).otherwise(F.col(A.region)).alias("REGION_SKK"),
        F.col(A.kind).alias("JENIS_KEGIATAN"),
        F.col(A.area).alias("AREA_KEGIATAN"),
        _map(F.col(A.block_status), BLOCK_TO_DOMAIN).alias("STATUS_WK"),
        F.when(r23 == 0, F.concat(F.lit(" "), status)).when(r23 == 1, F.concat(status, F.lit("\t")))
         .otherwise(status).alias("REALISASI_STATUS_PELAKSANAAN"),
        messy_number_text(F.col(A.planned_amount), k).alias("NILAI_AFE_INVESTASI"),
        # exported amounts carry 4 decimals (a sum of doubles is exact only to its last bits)
        F.round(F.col(A.realised_amount), 4).cast("string").alias("REALISASI_AFE_INVESTASI"),
        F.col(A.resource_p50).alias("RR_TOTAL_P50_MMBOE"),
        F.col(A.resource_oil).alias("RR_P50_OIL_MMBOE"),
        F.col(A.resource_gas).alias("RR_P50_GAS_BSCF"),
        F.col(A.planned_qty).alias("RENCANA_KUANTITAS_PEKERJAAN"),
        F.col(A.realised_qty).alias("REALISASI_KUANTITAS_PEKERJAAN"),
        messy_percent(F.col(A.progress_pct), k).alias("P_REALISASI_KEGIATAN"),
        F.col(A.permit_a_pct).alias("P_IZIN_PPKH"),
        F.col(A.permit_b_pct).cast("string").alias("P_IZIN_UKL_UPL"),  # text-typed: not clamped
        F.col(A.procurement_pct).alias("P_PENGADAAN_KONTRAKTOR_SURVEI"),
        messy_timestamp_text(F.col(A.planned_start), k).alias("RENCANA_WAKTU_MULAI"),
        F.col(A.planned_start).alias("RENCANA_WAKTU_SELESAI"),
        F.col(A.obstacle).alias("KENDALA_OPERASIONAL_LAPANGAN"),
        F.col(A.play).alias("PLAY"),
        F.when(F.col(A.technical_approval) == A.approved, F.lit("Sudah")).otherwise(F.lit("Belum"))
         .alias("STATUS_PERSETUJUAN_TEKNIS"),
        F.col(A.prospects).alias("PROSPECT"),
        F.col(A.leads).alias("LEAD"),
    )


def write_csv_sheet(sheet: DataFrame, path: str, bad: dict[str, Column] | None = None) -> None:
    """Land a sheet as CSV, cells as they are; ``bad`` maps a column to the condition under which its cell is broken text."""
    for name, broken in (bad or {}).items():
        sheet = sheet.withColumn(name, F.when(broken, F.lit("n/a")).otherwise(F.col(name).cast("string")))
    sheet.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def landed_study_main(study: DataFrame) -> DataFrame:
    """The study relation as a raw ``study_main`` sheet (reference column names)."""
    k = F.col(S.id)
    r19 = k % 19
    return study.select(
        F.col(S.name).alias("NAMA_STUDI"),
        F.when(k % 7 == 0, F.concat(F.lit(" "), F.col(S.study_type), F.lit(" ")))
         .otherwise(F.col(S.study_type)).alias("TIPE_STUDI"),
        F.col(S.holding).alias("HOLDING"),
        F.col(S.work_area).alias("WK"),
        F.col(S.work_area).alias("KKKS"),
        _map(F.col(S.block_status), BLOCK_TO_DOMAIN).alias("STATUS_WK"),
        F.col(S.proposal_status).alias("STATUS_USULAN_KEGIATAN"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col(S.study_area)).alias("WILAYAH_SKK_MIGAS"),
        F.col(S.validator).alias("VALIDATOR"),
        _map(F.col(S.status), {"Not started": "Belum Mulai", "Done": "Selesai"}).alias("REALISASI_STATUS_PELAKSANAAN"),
        messy_number_text(F.col(S.planned_budget), k).alias("RENCANA_ANGGARAN_AFE_INVESTASI"),
        F.col(S.realised_budget).alias("REALISASI_ANGGARAN_AFE_INVESTASI"),
        F.when(r19 == 0, F.lit("150")).when(r19 == 1, F.lit("abc"))
         .otherwise((F.col(S.area_km2) * 2).cast("string")).alias("P_PROGRESS_PELAKSANAAN"),
        F.col(S.area_km2).alias("LUAS_WK_SAAT_INI_KM2"),
        F.when(k % 13 == 0, F.lit("garbage"))
         .otherwise(F.concat(F.lit("1999-"), F.lpad(((k % 12) + 1).cast("string"), 2, "0"), F.lit("-15")))
         .alias("TGL_MULAI"),
    )

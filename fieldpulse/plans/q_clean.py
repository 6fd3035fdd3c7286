"""Registered queries: landing and cleaning (C-01..C-11) over derived sheets."""

from __future__ import annotations

from fieldpulse.functions.columns import as_of_micros
from fieldpulse.operators.clean import STUDY_MAIN_SPEC, SURVEY_MAIN_SPEC, clean_sheet, load_quality
from fieldpulse.plans.oracle import with_adapter
from fieldpulse.plans.registry import REGISTRY
from fieldpulse.sources.landing import landed_study_main, landed_survey_main

R = REGISTRY
NL, TAB = "chr(10)", "chr(9)"


def _std(c: str) -> str:
    return f"COALESCE(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), 'nan')"


def _num_text(c: str) -> str:
    x = f"TRY_CAST({c} AS DOUBLE)"
    return f"COALESCE(CASE WHEN isnan({x}) THEN NULL ELSE {x} END, 0.0)"


def _num(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"COALESCE(CASE WHEN isnan({x}) THEN NULL ELSE {x} END, 0.0)"


def _clamp(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"GREATEST(0.0, LEAST(100.0, COALESCE(CASE WHEN isnan({x}) THEN NULL ELSE {x} END, 0.0)))"


def _ts_text(c: str) -> str:
    t = f"regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"
    # the cast reads a zone but doesn't apply it
    zone = f"CASE WHEN regexp_matches({t}, '[+-]\\d\\d:00$') THEN to_hours(CAST(right({t}, 6)[1:3] AS BIGINT)) ELSE INTERVAL 0 HOUR END"
    return f"COALESCE(TRY_CAST({t} AS TIMESTAMP) - {zone}, try_strptime({t}, ['%d/%m/%Y %H:%M:%S', '%d/%m/%Y']))"


def _messy_num(v: str, k: str) -> str:
    return (f"CASE {k} % 17 WHEN 0 THEN 'abc' WHEN 1 THEN '1,000' WHEN 2 THEN ' ' || CAST({v} AS VARCHAR) || ' ' "
            f"WHEN 3 THEN NULL WHEN 4 THEN 'nan' ELSE CAST({v} AS VARCHAR) END")


_STATUS = ("CASE status WHEN 'Not started' THEN 'Belum Mulai' "
           "WHEN 'Running (partial)' THEN 'Sedang Jalan (Sudah Recording)' WHEN 'Done' THEN 'Selesai' END")
_BLOCK = "CASE block_status WHEN 'Exploration' THEN 'EKSPLORASI' WHEN 'Exploitation' THEN 'EKSPLOITASI' END"

_LANDED_SURVEY = f"""landed AS (
  SELECT activity_name AS NAMA_KEGIATAN, year AS TAHUN,
         CASE activity_id % 29 WHEN 0 THEN NULL WHEN 1 THEN {TAB} || ' ' || work_area || ' ' || {NL} ELSE work_area END AS WK,
         work_area AS KKKS,
         CASE WHEN activity_id % 31 = 0 THEN '  ' || holding ELSE holding END AS HOLDING,
         CASE WHEN activity_id % 37 = 0 THEN NULL ELSE region END AS REGION_SKK,
         kind AS JENIS_KEGIATAN, area AS AREA_KEGIATAN, {_BLOCK} AS STATUS_WK,
         CASE activity_id % 23 WHEN 0 THEN ' ' || {_STATUS} WHEN 1 THEN {_STATUS} || {TAB} ELSE {_STATUS} END
           AS REALISASI_STATUS_PELAKSANAAN,
         {_messy_num('planned_amount', 'activity_id')} AS NILAI_AFE_INVESTASI,
         CAST(ROUND(realised_amount, 4) AS VARCHAR) AS REALISASI_AFE_INVESTASI,
         resource_p50 AS RR_TOTAL_P50_MMBOE, resource_oil AS RR_P50_OIL_MMBOE, resource_gas AS RR_P50_GAS_BSCF,
         planned_qty AS RENCANA_KUANTITAS_PEKERJAAN, realised_qty AS REALISASI_KUANTITAS_PEKERJAAN,
         CASE activity_id % 19 WHEN 0 THEN 150.0 WHEN 1 THEN -5.0 WHEN 2 THEN 'NaN'::DOUBLE WHEN 3 THEN NULL
              ELSE CAST(progress_pct AS DOUBLE) END AS P_REALISASI_KEGIATAN,
         permit_a_pct AS P_IZIN_PPKH, CAST(permit_b_pct AS VARCHAR) AS P_IZIN_UKL_UPL,
         procurement_pct AS P_PENGADAAN_KONTRAKTOR_SURVEI,
         CASE activity_id % 13 WHEN 0 THEN 'garbage' WHEN 1 THEN strftime(planned_start, '%d/%m/%Y') WHEN 2 THEN NULL
              WHEN 3 THEN strftime(planned_start, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(EXTRACT(MILLISECONDS FROM planned_start) % 1000 AS VARCHAR), 3, '0')
              WHEN 4 THEN strftime(planned_start, '%Y-%m-%dT%H:%M:%SZ') WHEN 5 THEN strftime(planned_start, '%Y-%m-%d %H:%M:%S.25+07:00')
              WHEN 6 THEN strftime(planned_start, '%Y/%m/%d') WHEN 7 THEN strftime(planned_start, '%Y')
              ELSE strftime(planned_start, '%Y-%m-%d %H:%M:%S') END AS RENCANA_WAKTU_MULAI,
         planned_start AS RENCANA_WAKTU_SELESAI,
         obstacle AS KENDALA_OPERASIONAL_LAPANGAN, play AS PLAY,
         CASE WHEN technical_approval = 'Yes' THEN 'Sudah' ELSE 'Belum' END AS STATUS_PERSETUJUAN_TEKNIS,
         prospects AS PROSPECT, leads AS LEAD
  FROM activity)"""



def _clean_survey_body() -> str:
    from fieldpulse.sources.adapter import DEFAULT_AS_OF
    as_of = as_of_micros(DEFAULT_AS_OF)
    planned = _ts_text("RENCANA_WAKTU_MULAI")
    body = f"""
SELECT NAMA_KEGIATAN, TAHUN, {_std('WK')} AS WK, {_std('KKKS')} AS KKKS, {_std('HOLDING')} AS HOLDING,
       {_std('REGION_SKK')} AS REGION_SKK, {_std('JENIS_KEGIATAN')} AS JENIS_KEGIATAN,
       {_std('AREA_KEGIATAN')} AS AREA_KEGIATAN, {_std('STATUS_WK')} AS STATUS_WK,
       {_std('REALISASI_STATUS_PELAKSANAAN')} AS REALISASI_STATUS_PELAKSANAAN,
       {_num_text('NILAI_AFE_INVESTASI')} AS NILAI_AFE_INVESTASI,
       {_num_text('REALISASI_AFE_INVESTASI')} AS REALISASI_AFE_INVESTASI,
       {_num('RR_TOTAL_P50_MMBOE')} AS RR_TOTAL_P50_MMBOE, {_num('RR_P50_OIL_MMBOE')} AS RR_P50_OIL_MMBOE,
       {_num('RR_P50_GAS_BSCF')} AS RR_P50_GAS_BSCF,
       {_num('RENCANA_KUANTITAS_PEKERJAAN')} AS RENCANA_KUANTITAS_PEKERJAAN,
       {_num('REALISASI_KUANTITAS_PEKERJAAN')} AS REALISASI_KUANTITAS_PEKERJAAN,
       {_clamp('P_REALISASI_KEGIATAN')} AS P_REALISASI_KEGIATAN, {_clamp('P_IZIN_PPKH')} AS P_IZIN_PPKH,
       P_IZIN_UKL_UPL, {_clamp('P_PENGADAAN_KONTRAKTOR_SURVEI')} AS P_PENGADAAN_KONTRAKTOR_SURVEI,
       {planned} AS RENCANA_WAKTU_MULAI, CAST(RENCANA_WAKTU_SELESAI AS TIMESTAMP) AS RENCANA_WAKTU_SELESAI,
       KENDALA_OPERASIONAL_LAPANGAN, PLAY, STATUS_PERSETUJUAN_TEKNIS, PROSPECT, LEAD,
       COALESCE(REALISASI_STATUS_PELAKSANAAN = 'Belum Mulai' AND epoch_us({planned}) < {as_of}, false) AS IS_DELAYED,
       CAST(COALESCE(GREATEST(0, CAST(FLOOR(({as_of} - epoch_us({planned})) / 86400000000.0) AS BIGINT)), 0)
            AS INTEGER) AS DAYS_SINCE_PLANNED_START
FROM landed"""
    return body


def _clean_survey_sql() -> str:
    return with_adapter(_clean_survey_body(), ctes=_LANDED_SURVEY)


_LANDED_STUDY = f"""landed_study AS (
  SELECT study_name AS NAMA_STUDI,
         CASE WHEN study_id % 7 = 0 THEN ' ' || study_type || ' ' ELSE study_type END AS TIPE_STUDI,
         holding AS HOLDING, work_area AS WK, work_area AS KKKS, {_BLOCK} AS STATUS_WK,
         proposal_status AS STATUS_USULAN_KEGIATAN,
         CASE WHEN study_id % 11 = 0 THEN NULL ELSE study_area END AS WILAYAH_SKK_MIGAS,
         validator AS VALIDATOR,
         CASE status WHEN 'Not started' THEN 'Belum Mulai' WHEN 'Done' THEN 'Selesai' END AS REALISASI_STATUS_PELAKSANAAN,
         {_messy_num('planned_budget', 'study_id')} AS RENCANA_ANGGARAN_AFE_INVESTASI,
         realised_budget AS REALISASI_ANGGARAN_AFE_INVESTASI,
         CASE study_id % 19 WHEN 0 THEN '150' WHEN 1 THEN 'abc' ELSE CAST(area_km2 * 2 AS VARCHAR) END
           AS P_PROGRESS_PELAKSANAAN,
         area_km2 AS LUAS_WK_SAAT_INI_KM2,
         CASE WHEN study_id % 13 = 0 THEN 'garbage'
              ELSE '1999-' || lpad(CAST(study_id % 12 + 1 AS VARCHAR), 2, '0') || '-15' END AS TGL_MULAI
  FROM study)"""


def _clean_study_body() -> str:
    return f"""
SELECT NAMA_STUDI, {_std('TIPE_STUDI')} AS TIPE_STUDI, {_std('HOLDING')} AS HOLDING, {_std('WK')} AS WK,
       {_std('KKKS')} AS KKKS, {_std('STATUS_WK')} AS STATUS_WK,
       {_std('STATUS_USULAN_KEGIATAN')} AS STATUS_USULAN_KEGIATAN,
       {_std('WILAYAH_SKK_MIGAS')} AS WILAYAH_SKK_MIGAS, VALIDATOR,
       {_std('REALISASI_STATUS_PELAKSANAAN')} AS REALISASI_STATUS_PELAKSANAAN,
       {_num_text('RENCANA_ANGGARAN_AFE_INVESTASI')} AS RENCANA_ANGGARAN_AFE_INVESTASI,
       {_num('REALISASI_ANGGARAN_AFE_INVESTASI')} AS REALISASI_ANGGARAN_AFE_INVESTASI,
       {_num_text('P_PROGRESS_PELAKSANAAN')} AS P_PROGRESS_PELAKSANAAN,
       {_num('LUAS_WK_SAAT_INI_KM2')} AS LUAS_WK_SAAT_INI_KM2,
       {_ts_text('TGL_MULAI')} AS TGL_MULAI
FROM landed_study"""


def _clean_study_sql() -> str:
    return with_adapter(_clean_study_body(), ctes=_LANDED_STUDY)


def cleaned_survey(ws):
    return clean_sheet(landed_survey_main(ws.activity), SURVEY_MAIN_SPEC, ws.as_of)


def cleaned_study(ws):
    return clean_sheet(landed_study_main(ws.study), STUDY_MAIN_SPEC, ws.as_of)


@R.query("c01_09_clean_survey_sheet", _clean_survey_sql(),
         ("C-01", "C-03", "C-04", "C-06", "C-07", "C-08", "C-09"), headline=True)
def _c_survey(ws):
    return cleaned_survey(ws)


@R.query("c02_05_clean_study_sheet", _clean_study_sql(), ("C-02", "C-05", "C-09"))
def _c_study(ws):
    return cleaned_study(ws)


@R.query("c11_load_quality", with_adapter(
    """SELECT 'survey_main' AS "table", COUNT(*) AS rows, 30 AS columns FROM activity
       UNION ALL SELECT 'study_main', COUNT(*), 15 FROM study"""), ("C-11",))
def _c11(ws):
    return load_quality(cleaned_survey(ws), "survey_main").unionByName(
        load_quality(cleaned_study(ws), "study_main"))


@R.query("c10_has_text_counts", with_adapter(
    """SELECT COUNT(CASE WHEN KENDALA_OPERASIONAL_LAPANGAN IS NOT NULL AND TRIM(KENDALA_OPERASIONAL_LAPANGAN) != ''
                          AND KENDALA_OPERASIONAL_LAPANGAN != 'nan' THEN 1 END) AS with_obstacle,
              COUNT(CASE WHEN REGION_SKK = 'nan' THEN 1 END) AS region_missing,
              COUNT(CASE WHEN IS_DELAYED THEN 1 END) AS delayed
       FROM cleaned""", ctes=_LANDED_SURVEY + ",\ncleaned AS (" + _clean_survey_body() + ")"), ("C-10", "C-06"))
def _c10(ws):
    from pyspark.sql import functions as F

    from fieldpulse.functions.columns import has_text
    c = cleaned_survey(ws)
    return c.agg(
        F.count(F.when(has_text("KENDALA_OPERASIONAL_LAPANGAN"), F.lit(1))).alias("with_obstacle"),
        F.count(F.when(F.col("REGION_SKK") == "nan", F.lit(1))).alias("region_missing"),
        F.count(F.when(F.col("IS_DELAYED"), F.lit(1))).alias("delayed"))

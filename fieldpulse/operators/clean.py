"""Cleaning and enrichment of landed sheets (C-01..C-11).

All rules are decided at plan time from the landed schema (names and types)
and applied in ONE projection, so cleaning is a narrow, codegen'd map over the
data: no shuffle, no Python per row.

Rule order matters and is kept: the delay flag reads the *untrimmed* status
(C-06 before C-09), so ``' Belum Mulai'`` is never delayed while the stored
status is trimmed. Because every output expression is built from the input
columns, the single projection reproduces that order exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from fieldpulse.functions.columns import (
    NULL_TOKEN, clamp_pct, coerce_number, coerce_timestamp, elapsed_days, is_before, standardise_text,
)

_TIME_TYPES = (DateType, TimestampType, TimestampNTZType)


@dataclass(frozen=True)
class CleanSpec:
    """Name-driven cleaning rules for one sheet."""

    is_timestamp: Callable[[str], bool]
    is_percent: Callable[[str], bool] | None
    amounts: tuple[str, ...]
    texts: tuple[str, ...]
    status: str | None = None
    planned_start: str | None = None
    not_started: str | None = None
    delay_flag: str = "IS_DELAYED"
    delay_days: str = "DAYS_SINCE_PLANNED_START"
    days_type: str = "int"
    extra: dict = field(default_factory=dict)


# The reference's cleaning rules for its two sheets.
SURVEY_MAIN_SPEC = CleanSpec(
    is_timestamp=lambda c: "WAKTU" in c,
    is_percent=lambda c: c.startswith("P_"),
    amounts=("NILAI_AFE_INVESTASI", "REALISASI_AFE_INVESTASI", "RR_TOTAL_P50_MMBOE",
             "RR_P50_OIL_MMBOE", "RR_P50_GAS_BSCF", "RENCANA_KUANTITAS_PEKERJAAN",
             "REALISASI_KUANTITAS_PEKERJAAN"),
    texts=("REGION_SKK", "PROVINSI", "HOLDING", "KKKS", "WK", "JENIS_KEGIATAN",
           "AREA_KEGIATAN", "STATUS_WK", "REALISASI_STATUS_PELAKSANAAN"),
    status="REALISASI_STATUS_PELAKSANAAN",
    planned_start="RENCANA_WAKTU_MULAI",
    not_started="Belum Mulai",
)

STUDY_MAIN_SPEC = CleanSpec(
    is_timestamp=lambda c: "WAKTU" in c or "TGL" in c,
    is_percent=None,
    amounts=("RENCANA_ANGGARAN_AFE_INVESTASI", "REALISASI_ANGGARAN_AFE_INVESTASI",
             "P_PROGRESS_PELAKSANAAN", "LUAS_WK_AWAL_KM2", "LUAS_WK_SAAT_INI_KM2"),
    texts=("KKKS", "HOLDING", "WK", "STATUS_WK", "TIPE_STUDI", "WILAYAH_SKK_MIGAS",
           "REALISASI_STATUS_PELAKSANAAN", "STATUS_USULAN_KEGIATAN", "TIPE_KONTRAK"),
)


def clean_sheet(df: DataFrame, spec: CleanSpec, as_of: str,
                null_token: str | None = NULL_TOKEN) -> DataFrame:
    """Apply C-01..C-09 to a landed sheet; returns a lazily cleaned DataFrame.

    * C-01/C-02 timestamp columns by name -> timestamp, bad values -> NULL
    * C-03 percent columns: only when already numeric; NULL/NaN -> 0, clamp [0, 100]
    * C-04/C-05 amount columns -> double, bad or missing -> 0
    * C-06/C-07 delay flag and elapsed days against ``as_of`` (UTC, C-08)
    * C-09 listed text columns trimmed, NULL -> ``null_token``

    ``null_token=None`` keeps SQL NULLs throughout: missing text, amounts and
    percentages stay NULL instead of becoming ``'nan'`` / 0 (the reference's
    behaviour, the default, makes unknown and zero indistinguishable).
    """
    fill = 0.0 if null_token is not None else None
    types = {f.name: f.dataType for f in df.schema.fields}
    out: dict[str, Column] = {}
    for name in df.columns:
        c = F.col(name)
        if spec.is_timestamp(name):
            c = coerce_timestamp(c, typed=isinstance(types[name], _TIME_TYPES))
        elif spec.is_percent is not None and spec.is_percent(name) and isinstance(types[name], NumericType):
            c = clamp_pct(c, fill)
        if name in spec.amounts:
            c = coerce_number(F.col(name), default=fill, numeric=isinstance(types[name], NumericType))
        if name in spec.texts:
            c = standardise_text(F.col(name), null_token)
        out[name] = c
    if spec.status is not None:
        has_planned = spec.planned_start in types
        if has_planned:
            planned = out[spec.planned_start]  # already coerced by C-01 when named so
            raw_status = F.col(spec.status)  # untrimmed, on purpose (C-06 before C-09)
            delayed = F.coalesce((raw_status == spec.not_started) & is_before(planned, as_of), F.lit(False))
            days = elapsed_days(planned, as_of).cast(spec.days_type)
        else:
            delayed, days = F.lit(False), F.lit(0).cast(spec.days_type)
        out[spec.delay_flag] = delayed
        out[spec.delay_days] = days
    return df.select(*[v.alias(k) for k, v in out.items()])


def with_load_quality(df: DataFrame, name: str = "load") -> tuple[DataFrame, Observation]:
    """C-11: row count observed while the cleaned data is written (no second scan).

    ``obs.get`` is readable after the first action on the returned DataFrame;
    the column count is ``len(df.columns)`` (plan-time).
    """
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def load_quality(df: DataFrame, table: str) -> DataFrame:
    """C-11 as a query: one row ``(table, rows, columns)``."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(table).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))

"""Column bindings and enumeration literals.

Operators are written against *roles* (``m.status``, ``m.resource_p50``), not
against physical names, so the same code runs on

* the reference's domain tables (Indonesian column names and values), and
* the star-schema adapter built from the driver's test tables.

A model is a frozen dataclass; ``m.c("status")`` returns the ``Column``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ActivityModel:
    """One row per field activity (survey)."""

    id: str
    name: str
    year: str
    work_area: str
    holding: str
    region: str
    kind: str
    block_status: str
    area: str
    status: str
    obstacle: str
    play: str
    technical_approval: str
    planned_amount: str
    realised_amount: str
    planned_qty: str
    realised_qty: str
    progress_pct: str
    resource_p50: str
    resource_oil: str
    resource_gas: str
    prospects: str
    leads: str
    permit_a_pct: str
    permit_b_pct: str
    procurement_pct: str
    planned_start: str
    is_delayed: str
    days_since_planned_start: str
    # enumeration literals
    not_started: str
    running_prefix: str
    done: str
    exploration: str
    onshore: str
    offshore: str
    kind_a: str
    kind_b: str
    kind_c: str
    approved: str

    def c(self, role: str) -> Column:
        return F.col(getattr(self, role))


@dataclass(frozen=True)
class StudyModel:
    """One row per study."""

    id: str
    name: str
    study_type: str
    holding: str
    work_area: str
    block_status: str
    proposal_status: str
    study_area: str
    validator: str
    planned_budget: str
    realised_budget: str
    area_km2: str
    status: str
    # enumeration literals
    not_started: str
    done: str
    exploration: str
    carry_over: str

    def c(self, role: str) -> Column:
        return F.col(getattr(self, role))


@dataclass(frozen=True)
class DetailModel:
    """Per-activity technical detail tables (receiver, shot point, recording)."""

    key: str
    receiver_cols: tuple[str, ...]
    shotpoint_cols: tuple[str, ...]
    recording_cols: tuple[str, ...]
    #: Technical parameters that the activity table itself has.
    survey_cols: tuple[str, ...] = ()


# ---------------------------------------------------------------------------
# The star-schema adapter (names produced by sources.adapter).
# ---------------------------------------------------------------------------
ADAPTER_ACTIVITY = ActivityModel(
    id="activity_id", name="activity_name", year="year", work_area="work_area",
    holding="holding", region="region", kind="kind", block_status="block_status",
    area="area", status="status", obstacle="obstacle", play="play",
    technical_approval="technical_approval", planned_amount="planned_amount",
    realised_amount="realised_amount", planned_qty="planned_qty",
    realised_qty="realised_qty", progress_pct="progress_pct",
    resource_p50="resource_p50", resource_oil="resource_oil",
    resource_gas="resource_gas", prospects="prospects", leads="leads",
    permit_a_pct="permit_a_pct", permit_b_pct="permit_b_pct",
    procurement_pct="procurement_pct", planned_start="planned_start",
    is_delayed="is_delayed", days_since_planned_start="days_since_planned_start",
    not_started="Not started", running_prefix="Running", done="Done",
    exploration="Exploration", onshore="Onshore", offshore="Offshore",
    kind_a="BUILDING", kind_b="MACHINERY", kind_c="FURNITURE", approved="Yes",
)

ADAPTER_STUDY = StudyModel(
    id="study_id", name="study_name", study_type="study_type", holding="holding",
    work_area="work_area", block_status="block_status",
    proposal_status="proposal_status", study_area="study_area",
    validator="validator", planned_budget="planned_budget",
    realised_budget="realised_budget", area_km2="area_km2", status="status",
    not_started="Not started", done="Done", exploration="Exploration",
    carry_over="Carry Over",
)

ADAPTER_DETAIL = DetailModel(
    key="activity_id",
    receiver_cols=("n_receiver", "receiver_spacing"),
    shotpoint_cols=("n_shot", "charge", "charge_depth"),
    recording_cols=("fold", "far_offset"),
    survey_cols=("planned_qty", "realised_qty", "resource_oil", "resource_gas", "prospects", "leads", "play"),
)

# ---------------------------------------------------------------------------
# The reference's own domain tables and enumerations.
# Column names and literals must equal the reference's for its data to load.
# ---------------------------------------------------------------------------
DOMAIN_ACTIVITY = ActivityModel(
    id="NAMA_KEGIATAN", name="NAMA_KEGIATAN", year="TAHUN", work_area="WK",
    holding="HOLDING", region="REGION_SKK", kind="JENIS_KEGIATAN",
    block_status="STATUS_WK", area="AREA_KEGIATAN",
    status="REALISASI_STATUS_PELAKSANAAN", obstacle="KENDALA_OPERASIONAL_LAPANGAN",
    play="PLAY", technical_approval="STATUS_PERSETUJUAN_TEKNIS",
    planned_amount="NILAI_AFE_INVESTASI", realised_amount="REALISASI_AFE_INVESTASI",
    planned_qty="RENCANA_KUANTITAS_PEKERJAAN",
    realised_qty="REALISASI_KUANTITAS_PEKERJAAN",
    progress_pct="P_REALISASI_KEGIATAN", resource_p50="RR_TOTAL_P50_MMBOE",
    resource_oil="RR_P50_OIL_MMBOE", resource_gas="RR_P50_GAS_BSCF",
    prospects="PROSPECT", leads="LEAD", permit_a_pct="P_IZIN_PPKH",
    permit_b_pct="P_IZIN_UKL_UPL", procurement_pct="P_PENGADAAN_KONTRAKTOR_SURVEI",
    planned_start="RENCANA_WAKTU_MULAI", is_delayed="IS_DELAYED",
    days_since_planned_start="DAYS_SINCE_PLANNED_START",
    not_started="Belum Mulai", running_prefix="Sedang", done="Selesai",
    exploration="EKSPLORASI", onshore="Onshore", offshore="Offshore",
    kind_a="Seismik 2D", kind_b="Seismik 3D", kind_c="Survey Lainnya",
    approved="Sudah",
)

DOMAIN_STUDY = StudyModel(
    id="NAMA_STUDI", name="NAMA_STUDI", study_type="TIPE_STUDI", holding="HOLDING",
    work_area="WK", block_status="STATUS_WK",
    proposal_status="STATUS_USULAN_KEGIATAN", study_area="WILAYAH_SKK_MIGAS",
    validator="VALIDATOR", planned_budget="RENCANA_ANGGARAN_AFE_INVESTASI",
    realised_budget="REALISASI_ANGGARAN_AFE_INVESTASI", area_km2="LUAS_WK_SAAT_INI_KM2",
    status="REALISASI_STATUS_PELAKSANAAN",
    not_started="Belum Mulai", done="Selesai", exploration="EKSPLORASI",
    carry_over="Carry Over",
)

DOMAIN_DETAIL = DetailModel(
    key="NAMA_KEGIATAN",
    receiver_cols=("jumlah_receiver", "jarak_antar_titik_receiver"),
    shotpoint_cols=("jumlah_SP", "besaran_charge", "depth_charge"),
    recording_cols=("fold_coverage", "max_far_offset"),
    survey_cols=("FULL_FOLD", "NEAR_OFFSET_M", "FAR_OFFSET_M", "SHOT_POINT_INTERVAL_M", "SAMPLING_RATE_MS", "RECORD_LENGTH_S", "JENIS_RECEIVER"),
)

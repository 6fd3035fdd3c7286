"""Star-schema adapter: driver test tables -> the reference's relations.

The reference works on five landed tables (activities, studies and three
per-activity technical-detail tables). The test data is a TPC-H-like star
schema; this module derives the same relations from it with DataFrame code:

* ``activity``  orders ⋈ customer ⋈ nation ⋈ region ⟕ (lineitem rolled up per order)
* ``study``     part
* ``receiver`` / ``shotpoint`` / ``recording``  lineitem slices by line number

Plan shape at scale: lineitem is partially aggregated map-side and shuffled
once on the order key; the left join with orders reuses that partitioning for
the aggregated side. customer joins orders by a sort-merge join (AQE may turn
it into a broadcast when the runtime size is small, and splits a skewed
customer key); nation and region are tiny dimension tables that Spark's
size-checked ``autoBroadcastJoinThreshold`` broadcasts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.functions.columns import elapsed_days, is_before
from fieldpulse.functions.parallel import spread
from fieldpulse.model import ADAPTER_ACTIVITY as A
from fieldpulse.sources.tables import RawTables

# Fixed value: the evaluation clock of the adapter (UTC). The reference uses
# the wall clock; a fixed instant keeps results reproducible.
DEFAULT_AS_OF = "1999-06-30 12:00:00"


def line_rollup(lineitem: DataFrame) -> DataFrame:
    """Per-order measures from lineitem (one row per order key)."""
    q = F.col("l_quantity")
    done = F.col("l_linestatus") == "F"
    return lineitem.groupBy("l_orderkey").agg(
        F.sum(q).alias("lr_total_qty"),
        F.sum(F.when(done, q).otherwise(F.lit(0.0))).alias("lr_done_qty"),
        F.sum(F.when(F.col("l_returnflag") == "A", q).otherwise(F.lit(0.0))).alias("lr_oil_qty"),
        F.sum(F.when(done, F.col("l_extendedprice") * (1 - F.col("l_discount")))
              .otherwise(F.lit(0.0))).alias("lr_done_amount"),
        F.count(F.lit(1)).alias("lr_lines"),
        F.count(F.when(F.col("l_returnflag") == "R", F.lit(1))).alias("lr_r_lines"),
    )


def build_activity(orders: DataFrame, customer: DataFrame, nation: DataFrame,
                   region: DataFrame, lineitem: DataFrame,
                   as_of: str = DEFAULT_AS_OF, spread_orders: bool = True) -> DataFrame:
    """orders ⋈ customer ⋈ nation ⋈ region ⟕ line roll-up, projected to the activity roles.

    ``spread_orders``: orders drives the wide projection and everything fused
    after it; when its scan has fewer splits than task slots it is spread
    round-robin first (a no-op on cluster-sized input). lineitem is not: its
    map-side partial aggregate is cheap and already shrinks it before the
    shuffle.
    """
    k = F.col("o_orderkey")
    lr = line_rollup(lineitem)
    base = ((spread(orders) if spread_orders else orders)
            .join(customer, orders.o_custkey == customer.c_custkey, "inner")
            .join(nation, F.col("c_nationkey") == nation.n_nationkey, "inner")
            .join(region, F.col("n_regionkey") == region.r_regionkey, "inner")
            .join(lr, k == lr.l_orderkey, "left"))
    total = F.col("lr_total_qty")
    return base.select(
        k.alias(A.id),
        F.concat(F.lit("ACT-"), k.cast("string")).alias(A.name),
        F.year("o_orderdate").alias(A.year),
        F.col("c_name").alias(A.work_area),
        F.col("n_name").alias(A.holding),
        F.col("r_name").alias(A.region),
        F.col("c_mktsegment").alias(A.kind),
        F.when(F.col("c_custkey") % 2 == 0, F.lit(A.exploration))
         .otherwise(F.lit("Exploitation")).alias(A.block_status),
        F.when(k % 3 == 0, F.lit(A.offshore)).when(k % 3 == 1, F.lit(A.onshore)).alias(A.area),
        F.when(F.col("o_orderstatus") == "O", F.lit(A.not_started))
         .when(F.col("o_orderstatus") == "P", F.lit("Running (partial)"))
         .otherwise(F.lit(A.done)).alias(A.status),
        F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, F.lit("  "))
         .when(k % 4 == 2, F.lit("nan"))
         .otherwise(F.concat(F.lit("Obstacle "), F.col("o_orderpriority"))).alias(A.obstacle),
        F.when(k % 7 == 0, F.lit("Carbonate build-up")).when(k % 7 == 1, F.lit("karbonat"))
         .otherwise(F.lit("Sandstone")).alias(A.play),
        F.when(k % 10 < 7, F.lit(A.approved)).otherwise(F.lit("No")).alias(A.technical_approval),
        F.col("o_totalprice").alias(A.planned_amount),
        F.coalesce(F.col("lr_done_amount"), F.lit(0.0)).alias(A.realised_amount),
        F.coalesce(total, F.lit(0.0)).alias(A.planned_qty),
        F.coalesce(F.col("lr_done_qty"), F.lit(0.0)).alias(A.realised_qty),
        F.when(total > 0, F.lit(100.0) * F.col("lr_done_qty") / total)
         .otherwise(F.lit(0.0)).alias(A.progress_pct),
        F.coalesce(total, F.lit(0.0)).alias(A.resource_p50),
        F.coalesce(F.col("lr_oil_qty"), F.lit(0.0)).alias(A.resource_oil),
        F.coalesce(total - F.col("lr_oil_qty"), F.lit(0.0)).alias(A.resource_gas),
        F.coalesce(F.col("lr_lines"), F.lit(0).cast("bigint")).alias(A.prospects),
        F.coalesce(F.col("lr_r_lines"), F.lit(0).cast("bigint")).alias(A.leads),
        F.when(k % 11 == 0, F.lit(0).cast("bigint"))
         .otherwise(F.least(F.lit(100).cast("bigint"), (k * 37) % 151)).alias(A.permit_a_pct),
        F.least(F.lit(100).cast("bigint"), (k * 53) % 251).alias(A.permit_b_pct),
        F.least(F.lit(100).cast("bigint"), (k * 71) % 401).alias(A.procurement_pct),
        F.col("o_orderdate").alias(A.planned_start),
        F.coalesce((F.col("o_orderstatus") == "O") & is_before("o_orderdate", as_of),
                   F.lit(False)).alias(A.is_delayed),
        elapsed_days("o_orderdate", as_of).alias(A.days_since_planned_start),
    )


def build_study(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(
        k.alias("study_id"),
        F.col("p_name").alias("study_name"),
        F.col("p_type").alias("study_type"),
        F.col("p_brand").alias("holding"),
        F.concat(F.lit("WA-"), (k % 40).cast("string")).alias("work_area"),
        F.when(k % 2 == 0, F.lit("Exploration")).otherwise(F.lit("Exploitation")).alias("block_status"),
        F.when(k % 5 == 0, F.lit("New")).when(k % 5 == 1, F.lit("Carry Over"))
         .when(k % 5 == 2, F.lit("Carry Forward")).when(k % 5 == 3, F.lit("Unbundling"))
         .otherwise(F.lit("Additional")).alias("proposal_status"),
        F.concat(F.lit("AREA-"), (k % 6).cast("string")).alias("study_area"),
        F.when(k % 9 == 0, F.lit(None).cast("string")).when(k % 9 == 1, F.lit(""))
         .when(k % 9 == 2, F.lit("nan"))
         .otherwise(F.concat(F.lit("V"), (k % 13).cast("string"))).alias("validator"),
        F.col("p_retailprice").alias("planned_budget"),
        F.lit(0.0).alias("realised_budget"),
        F.col("p_size").cast("double").alias("area_km2"),
        F.when(F.col("p_size") % 5 == 0, F.lit("Done")).otherwise(F.lit("Not started")).alias("status"),
    )


def build_receiver(lineitem: DataFrame) -> DataFrame:
    return lineitem.filter(F.col("l_linenumber") % 3 == 1).select(
        F.col("l_orderkey").alias("activity_id"),
        F.col("l_quantity").alias("n_receiver"),
        F.col("l_extendedprice").alias("receiver_spacing"))


def build_shotpoint(lineitem: DataFrame) -> DataFrame:
    return lineitem.filter(F.col("l_linenumber") % 3 == 2).select(
        F.col("l_orderkey").alias("activity_id"),
        F.col("l_quantity").alias("n_shot"),
        F.col("l_discount").alias("charge"),
        F.col("l_tax").alias("charge_depth"))


def build_recording(lineitem: DataFrame) -> DataFrame:
    return lineitem.filter(F.col("l_linenumber") % 3 == 0).select(
        F.col("l_orderkey").alias("activity_id"),
        F.col("l_quantity").alias("fold"),
        F.col("l_extendedprice").alias("far_offset"))


class Workspace:
    """The five relations of the reference, derived lazily from a test-data folder.

    ``Workspace.shared(spark, dir)`` returns one instance per session, folder
    and clock: the relations are lazy plans, so every query of a session can
    start from the same plan objects instead of re-resolving the sources and
    rebuilding the adapter's expressions (a constant cost per query that is
    larger than running a small query).
    """

    _shared: dict[tuple, "Workspace"] = {}

    RELATIONS = ("activity", "study", "receiver", "shotpoint", "recording")
    BUCKETED = ("activity", "receiver", "shotpoint", "recording")  # all keyed by activity_id

    def __init__(self, spark: SparkSession, base_dir: str, as_of: str = DEFAULT_AS_OF):
        self.spark = spark
        self.base_dir = base_dir
        self.as_of = as_of
        self.raw = RawTables(spark, base_dir)

    @classmethod
    def shared(cls, spark: SparkSession, base_dir: str, as_of: str = DEFAULT_AS_OF) -> "Workspace":
        key = (id(spark), spark.sparkContext.applicationId, base_dir, as_of)
        ws = cls._shared.get(key)
        if ws is None:
            ws = cls._shared[key] = cls(spark, base_dir, as_of)
        return ws

    @cached_property
    def activity(self) -> DataFrame:
        r = self.raw
        return build_activity(r.orders, r.customer, r.nation, r.region, r.lineitem, self.as_of)

    @cached_property
    def study(self) -> DataFrame:
        return build_study(self.raw.part)

    @cached_property
    def receiver(self) -> DataFrame:
        return build_receiver(self.raw.lineitem)

    @cached_property
    def shotpoint(self) -> DataFrame:
        return build_shotpoint(self.raw.lineitem)

    @cached_property
    def recording(self) -> DataFrame:
        return build_recording(self.raw.lineitem)

    def materialize(self, out_dir: str, buckets: int, prefix: str = "fp",
                    partition_activity_by: tuple[str, ...] = ()) -> "Workspace":
        """Write the five relations once (the silver layer) and return a Workspace over them.

        activity and its three detail tables are bucketed and sorted by
        ``activity_id`` into the same number of buckets, so joins between
        them (J-01/J-02) are planned without a shuffle. Each is first
        hash-partitioned on the bucket column into exactly ``buckets``
        partitions (the same hash the bucketing uses), so every task writes
        one file instead of one file per bucket (tasks x buckets small
        files). ``partition_activity_by`` (e.g. ``("year",)``) adds partition
        pruning for filters on those columns. The tables live under ``out_dir`` (shared storage), so the
        queries that follow read files and never recompute the adapter joins,
        also after an executor is lost.
        """
        silver = Workspace(self.spark, self.base_dir, self.as_of)
        for name in self.RELATIONS:
            df = getattr(self, name)
            table = f"{prefix}_{name}"
            bucketed = name in self.BUCKETED
            if bucketed:
                df = df.repartition(buckets, "activity_id")
            w = df.write.mode("overwrite").format("parquet").option("path", f"{out_dir.rstrip('/')}/{name}")
            if bucketed:
                w = w.bucketBy(buckets, "activity_id").sortBy("activity_id")
            if name == "activity" and partition_activity_by:
                w = w.partitionBy(*partition_activity_by)
            w.saveAsTable(table)
            silver.__dict__[name] = self.spark.table(table)
        return silver

    def register_views(self) -> None:
        """Expose the relations to ``spark.sql`` under the adapter names."""
        for name in ("activity", "study", "receiver", "shotpoint", "recording"):
            getattr(self, name).createOrReplaceTempView(name)

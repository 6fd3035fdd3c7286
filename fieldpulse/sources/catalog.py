"""Catalog introspection (S-10, S-11, S-12).

Row counts are aggregates over the tables themselves (one ``count`` each,
unioned), so they run as distributed jobs and answer from parquet metadata
where Spark can. The column listing comes from the session catalog.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_row_counts(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """S-11: ``(table, rows)`` per table; a missing table (``None``) counts 0."""
    parts = []
    for name, df in tables.items():
        if df is None:
            parts.append(spark.range(1).select(F.lit(name).alias("table"), F.lit(0).cast("long").alias("rows")))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def views_or_none(spark: SparkSession, names: list[str]) -> dict[str, DataFrame | None]:
    """Resolve names in the catalog; unknown names map to ``None`` (health-check style)."""
    return {n: (spark.table(n) if spark.catalog.tableExists(n) else None) for n in names}


def ingest_summary(counts: DataFrame, reference_like: bool = False) -> DataFrame:
    """S-12: counts of the non-internal tables.

    The reference filters with ``NOT LIKE '_%'``, where ``_`` is a one-character
    wildcard, so every table is excluded and its summary is always empty.
    ``reference_like=True`` keeps that behaviour; the default is the intended
    one (names not starting with an underscore).
    """
    cond = ~F.col("table").like("_%") if reference_like else ~F.col("table").startswith("_")
    return counts.filter(cond)


def schema_listing(spark: SparkSession, names: list[str]) -> DataFrame:
    """S-10: ``(table, column, data_type, ordinal)`` for registered tables/views."""
    rows = []
    for t in names:
        for i, c in enumerate(spark.catalog.listColumns(t)):
            rows.append((t, c.name, c.dataType, i + 1))
    return spark.createDataFrame(rows, "table string, column string, data_type string, ordinal int")


def schema_text(listing: DataFrame) -> DataFrame:
    """S-10 text form: ``TABLE t:\\n  - col (type)`` blocks, one row per table."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column", "data_type"))),
                        lambda x: F.concat(F.lit("  - "), x["column"], F.lit(" ("), x["data_type"], F.lit(")")))
    return listing.groupBy("table").agg(
        F.concat(F.lit("TABLE "), F.col("table"), F.lit(":\n"), F.concat_ws("\n", lines)).alias("text"))

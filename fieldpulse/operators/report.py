"""Result reports and text merges (T-08..T-12).

Reports take a (lazy) result DataFrame and return a one-row DataFrame holding
the text; nothing is collected to the driver. Lists are cut by
``orderBy().limit(n)`` (bounded per partition) before any ``collect_list``.
Column labels and per-type formatting are decided at plan time from the
result schema, as the reference decides them from Python value types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, IntegralType, BooleanType

from fieldpulse.functions.columns import strip_ws
from fieldpulse.functions.parallel import spread

# Report texts (English renderings of the reference's texts)
# and caps that are part of the report format.
SIMPLE_MAX_COLUMNS = 3
LIST_ROWS = 10
LIST_PAIRS = 5
DIGEST_ROWS = 20
TEXT_NO_DATA = "No data matches your question."
TEXT_DIGEST_EMPTY = "(No rows match the query)"
PAGE_PIECE_CHARS = 3000
PAGE_TOTAL_CHARS = 5000


def label(name: str) -> str:
    """Column name as a label: ``_`` -> space, then Python title case."""
    return name.replace("_", " ").title()


def py_str_double(x: Column) -> Column:
    """Render a double like Python ``str(float)``.

    Plain notation for 1e-4 <= |x| < 1e16 (the shortest digits, ``.0`` for
    whole numbers, via an exact decimal); outside that range Python's
    scientific form (``1e+16``, ``9.99e-05``) rebuilt from Java's
    (``1.0E16``, ``9.99E-5``); signed zero kept.
    """
    ax = F.abs(x)
    plain = F.regexp_replace(x.cast("decimal(38,21)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    js = x.cast("string")  # Java's Double.toString
    mant = F.regexp_replace(F.regexp_extract(js, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    sign = F.when(F.regexp_extract(js, r"E(-?)", 1) == "-", F.lit("-")).otherwise(F.lit("+"))
    exp = F.regexp_extract(js, r"E-?([0-9]+)$", 1)
    sci = F.concat(mant, F.lit("e"), sign, F.when(F.length(exp) < 2, F.lpad(exp, 2, "0")).otherwise(exp))
    return (F.when(x.isNull(), F.lit("None")).when(F.isnan(x), F.lit("nan"))
            .when(x == F.lit(float("inf")), F.lit("inf")).when(x == F.lit(float("-inf")), F.lit("-inf"))
            .when(x == 0, js)
            .when((ax < 1e16) & (ax >= 1e-4), plain)
            .when(js.contains("E"), sci)
            .otherwise(js))


def py_str(c: Column, dtype) -> Column:
    """Python ``str(value)`` of a result cell, by Spark type."""
    if isinstance(dtype, (DoubleType, FloatType)):
        return py_str_double(c.cast("double"))
    if isinstance(dtype, BooleanType):
        return F.when(c.isNull(), F.lit("None")).when(c, F.lit("True")).otherwise(F.lit("False"))
    return F.coalesce(c.cast("string"), F.lit("None"))


def format_cell(c: Column, dtype) -> Column:
    """T-08 value formatting: money / one decimal / percent for floats, separators for ints."""
    if isinstance(dtype, (DoubleType, FloatType)):
        x = c.cast("double")
        return (F.when(x.isNull(), F.lit("None"))
                .when(F.isnan(x), F.lit("nan%"))  # NaN is the greatest value in Spark
                .when(F.abs(x) > 1_000_000, F.concat(F.lit("$"), F.format_number(x, 0)))
                .when(F.abs(x) > 100, F.format_number(x, 1))
                # |x| <= 100 here, so format_number adds no separator; it rounds
                # half-even like Python's format (Java's %.1f would round up).
                .otherwise(F.concat(F.format_number(x, 1), F.lit("%"))))
    if isinstance(dtype, (IntegralType, BooleanType)):
        v = c.cast("long")
        return F.when(v.isNull(), F.lit("None")).otherwise(F.format_number(v, 0))
    if isinstance(dtype, DecimalType):
        return F.coalesce(c.cast("string"), F.lit("None"))
    return py_str(c, dtype)


def simple_result(df: DataFrame) -> DataFrame:
    """T-08: a one-row, at most three-column result as ``**Label**: value`` lines.

    Callers use it only when the result has one row (the reference's rule);
    for more rows it renders each row, in no particular order.
    """
    fields = df.schema.fields
    if len(fields) > SIMPLE_MAX_COLUMNS:
        raise ValueError(f"simple_result takes at most {SIMPLE_MAX_COLUMNS} columns")
    lines = [F.concat(F.lit(f"**{label(f.name)}**: "), format_cell(F.col(f.name), f.dataType)) for f in fields]
    return df.select(F.concat_ws("\n", *lines).alias("answer"))


def _row_pairs(df: DataFrame) -> Column:
    """Up to five ``key: value`` pairs of cells that are not NULL, not blank and not ``nan``, in column order."""
    pairs = F.array(*[
        F.struct(py_str(F.col(f.name), f.dataType).alias("v"), F.lit(f.name).alias("k"),
                 F.col(f.name).isNotNull().alias("present"))
        for f in df.schema.fields])
    kept = F.filter(pairs, lambda p: p["present"] & (strip_ws(p["v"]) != "") & (p["v"] != "nan"))
    return F.concat_ws(" | ", F.transform(F.slice(kept, 1, LIST_PAIRS),
                                          lambda p: F.concat(p["k"], F.lit(": "), p["v"])))


def list_report(df: DataFrame, order_by: list[Column]) -> DataFrame:
    """T-09: header with the row count, the first ten rows (five pairs each), "... n more".

    The ten rows come from ``orderBy(order_by).limit(10)``; the count and the
    rows are folded by one aggregate over at most eleven rows (no join).
    """
    top = df.orderBy(*order_by).limit(LIST_ROWS)
    w = Window.orderBy(*order_by)
    lines = top.select(F.row_number().over(w).alias("i"), _row_pairs(df).alias("t"),
                       F.lit(None).cast("long").alias("n"))
    count = df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(0).alias("i"), F.lit(None).cast("string").alias("t"), "n")
    u = lines.unionByName(count)
    n = F.max("n")
    body = F.concat_ws("", F.transform(
        F.sort_array(F.collect_list(F.when(F.col("i") > 0, F.struct("i", "t")))),
        lambda x: F.concat(x["i"].cast("string"), F.lit(". "), x["t"], F.lit("\n"))))
    more = F.when(n > LIST_ROWS, F.concat(F.lit("\n... and "), (n - LIST_ROWS).cast("string"),
                                          F.lit(" more results."))).otherwise(F.lit(""))
    text = F.when(n == 0, F.lit(TEXT_NO_DATA)).otherwise(
        F.concat(F.lit("Found "), n.cast("string"), F.lit(" results:\n\n"), body, more))
    return u.agg(text.alias("report"))


def result_digest(df: DataFrame, order_by: list[Column], rows: int = DIGEST_ROWS) -> DataFrame:
    """T-10: the first ``rows`` rows as a JSON array plus the number of rows left out."""
    top = df.orderBy(*order_by).limit(rows)
    w = Window.orderBy(*order_by)
    j = top.select(F.row_number().over(w).alias("i"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"),
                   F.lit(None).cast("long").alias("n"))
    count = df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(0).alias("i"), F.lit(None).cast("string").alias("j"), "n")
    n = F.max("n")
    arr = F.transform(F.sort_array(F.collect_list(F.when(F.col("i") > 0, F.struct("i", "j")))),
                      lambda x: x["j"])
    data = F.concat(F.lit("["), F.concat_ws(",", arr), F.lit("]"))
    text = F.when(n == 0, F.lit(TEXT_DIGEST_EMPTY)).otherwise(
        F.concat(data, F.when(n > rows, F.concat(F.lit("\n... and "), (n - rows).cast("string"),
                                                 F.lit(" more rows"))).otherwise(F.lit(""))))
    return j.unionByName(count).agg(n.alias("row_count"), text.alias("digest"))


# --------------------------------------------------------------------- T-11
def html_text(html: Column) -> Column:
    """Visible text of an HTML page: body only, no script/style, tags dropped, entities decoded."""
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)
    x = F.when(body == "", html).otherwise(body)
    x = F.regexp_replace(x, r"(?is)<script[^>]*>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
                    ("&amp;", "&")):
        x = F.replace(x, F.lit(ent), F.lit(ch))
    x = F.regexp_replace(x, r"[ \t\n\r\f]+", " ")
    return F.trim(x)


def page_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)


def merge_page_text(pages: DataFrame, group_col: Column, order_col: str, title_col: Column,
                    text_col: Column, piece_chars: int = PAGE_PIECE_CHARS,
                    total_chars: int = PAGE_TOTAL_CHARS) -> DataFrame:
    """T-11: per group, ``\\n\\n--- title ---\\n`` + text[:piece] per page, joined, cut to ``total``.

    Only the leading pages can reach the output: each piece is at least as
    long as its header, so at most ``total // min_header + 1`` pieces fit.
    Those are picked with ``row_number() <= k`` (a map-side group limit in the
    plan) before the per-group collect, which is therefore bounded however
    many pages one group holds.
    """
    header_min = len("\n\n---  ---\n")
    k = total_chars // header_min + 1
    piece = F.concat(F.lit("\n\n--- "), title_col, F.lit(" ---\n"), F.substring(text_col, 1, piece_chars))
    w = Window.partitionBy("g").orderBy(order_col)
    ranked = (spread(pages).select(group_col.alias("g"), F.col(order_col), piece.alias("piece"))
              .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k))
    merged = ranked.groupBy("g").agg(
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("rn", "piece"))),
                                    lambda x: x["piece"])).alias("t"),
        F.count(F.lit(1)).alias("pieces"))
    return merged.select(F.col("g").alias("group"), F.substring("t", 1, total_chars).alias("text"),
                         F.length(F.substring("t", 1, total_chars)).alias("n_chars"))


# --------------------------------------------------------------------- T-12
def request_metrics(log: DataFrame, route: Column, elapsed: Column, rows: Column,
                    failed: Column) -> DataFrame:
    """T-12: per route: requests, mean/max elapsed seconds (2 decimals), mean rows, error rate %."""
    return (log.select(route.alias("route"), elapsed.alias("elapsed"), rows.alias("rows"),
                       failed.alias("failed"))
            .groupBy("route").agg(
                F.count(F.lit(1)).alias("requests"),
                F.round(F.avg("elapsed"), 2).alias("avg_elapsed_s"),
                F.round(F.max("elapsed"), 2).alias("max_elapsed_s"),
                F.round(F.avg("rows"), 2).alias("avg_rows"),
                F.round(F.avg(F.col("failed").cast("double")) * 100, 2).alias("error_rate_pct")))

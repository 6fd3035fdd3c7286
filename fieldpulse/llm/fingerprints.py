"""Document fingerprints: threshold-scaled sketches (op 5), DataFrame functions only.

The sketch of a text keeps every hash of its five-word shingles that lies below
a fixed fraction of the hash range. Its size follows the text's, so sketches of
very unequal texts can be compared (containment), and the sketch of a union is
the union of the sketches (``merge``).

The fingerprint is the ascending retained hashes in hexadecimal, joined by dots.
A text with words of which no hash is retained gets ``~`` and its least hash
instead, so that equal texts have equal fingerprints and short different texts
do not look alike. A text without words has the empty fingerprint.

The next document in ascending doc_id order is found without one global sort:
doc_ids are cut into ranges at their approximate quantiles, ``lead`` works
inside a range, and the last row of a range takes the first row of the next
range from a table with one row a range.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.llm.common import shingle_hashes, shuffle_parts, words_of

#: One in 2**SCALE_BITS hashes is retained: half of them, so that texts of a few dozen words have sketches that tell degrees.
SCALE_BITS = 1


def _hashes(words: Column) -> Column:
    """Shingle hashes; fewer than five words make one shingle, none make none."""
    return F.when(F.size(words) >= 5, shingle_hashes(words)).when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(
        F.array(F.xxhash64(F.lit("short"), F.concat_ws(" ", words))))


def with_sketch(df: DataFrame, text: str, out: str, scale_bits: int = SCALE_BITS) -> DataFrame:
    """Add ``out``: struct(kept: ascending retained hashes, least: least hash where none is retained)."""
    df = df.withColumn("_w", words_of(F.coalesce(F.col(text), F.lit(""))))
    # xxhash64 is signed: the lowest fraction of the unsigned range is 0 <= h < 2**(64 - bits), for one bit or more
    last = (1 << (64 - scale_bits)) - 1
    df = df.withColumn("_h", _hashes(F.col("_w")))
    kept = F.array_sort(F.array_distinct(F.filter("_h", lambda h: (h >= 0) & (h <= F.lit(last)))))
    df = df.withColumn("_k", kept)
    return df.withColumn(out, F.struct(F.col("_k").alias("kept"), F.when(F.size("_k") == 0, F.array_min("_h")).alias("least"))).drop("_w", "_h", "_k")


def fingerprint(sketch: Column) -> Column:
    return F.when(sketch["least"].isNotNull(), F.concat(F.lit("~"), F.lower(F.hex(sketch["least"])))).otherwise(
        F.concat_ws(".", F.transform(sketch["kept"], lambda h: F.lower(F.hex(h)))))


def merge(a: Column, b: Column) -> Column:
    """Retained hashes of the union of two texts' shingles."""
    return F.array_sort(F.array_union(a["kept"], b["kept"]))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; without retained hashes on both sides, 1 for equal fingerprints and else 0."""
    both = F.size(F.array_intersect(a["kept"], b["kept"]))
    union = F.size(a["kept"]) + F.size(b["kept"]) - both
    return F.when(union > 0, both / union).when(a["least"].eqNullSafe(b["least"]), 1.0).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; null when no hash of a is retained."""
    return F.when(F.size(a["kept"]) > 0, F.size(F.array_intersect(a["kept"], b["kept"])) / F.size(a["kept"]))


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """Add ``_range``: ascending ranges of doc_id with about equally many rows; null ids come last."""
    wanted = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double").alias("_id")).approxQuantile("_id", wanted, 0.25 / ranges))) if wanted else []
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_id", outputCol="_r", handleInvalid="keep")
    out = cut.transform(docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan")))))
    return out.withColumn("_range", F.col("_r").cast("int")).drop("_id", "_r")


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows (doc_id, _text, _next: text of the next row; after the last row, the first).

    Order: doc_id ascending, null ids last, equal ids by text. Only texts are
    shuffled: a sketch is made again from the next row's text.
    """
    spark = docs.sparkSession
    ranges = ranges or 8 * shuffle_parts(spark)
    rows = in_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")), ranges)
    # the first row of each range: by its id first, so that texts are neither sorted nor aggregated
    ids = rows.groupBy("_range").agg(F.min("doc_id").alias("_id"))
    # (at most ``ranges`` + 1 rows of two numbers: broadcast, so that the texts stay where they are)
    first = (rows.join(F.broadcast(ids.withColumnRenamed("_range", "_of")), (F.col("_range") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")))
             .groupBy("_range").agg(F.min("_text").alias("_start")))
    present = sorted(r[0] for r in ids.select("_range").collect())  # a row a range
    if not present:
        return rows.withColumn("_next", F.col("_text")).drop("_range")
    follows = spark.createDataFrame(list(zip(present, present[1:] + present[:1])), "_range int, _then int")
    starts = follows.join(first.withColumnRenamed("_range", "_then"), "_then").drop("_then")
    order = Window.partitionBy("_range").orderBy(F.col("doc_id").asc_nulls_last(), "_text")
    rows = rows.withColumn("_lead", F.lead("_text").over(order))
    return rows.join(starts, "_range", "left").withColumn("_next", F.coalesce("_lead", "_start")).drop("_lead", "_start", "_range")


def compare_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the next document. Null texts count as empty. An
    empty table gives no rows; a single row is its own next; repeated rows each
    get a row.
    """
    rows = with_next(docs, ranges)
    n = F.length("_text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring("_text", F.lit(1), n - quarter), F.substring("_next", F.lit(1), quarter)))
    for text, out in (("_text", "_sketch"), ("_edited", "_after"), ("_next", "_beside")):
        rows = with_sketch(rows, text, out)
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("_sketch")).alias("fingerprint"), fingerprint(F.col("_after")).alias("edited_fingerprint"),
        likeness(F.col("_sketch"), F.col("_after")).alias("near_edited"),
        likeness(F.col("_sketch"), F.col("_beside")).alias("near_next"))

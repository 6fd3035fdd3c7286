"""Conflict-constrained best-fit packing of documents into bins (op 8).

A bin holds at most ``capacity`` tokens (words plus one end token a document)
and no two documents of one source or of one duplicate cluster. A document
longer than a bin is cut into whole bins, which it fills alone, and a rest that
is packed like any document; its pieces keep the document's bin order.

Documents are dealt into packing groups by a hash of their content and id, so a
group has about ``GROUP_ITEMS`` of them whatever the source or cluster sizes
are. A group is packed in one pass, longest items first: the open bins are kept
ordered by residual capacity and carry bitmaps of their sources and clusters.
The search starts at the successor of the item's size and goes on until it
meets a bin whose bitmaps admit the item; that is the tightest compatible bin.
If there is none, a new bin is opened. Bins are numbered without gaps by a sum
over the groups' bin counts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.llm.common import words_of, written

CAPACITY = 2048
GROUP_ITEMS = 2000
PLACED = "grp long, doc_id long, piece int, first_token long, n_tokens long, bin long"


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[int]:
    """Bin of each item (size, source, cluster), at most ``capacity`` long, in the given order.

    A null source or cluster conflicts with nothing.
    """
    bit: dict[tuple[int, object], int] = {}
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending: equal residuals by age
    sources, clusters, out = [], [], []
    for size, source, cluster in items:
        s = 0 if source is None else 1 << bit.setdefault((0, source), len(bit))
        c = 0 if cluster is None else 1 << bit.setdefault((1, cluster), len(bit))
        i = bisect_left(open_bins, (size, -1))
        while i < len(open_bins) and (sources[open_bins[i][1]] & s or clusters[open_bins[i][1]] & c):
            i += 1
        if i < len(open_bins):
            left, chosen = open_bins.pop(i)
        else:
            left, chosen = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[chosen] |= s
        clusters[chosen] |= c
        if left > size:
            insort(open_bins, (left - size, chosen))
        out.append(chosen)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, cluster: str | None = None) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, bin for every piece of every document.

    ``cluster`` names a column with the duplicate cluster; without it documents
    of equal text make a cluster. Null texts count as empty (the end token
    only); null sources conflict with nothing. Repeated rows are packed one by
    one. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.size(words_of(text)) + 1).cast("long").alias("size"), F.col("source").cast("string").alias("src"),
        (F.col(cluster).cast("string") if cluster else F.when(text != "", F.md5(text.cast("binary")))).alias("cluster"))
    n = rows.count()
    groups = max(1, -(-n // group_items))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "size", "src", "cluster"), F.lit(groups)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "doc_id", "src", "cluster"], ascending=[False, True, True, True], kind="stable", na_position="last")
        columns = [part["doc_id"].astype("Int64").tolist(), part["size"].tolist(), part["src"].tolist(), part["cluster"].tolist()]
        docs = [(None if d is pd.NA else d, size, s if isinstance(s, str) else None, c if isinstance(c, str) else None) for d, size, s, c in zip(*columns)]
        rest = [(size % capacity, s, c) for _, size, s, c in docs]
        # rests in descending order; what fills whole bins comes after the shared bins
        order = sorted((i for i, r in enumerate(rest) if r[0]), key=lambda i: -rest[i][0])
        bins = dict(zip(order, best_fit([rest[i] for i in order], capacity)))
        own = 1 + max(bins.values(), default=-1)
        out = []
        for i, (doc, size, _, _) in enumerate(docs):
            whole = size // capacity
            for k in range(whole):
                out.append((doc, k, k * capacity, capacity, own))
                own += 1
            if i in bins:
                out.append((doc, whole, whole * capacity, rest[i][0], bins[i]))
        frame = pd.DataFrame(out, columns=["doc_id", "piece", "first_token", "n_tokens", "bin"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        frame.insert(0, "grp", int(part["grp"].iloc[0]))
        return frame

    placed = written(rows.groupBy("grp").applyInPandas(run, PLACED), "packing")
    return numbered(placed)


def numbered(placed: DataFrame) -> DataFrame:
    """Bins of all groups numbered from 0 without gaps: sums over blocks of groups, then inside each block."""
    counts = placed.groupBy("grp").agg((F.max("bin") + 1).alias("n")).withColumn("block", F.floor(F.col("grp") / 1000))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    before = blocks.select(F.col("block").alias("_b"), (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("grp")) - F.col("n")
    offsets = counts.withColumn("inside", inside).join(before, F.col("block") == F.col("_b")).select(F.col("grp").alias("_g"), (F.col("before") + F.col("inside")).alias("offset"))
    return placed.join(offsets, F.col("grp") == F.col("_g")).select("doc_id", "piece", "first_token", "n_tokens", (F.col("offset") + F.col("bin")).alias("bin"))

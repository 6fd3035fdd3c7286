"""Centroid clustering by a progressive search over Walsh-Hadamard coefficients (op 12).

Vectors of integers are kept as their Walsh-Hadamard coefficients, in ascending
sequency (coarse to fine). The transform H is exact in integers and H * H is 64
times the identity, so squared distances of coefficients are 64 times those of
the vectors, and sums over a cluster may be taken of coefficients.

For every vector the squared differences to all centroids are accumulated stage by
stage. After the coarsest stages the centroid that is least so far is finished,
which gives a bound. From then on a centroid whose sum is strictly above the bound
is left out, as sums only grow; what stays to the end has all 64 coefficients.

Each round is one pass over the written coefficients: a task adds up count and
coefficients by cluster, Spark adds up the tasks' sums, and the driver gets
``CLUSTERS`` x 64 sums, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.common import discard, written

SIZE, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Ends of the stages, coarse to fine, and the stage after which the bound is made.
STAGES, BOUND_AFTER = (4, 8, 16, 32, 64), 2
#: Integers from here on are left out: their coefficients would not fit in a long.
TOO_LARGE = 2.0**56
#: Up to these coefficients (integers up to 2 ** 24) squared differences add up in 64 bits; larger ones use Python's integers.
PLAIN = 1 << 30
#: Vectors that are assigned at once.
BATCH = 1 << 14


@lru_cache(maxsize=1)
def _sequency() -> np.ndarray:
    """Places of the transform's rows by their number of sign changes."""
    i = np.arange(SIZE)
    signs = np.array([[bin(a & b).count("1") & 1 for b in i] for a in i])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1))


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients, not normalised, of the rows of ``x`` (integers or Python integers), coarse to fine."""
    step = 1
    while step < SIZE:
        pairs = x.reshape(len(x), -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), SIZE)
        step *= 2
    return x[:, _sequency()]


def inverse(c: np.ndarray) -> np.ndarray:
    """The rows whose coefficients these are."""
    natural = np.empty_like(c)
    natural[:, _sequency()] = c
    # without the order the transform is its own inverse, times SIZE
    out = np.empty_like(c)
    out[:, _sequency()] = transform(natural)
    return out // SIZE


def nearest(coefs: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of every row of coefficients; ties go to the smaller number."""
    if coefs.dtype != object and max(np.abs(coefs).max(initial=0), np.abs(centroids).max(initial=0)) > PLAIN:
        coefs = coefs.astype(object)
    if coefs.dtype == object:
        centroids = centroids.astype(object)
    total = np.zeros((len(coefs), len(centroids)), coefs.dtype)
    row, centroid = (x.reshape(-1) for x in np.indices(total.shape))
    begin, bound = 0, None
    for stage, end in enumerate(STAGES):
        off = coefs[row, begin:end] - centroids[centroid, begin:end]
        total[row, centroid] += (off * off).sum(axis=1)
        if stage + 1 == BOUND_AFTER:
            lead = total.argmin(axis=1)
            rest = coefs[:, end:] - centroids[lead, end:]
            bound = total[np.arange(len(coefs)), lead] + (rest * rest).sum(axis=1)
        if bound is not None:
            stays = total[row, centroid] <= bound[row]
            row, centroid = row[stays], centroid[stays]
        begin = end
    # the bound's centroid is finished as well: at least one stays
    reached = np.zeros(total.shape, bool)
    reached[row, centroid] = True
    worst = total.max(initial=0) + 1
    best = np.where(reached, total, worst).argmin(axis=1)
    return best, total[np.arange(len(coefs)), best] // SIZE


def coefficients(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, coefs) of the rows that are kept."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            whole = np.floor(np.stack(part["vector"].to_numpy()) * SCALE).astype(np.int64)
            yield pd.DataFrame({"vec_id": part["vec_id"], "coefs": list(transform(whole))})

    v = F.col("vector")
    sound = (F.size(v) == SIZE) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < TOO_LARGE))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & sound).mapInPandas(run, "vec_id long, coefs array<bigint>")


def _batches(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for part in parts:
        for k in range(0, len(part), BATCH):
            yield part[k:k + BATCH], np.stack(part["coefs"].to_numpy()[k:k + BATCH])


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floored means of their vectors, or as they were where they have none."""
    known = transform(centroids)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many, sums = np.zeros(len(known), np.int64), np.zeros((len(known), SIZE), object)
        for _, coefs in _batches(parts):
            at, _ = nearest(coefs, known)
            wide = coefs if np.abs(coefs).max(initial=0) <= PLAIN else coefs.astype(object)
            for c in np.unique(at):
                sums[c] += wide[at == c].sum(axis=0)
                many[c] += (at == c).sum()
        used = np.flatnonzero(many)
        yield pd.DataFrame({"cluster": used, "many": many[used], "sums": [[str(x) for x in sums[c]] for c in used]})

    # a task's sums are below 2 ** 62 x its rows: decimals hold them
    tasks = vectors.mapInPandas(run, "cluster int, many long, sums array<string>").select("cluster", "many", F.col("sums").cast("array<decimal(38,0)>").alias("sums"))
    total = tasks.groupBy("cluster").agg(F.sum("many").alias("many"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(SIZE)]).collect()
    out = centroids.copy()
    for row in total:
        sums = inverse(np.array([[int(row[f"s{i}"]) for i in range(SIZE)]], object))[0]
        out[row["cluster"]] = [s // row["many"] for s in sums]
    return out


def cluster(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Kept are vectors with 64 components, none null or non-finite, and an id; a
    component counts as floor(1024 * x). Repeated rows and ids are vectors of their own
    (of equal first hashes the one with the least coefficients comes first). Vectors
    with an integer of 2 ** 56 or more take no part. With fewer than eight vectors each
    starts a cluster; an empty table gives no rows. A distance or inertia beyond a long is null.
    """
    vectors = written(coefficients(rows, vec_id, vector), "coefficients")
    first = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    begin = vectors.select(first.alias("hash"), "coefs").orderBy("hash", "coefs").limit(CLUSTERS).collect()
    if not begin:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(x) for x in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    centroids = inverse(np.array([r["coefs"] for r in begin], np.int64).astype(object))
    small = lambda c: c.astype(np.int64) if max(abs(x) for x in c.flat) < 2**56 else c
    centroids = small(centroids)
    for _ in range(ROUNDS):
        centroids = small(moved(vectors, centroids))
    known = transform(centroids)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, coefs in _batches(parts):
            at, distance = nearest(coefs, known)
            yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": at.astype(np.int32), "distance": [str(d) for d in distance]})

    far = F.col("distance").cast("decimal(38,0)")
    found = written(vectors.mapInPandas(run, "vec_id long, cluster int, distance string").withColumn("distance", far), "clusters")
    discard(vectors)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = lambda x: F.lit(x if x < 2**63 else None).cast("long")
    by_cluster = lambda value: F.element_at(F.array(*[value(c) for c in range(len(centroids))]), F.col("cluster") + 1)
    digest = lambda c: F.lit(hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
    return found.select("vec_id", "cluster", F.expr("try_cast(distance AS bigint)").alias("distance"), by_cluster(lambda c: whole(sums.get(c, 0))).alias("cluster_inertia"),
                        whole(sum(sums.values())).alias("inertia"), by_cluster(digest).alias("centroid_sha256"))


def _sql() -> str:
    """The same clustering as DuckDB SQL, a pair of steps for each round."""
    nearest_sql = """SELECT vec_id, x, d.n AS cluster, d.d AS distance FROM (
  SELECT v.vec_id, v.x, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'n': c.n}}) AS d
  FROM kept v CROSS JOIN c{0} c GROUP BY v.vec_id, v.x)"""
    steps = [f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
             f"""c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS n, x FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM kept ORDER BY h LIMIT {CLUSTERS}))"""]
    for i in range(ROUNDS):
        steps.append(f"a{i} AS MATERIALIZED ({nearest_sql.format(i)})")
        steps.append(f"""m{i} AS MATERIALIZED (
  SELECT n, list(m ORDER BY i) AS x FROM (
    SELECT cluster AS n, i, ((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM (SELECT cluster, unnest(x) AS e, unnest(range({SIZE})) AS i FROM a{i}) GROUP BY cluster, i) GROUP BY n)""")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON c.n = m.n)")
    steps.append(f"last AS MATERIALIZED ({nearest_sql.format(ROUNDS)})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT l.vec_id, l.cluster, l.distance, (sum(l.distance) OVER (PARTITION BY l.cluster))::BIGINT AS cluster_inertia,
  (sum(l.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM last l JOIN c{ROUNDS} c ON l.cluster = c.n"""


SQL = _sql()

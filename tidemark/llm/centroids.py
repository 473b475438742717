"""Centroid clustering of whole-number vectors (operator 12).

Distances of a block of vectors to all centroids come from one float64 matrix product, |x|^2 - 2 x.c + |c|^2. That is exact
while no number on the way reaches 2^53, which the largest components bound; vectors beyond the bound are compared in int64,
and beyond its bound with Python's integers. Sums of each round are added up within tasks and in a tree of tasks, so each
round brings k sums to the driver, whatever the number of vectors.

Defined results: a vector that is null, has another number of components or one that is null or not finite is left out (as is
a float64 one whose scaled components are not finite); a null vec_id is hashed as empty text and comes back null; rows that
repeat a vec_id are vectors each of their own (of equal hashes the lesser vector comes first); with fewer than k vectors
there are as many centroids; none: no rows; equal vectors, equal results; other columns are ignored, whatever their names;
a distance or inertia beyond 64 bits is null."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, written
from .whole_vectors import FLOAT_SAFE, INT_SAFE, as_long, exact, narrowed, packed_blocks, scaled, sums_by, tree_sum, usable


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of each vector to each centroid by one matrix product; both small enough (see `nearest`)."""
    x, c = x.astype(float), c.astype(float)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centroids (Python's integers) to each vector, the first of equals, and the squared distance, exactly."""
    size = np.abs(x).max(axis=1, initial=0).astype(float)
    most = max((abs(v) for v in centroids.ravel().tolist()), default=0)
    bound = x.shape[1] * (size + float(most)) ** 2 if most < 1 << 500 else np.full(len(x), np.inf)
    to, far = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    level = np.where(bound < FLOAT_SAFE, 0, np.where((bound < INT_SAFE) & (x.dtype.kind == "i"), 1, 2))
    for how in np.unique(level).tolist():
        at = np.flatnonzero(level == how)
        if how == 0:
            d = squared_distances(x[at], centroids)
        else:
            rows, c = (x[at].astype(np.int64), centroids.astype(np.int64)) if how == 1 else (exact(x[at]), centroids)
            d = np.stack([((rows - one) ** 2).sum(axis=1) for one in c], axis=1)
        to[at] = np.argmin(d, axis=1)
        best = d[np.arange(len(at)), to[at]]
        far[at] = best.astype(np.int64).tolist() if how == 0 else best.tolist()
    return to, far


def starting(vectors: DataFrame, key: str, column: str, length: int, factor: float, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least SHA-256 of `seed:key`, as Python's integers."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.filter(usable(column) & (F.size(column) == length)).select(hashed.alias("h"), F.col(column).alias("v"))
    first = rows.orderBy("h", "v").limit(k).collect()  # k rows
    return exact(scaled(pa.array([r["v"] for r in first], pa.list_(pa.float64())), length, factor)[1])


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", length: int = 64, factor: float = 1024, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of vectors(key, column)."""
    centroids = starting(vectors, key, column, length, factor, k, seed)
    k = len(centroids)
    out = f"`{key}` {vectors.schema[key].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not k:
        return vectors.sparkSession.createDataFrame([], out)
    blocks = written(packed_blocks(vectors, column, length, factor), "vectors")

    def of(centroids: np.ndarray):
        def sums(x):
            to, far = nearest(x, centroids)
            inertia = np.zeros(k, object)
            for g in np.unique(to).tolist():
                inertia[g] = sum(far[to == g].tolist())
            return (*sums_by(x, to, k), inertia)

        return tree_sum(blocks, length, sums, (np.zeros(k, object), np.zeros((k, length), object), np.zeros(k, object)))

    for _ in range(rounds):
        n, total, _ = of(centroids)
        centroids = np.array([total[i] // n[i] if n[i] else centroids[i] for i in range(k)], object)
    _, _, inertia = of(centroids)
    dropped(blocks)
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    whole = sum(inertia.tolist())

    def assign(batches):
        for b in batches:
            kept, x = scaled(b.column(column), length, factor)
            to, far = nearest(narrowed(x), centroids)
            columns = [b.column(key).take(pa.array(kept)), pa.array(to.astype(np.int32)), as_long(far), as_long(inertia[to]), as_long(np.full(len(to), whole, object)), pa.array([named[i] for i in to.tolist()], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return vectors.select(key, column).mapInArrow(assign, out)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10) -> str:
    """A common table for each round; floor division of the sums by remainders, which are never negative here."""
    ok = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {ok})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS BIGINT) AS k, q AS c FROM v QUALIFY k < {k})",
    ]
    apart = "CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, min(d * {k} + k) AS best FROM (SELECT vec_id, q, k, {apart} AS d FROM v, c{i}) GROUP BY vec_id)")
        if i < rounds:
            parts += [
                f"s{i} AS MATERIALIZED (SELECT k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT best % {k} AS k, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM a{i}) GROUP BY ALL)",
                f"m{i} AS MATERIALIZED (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{i} GROUP BY k)",
                f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))",
            ]
    final = f"SELECT vec_id, best % {k} AS k, best // {k} AS d FROM a{rounds}"
    return f"""WITH {", ".join(parts)}, f AS ({final})
SELECT vec_id, CAST(f.k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY f.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN c{rounds} ON f.k = c{rounds}.k"""


OP12_SQL = _sql()

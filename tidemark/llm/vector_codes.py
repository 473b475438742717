"""Codes of whole-number vectors: each part is replaced by the index of its nearest codebook entry (operator 13).

A float32 matrix product gives every entry's distance with an interval that the rounding cannot leave: for n products the
error is at most g |x| |c|, g = (n + 3) u / (1 - (n + 3) u), u = 2^-24, in whatever order they are added. An entry whose
interval overlaps the best one's is evaluated again with whole numbers (int64; Python's where 62 bits are too few), and of
equal distances the lower index is taken. Numbers too large for float32 products skip the screening: all entries are then
evaluated with whole numbers.

Defined results: a vector that is null or has a null or non-finite component is left out (as is a float64 one whose scaled
components are not finite); so is one that has another length than most others have (of equally common lengths the longer; only
multiples of the number of parts count); the entries start from the least ids, null last, of equal ids from the lesser
vector; with fewer vectors than entries there are as many entries; none: no rows; rows that repeat an id are vectors each of
their own; null labels are one label; other columns are ignored, whatever their names; an error beyond 64 bits is null, and
so is the sum over its label."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, written
from .whole_vectors import INT_SAFE, as_long, exact, narrowed, packed_blocks, scaled, sums_by, tree_sum, usable

#: Rows (one for each label) that may be broadcast.
BROADCAST_ROWS = 500_000
UNIT = 2.0**-24


def overlapping(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which entries c may be nearest to which rows x, by float32 products with the intervals of their errors."""
    n = x.shape[1]
    xd, cd = x.astype(float), c.astype(float)
    product = (xd.astype(np.float32) @ cd.astype(np.float32).T).astype(float)
    c2 = (cd * cd).sum(axis=1)
    reach = np.sqrt((xd * xd).sum(axis=1))[:, None] * np.sqrt(c2)[None, :]
    g = (n + 3) * UNIT / (1 - (n + 3) * UNIT)
    radius = (2 * g * reach + (n + 4) * 2.0**-52 * (c2[None, :] + 2 * reach)) * (1 + 1e-9)
    score = c2[None, :] - 2 * product  # |x|^2 is the same for all entries
    return score - radius <= (score + radius).min(axis=1)[:, None]


def nearest_entry(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the entries (Python's integers) to each row, the first of equals, and the squared distance, exactly."""
    most = max(float(np.abs(x).max(initial=0)), float(max(abs(v) for v in entries.ravel().tolist())))
    small = x.dtype.kind == "i" and 4 * x.shape[1] * most**2 < INT_SAFE
    rows, c = (x.astype(np.int64), entries.astype(np.int64)) if small else (exact(x), entries)
    maybe = overlapping(x, entries) if most < 2.0**60 else np.ones((len(x), len(c)), bool)
    i, k = np.nonzero(maybe)
    apart = ((rows[i] - c[k]) ** 2).sum(axis=1)
    if small:
        d = np.full(maybe.shape, np.iinfo(np.int64).max)
    else:
        d = np.full(maybe.shape, max(apart.tolist(), default=0) + 1, object)
    d[i, k] = apart
    to = np.argmin(d, axis=1)
    return to, d[np.arange(len(x)), to].astype(object)


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of rows, a column for each part, and the distances summed over the parts."""
    width = x.shape[1] // len(books)
    codes, error = np.zeros((len(x), len(books)), np.int64), np.zeros(len(x), object)
    for p, book in enumerate(books):
        codes[:, p], far = nearest_entry(x[:, p * width : (p + 1) * width], book)
        error = error + far
    return codes, error


def common_length(vectors: DataFrame, column: str, parts: int) -> int:
    """The most common length of usable vectors that the parts divide; 0 without any."""
    n = F.size(column)
    per = vectors.filter(usable(column) & (n > 0) & (n % parts == 0)).groupBy(n.alias("n")).agg(F.count("*").alias("m"))
    got = per.orderBy(F.desc("m"), F.desc("n")).first()
    return got["n"] if got else 0


def train(vectors: DataFrame, key: str, column: str, length: int, factor: float, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """A codebook for each part, from the least ids, moved to the means of what is nearest in each round."""
    rows = vectors.filter(usable(column) & (F.size(column) == length)).select(F.col(key).alias("k"), F.col(column).alias("v"))
    first = rows.orderBy(F.asc_nulls_last("k"), "v").limit(entries).collect()  # as many rows as entries
    start = exact(scaled(pa.array([r["v"] for r in first], pa.list_(pa.float64())), length, factor)[1])
    width, k = length // parts, len(start)
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    blocks = written(packed_blocks(vectors, column, length, factor), "vectors")

    def of(books):
        def sums(x):
            codes, _ = encode(x, books)
            return tuple(a for p in range(parts) for a in sums_by(x[:, p * width : (p + 1) * width], codes[:, p], k))

        return tree_sum(blocks, length, sums, (np.zeros(k, object), np.zeros((k, width), object)) * parts)

    for _ in range(rounds):
        got = of(books)
        books = [np.array([total[i] // n[i] if n[i] else book[i] for i in range(k)], object) for book, n, total in zip(books, got[0::2], got[1::2], strict=True)]
    dropped(blocks)
    return books


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", factor: float = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 of vectors(key, column, label)."""
    length = common_length(vectors, column, parts)
    kind = lambda c: vectors.schema[c].dataType.simpleString()
    if not length:
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind(key)}, code string, error long, label_error long, codebooks_sha256 string")
    books = train(vectors, key, column, length, factor, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()

    def run(batches):
        for b in batches:
            kept, x = scaled(b.column("v"), length, factor)
            codes, error = encode(narrowed(x), books)
            text = [bytes(row).hex() for row in codes.astype(np.uint8).tolist()]
            ids = [b.column(c).take(pa.array(kept)) for c in ("k", "l")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(text, pa.string()), as_long(error)], names=["k", "l", "code", "error"])

    named = vectors.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(column).alias("v"))
    coded = written(named.mapInArrow(run, f"k {kind(key)}, l {kind(label)}, code string, error long"), "codes")
    fits = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")))
    per = coded.groupBy("l").agg(fits.alias("total"))
    per = per.select("l", F.when(F.col("total") <= F.lit((1 << 63) - 1), F.col("total")).cast("long").alias("label_error"))
    few = per.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    per = (F.broadcast(per) if few else per).withColumnRenamed("l", "_l")
    out = coded.join(per, F.col("l").eqNullSafe(F.col("_l")))
    return out.select(F.col("k").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """A common table for each round; vectors of 64 components, as the table has them."""
    width = 64 // parts
    ok = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    out = [
        f"w AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {ok})",
        f"v AS MATERIALIZED (SELECT vec_id, p, q[p * {width} + 1:p * {width} + {width}] AS q FROM w, (SELECT unnest(range({parts})) AS p))",
        f"e0 AS MATERIALIZED (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS BIGINT) AS k, q AS c FROM v QUALIFY k < {entries})",
    ]
    apart = "CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    for i in range(rounds + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT vec_id, p, any_value(q) AS q, min(d * {entries} + k) AS best FROM (SELECT vec_id, v.p, q, k, {apart} AS d FROM v JOIN e{i} ON v.p = e{i}.p) GROUP BY ALL)")
        if i < rounds:
            out += [
                f"s{i} AS MATERIALIZED (SELECT p, k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, best % {entries} AS k, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM a{i}) GROUP BY ALL)",
                f"m{i} AS MATERIALIZED (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{i} GROUP BY ALL)",
                f"e{i + 1} AS MATERIALIZED (SELECT p, k, coalesce(m{i}.c, e{i}.c) AS c FROM e{i} LEFT JOIN m{i} USING (p, k))",
            ]
    return f"""WITH {", ".join(out)},
f AS (SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM e{rounds}) AS codebooks_sha256
FROM f JOIN w USING (vec_id)"""


OP13_SQL = _sql()

"""Vectors of whole numbers, scaled from floating-point ones, in packed blocks that are reduced by trees of tasks.

A component x becomes floor(factor * x), which a float64 always holds exactly. A block keeps its numbers in the narrowest
type that holds them (16, 32, 64 bits), or as float64 where 62 bits are too few; such numbers are reckoned with as Python's
integers, so that no result is rounded, however large they are."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beyond these, float64 and int64 no longer hold every whole number that a sum of squares passes through (with a bit to spare).
FLOAT_SAFE, INT_SAFE = 2.0**52, 2.0**62
#: Vectors in a block.
BLOCK = 16_384


def usable(column: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    ok = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ok, F.lit(False))


def scaled(vectors: pa.Array, length: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of this length in an Arrow list array, and their whole numbers, a row each."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    right = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), length), False).to_numpy(zero_copy_only=False))
    if not len(right):
        return right, np.empty((0, length))
    values = vectors.take(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, length)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * factor)
    ok = np.isfinite(values).all(axis=1)
    return right[ok], values[ok]


def narrowed(x: np.ndarray) -> np.ndarray:
    most = float(np.abs(x).max(initial=0))
    for kind, bits in ((np.int16, 15), (np.int32, 31), (np.int64, 62)):
        if most < 2.0**bits:
            return x.astype(kind)
    return x


def exact(x: np.ndarray) -> np.ndarray:
    """The same numbers as Python's integers."""
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def packed_blocks(table: DataFrame, column: str, length: int, factor: float) -> DataFrame:
    """kind, block: the usable vectors of this length, many to a row."""

    def pack(batches):
        for b in batches:
            _, x = scaled(b.column(column), length, factor)
            for lo in range(0, len(x), BLOCK):
                part = narrowed(x[lo : lo + BLOCK])
                yield pa.RecordBatch.from_pydict({"kind": [part.dtype.str], "block": pa.array([part.tobytes()], pa.binary())})

    return table.select(column).mapInArrow(pack, "kind string, block binary")


def unpacked(row, length: int) -> np.ndarray:
    return np.frombuffer(bytes(row["block"]), row["kind"]).reshape(-1, length)


def sums_by(x: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of x each of k groups has, and their componentwise sums as Python's integers."""
    n = np.bincount(group, minlength=k)
    wide = x.dtype.kind == "f" or float(np.abs(x).max(initial=0)) * len(x) >= INT_SAFE
    total = np.zeros((k, x.shape[1]), object)
    for g in np.flatnonzero(n):
        rows = x[group == g]
        total[g] = exact(rows).sum(axis=0) if wide else exact(rows.sum(axis=0, dtype=np.int64))
    return n.astype(object), total


def tree_sum(blocks: DataFrame, length: int, of_block: Callable[[np.ndarray], tuple], zero: tuple) -> tuple:
    """The componentwise sum of of_block over all blocks, added up within tasks, then in a tree: the driver gets one tuple."""

    def add(a, b):
        return tuple(x + y for x, y in zip(a, b, strict=True))

    return blocks.rdd.treeAggregate(zero, lambda acc, row: add(acc, of_block(unpacked(row, length))), add)


def as_long(x) -> pa.Array:
    """64-bit values; null where a number needs more."""
    return pa.array([v if -(1 << 63) <= v < 1 << 63 else None for v in x.tolist()], pa.int64())

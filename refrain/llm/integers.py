"""Vectors of whole numbers, and exact squared distances of them, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of a vector, and how many whole numbers a unit has.
DIM, UNIT = 64, 256
#: Whole numbers may be as large as this, so that squared distances stay exact in 64 bits.
MOST = 1 << 27
#: Up to this size all products and sums are whole in 64-bit floats.
PLAIN = 1 << 21


def finite(vector: Column) -> Column:
    """Whether a vector has DIM components and none is null or not finite."""
    x = F.transform(vector, lambda x: x.cast("double"))
    return (F.size(vector) == DIM) & F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def kept(vectors: DataFrame, *more: Column) -> DataFrame:
    """vec_id, e (components as doubles) and ``more`` of the usable vectors."""
    e = F.col("`embedding`").cast("array<double>")
    return vectors.where(F.col("`embedding`").isNotNull() & finite(e)).select(F.col("`vec_id`").cast("long").alias("vec_id"), e.alias("e"), *more)


def whole(values: pa.Array) -> np.ndarray:
    """floor(UNIT * x) of a list column, a row for each vector."""
    x = np.floor(np.asarray(values.flatten(), np.float64) * UNIT).reshape(-1, DIM)
    if x.size and np.abs(x).max() > MOST:
        raise ValueError(f"a component is larger than {MOST / UNIT:.0f}; squared distances would not fit in 64 bits")
    return x.astype(np.int64)


def packed(v: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in v.astype("<i4")]


def unpacked(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<i4").astype(np.int64)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of v to the rows of c, exact."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= PLAIN:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(1) for x in c], axis=1) if len(c) else np.zeros((len(v), 0), np.int64)


def slots(batch_sums: np.ndarray) -> pa.RecordBatch:
    """slot, total: the sums that are not zero."""
    at = np.flatnonzero(batch_sums)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(batch_sums[at])], ["slot", "total"])


def by_slot(sums: DataFrame, n: int) -> np.ndarray:
    """The n sums that ``sums`` (slot, total) has; n does not grow with the data."""
    out = np.zeros(n, np.int64)
    for r in sums.groupBy("slot").agg(F.sum("total").alias("total")).collect():
        out[r["slot"]] = r["total"]
    return out

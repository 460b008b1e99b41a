"""Vectors with whole components: what takes part, and in what form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components are held to this range, so that sums of products of thousands of them fit in 64 bits.
LARGEST = 1 << 26


def whole(embeddings: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of every component x, taken as double.

    Rows with a null vec_id, a null or empty vector, or a null or non-finite component take no part. Components
    beyond the range of ``LARGEST`` count as its ends. Without a label column labels are null.
    """
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    label = F.col("label") if "label" in embeddings.columns else F.lit(None).cast("int")
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    kept = given.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", usable))
    held = lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x * F.lit(float(scale))))).cast("int")
    return kept.select("vec_id", "label", F.transform("x", held).alias("v"))


def padded(vectors: DataFrame, width: int) -> DataFrame:
    """Vectors of one width: what is shorter ends in zeros."""
    return vectors.withColumn("v", F.when(F.size("v") == width, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0), width - F.size("v")))))


def matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """An Arrow column of lists of ``width`` numbers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exact: in floating point where every sum fits its 53 bits, else in 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T

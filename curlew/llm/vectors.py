"""Embedding columns as matrices: which rows take part, and their vectors batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column | str) -> Column:
    """Whether a vector has components, and none of them is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def extent(vectors: DataFrame) -> tuple[int, float]:
    """Length that most usable vectors of ``embedding`` have (the smaller one if two are equally frequent), and the largest absolute
    component of these; (0, 0.0) without any."""
    largest = F.max(F.greatest(F.array_max("embedding"), -F.array_min("embedding"))).alias("largest")
    seen = vectors.filter(usable("embedding")).groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n"), largest)
    most = seen.orderBy(F.desc("n"), "length").limit(1).collect()
    return (most[0].length, most[0].largest) if most else (0, 0.0)


def matrix(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the batch, vectors as doubles) of the rows whose ``embedding`` is usable and of that length."""
    column = batch.column("embedding")
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), length), False)
    places = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.filter(fits).flatten().cast(pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(places), length)
    good = np.isfinite(values).all(axis=1)
    return places[good], values[good]

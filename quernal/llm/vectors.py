"""Vectors in Arrow batches: which ones take part, and how a list column becomes a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector that isn't null and holds neither null nor NaN nor infinity."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & fine


def dense(vectors: pa.Array, size: int) -> np.ndarray:
    """Lists of numbers without nulls as the rows of a matrix of doubles; shorter ones are filled up with 0."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(vectors) and (lengths == size).all():
        return values.reshape(len(vectors), size)
    out = np.zeros((len(vectors), size))
    starts = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(vectors)), lengths), np.arange(len(values)) - np.repeat(starts, lengths)] = values
    return out

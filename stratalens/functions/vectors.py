"""Vector arithmetic on arrays of floats, in double precision."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(v: Column | str | Sequence[float]) -> Column:
    if isinstance(v, str):
        return F.col(v)
    return v if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column | str, b: Column | str | Sequence[float]) -> Column:
    pairs = F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_column(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column | str, query: Sequence[float] | Column) -> Column:
    """1 - cosine similarity; NaN for a zero vector.  A query given as numbers has its norm worked out once."""
    size = norm(query) if isinstance(query, Column) else F.lit(math.sqrt(sum(float(x) ** 2 for x in query)))
    scale = norm(a) * size
    return F.when(scale == 0, F.lit(float("nan"))).otherwise(1 - dot(a, query) / F.when(scale == 0, 1.0).otherwise(scale))


def cosine_distance_arrow(query: Sequence[float]):
    """The same by a vectorised function: one matrix product for each batch, for scans of many vectors."""
    import numpy as np

    q = np.asarray(query, dtype=np.float64)
    size = float(np.sqrt(q @ q))

    @F.pandas_udf("double")
    def distance(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="float64")
        m = np.stack(vectors.to_numpy()).astype(np.float64)
        scale = np.sqrt((m * m).sum(axis=1)) * size
        with np.errstate(invalid="ignore", divide="ignore"):
            return pd.Series(1.0 - (m @ q) / scale)

    return distance


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def score_of_distance(distance: Column) -> Column:
    return clamp(1 - distance)


def score_of_bm25(score: Column) -> Column:
    """s / (s + 1); zero for no score or a negative one."""
    return F.when(score > 0, score / (score + 1)).otherwise(0.0)


def decibels(rms: Column) -> Column:
    """20 log10, minus infinity at zero."""
    return F.when(rms <= 0, F.lit(float("-inf"))).otherwise(20 * F.log10(F.when(rms <= 0, 1.0).otherwise(rms)))

"""Functions of packed series (arrays of doubles), for DataFrames and SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from modeloom.operators.kernels.numeric import analytic
from modeloom.operators.kernels.spectral import dtw


def dot(x: Column | str, y: Column | str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def energy(x: Column | str) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)


def mean(x: Column | str) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def _dtw(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else dtw(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(x, y, strict=True)])


def _envelope(x: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else np.abs(analytic(np.asarray(a, float))) if len(a) else a for a in x])


def register(spark: SparkSession) -> None:
    """Makes ``dtw_distance(x, y)`` and ``hilbert_envelope(x)`` known to SQL."""
    spark.udf.register("dtw_distance", F.pandas_udf(_dtw, "double"))
    spark.udf.register("hilbert_envelope", F.pandas_udf(_envelope, "array<double>"))

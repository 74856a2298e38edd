"""Neighbourhood operators on images (image_id, y, x, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def neighbourhood(images: DataFrame, reach: int, **aggregates: Callable[[Column], Column]) -> DataFrame:
    """``images`` with aggregates (maxima, minima or sums of ``value``) over the pixels within ``reach`` rows and columns, as far as the image goes.

    Squares are rows of rows: one window along x, then one along y, so a pixel
    is shuffled twice, whatever the reach. Images are whole grids.
    """
    along = W.partitionBy("image_id", "y").orderBy("x").rangeBetween(-reach, reach)
    across = W.partitionBy("image_id", "x").orderBy("y").rangeBetween(-reach, reach)
    rows = images.select("image_id", "y", "x", "value", *[f(F.col("value")).over(along).alias(k) for k, f in aggregates.items()])
    return rows.select("image_id", "y", "x", "value", *[f(F.col(k)).over(across).alias(k) for k, f in aggregates.items()])


def image_extrema(images: DataFrame) -> DataFrame:
    """(image_id, y, x, is_max, is_min): pixels not below, or not above, any of their eight neighbours."""
    n = neighbourhood(images, 1, hi=F.max, lo=F.min)
    return n.select("image_id", "y", "x", (F.col("value") >= F.col("hi")).alias("is_max"), (F.col("value") <= F.col("lo")).alias("is_min"))


def local_variance(images: DataFrame, window: int = 5) -> DataFrame:
    """(image_id, y, x, value): squared distance from the mean of the surrounding pixels that exist."""
    half = window // 2
    edges = images.groupBy("image_id").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))

    def span(at: str, low: str, high: str) -> Column:
        return F.least(F.col(at) + half, F.col(high)) - F.greatest(F.col(at) - half, F.col(low)) + 1

    n = neighbourhood(images, half, total=F.sum).join(edges, "image_id")
    mean = F.col("total") / (span("y", "y0", "y1") * span("x", "x0", "x1"))
    return n.select("image_id", "y", "x", ((F.col("value") - mean) ** 2).alias("value"))


def rank_filter(images: DataFrame, window: int, largest: bool = True) -> DataFrame:
    """(image_id, y, x, value): the largest, or smallest, value around each pixel."""
    return neighbourhood(images, window // 2, best=F.max if largest else F.min).select("image_id", "y", "x", F.col("best").alias("value"))

"""Adapters from tables to signals (series_id, t, value), images and feature rows.

``t`` counts a series' samples from 0 without gaps. Money-like values are summed
as whole cents, so that a sum doesn't depend on its order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def indexed(sampled: DataFrame, order: str) -> DataFrame:
    """(series_id, t, value): samples numbered in the order of a column."""
    t = F.row_number().over(W.partitionBy("series_id").orderBy(order)) - 1
    return sampled.select("series_id", t.cast("bigint").alias("t"), "value")


def cents(column: str):
    return (F.sum(F.round(F.col(column) * 100).cast("bigint")) / 100).alias("value")


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of event values, one series for each event type."""
    hour = F.date_trunc("hour", "ts").alias("hour")
    return indexed(read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), hour).agg(cents("value")), "hour")


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue, one series for each order priority."""
    day = F.to_date("o_orderdate").alias("day")
    return indexed(read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), day).agg(cents("o_totalprice")), "day")


def users_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event counts of each user."""
    day = F.to_date("ts").alias("day")
    counts = read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("series_id"), day).agg(F.count("*").cast("double").alias("value"))
    return indexed(counts, "day")


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, features, label)."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")


def embedding_images(spark: SparkSession, sf_dir: str, width: int = 8) -> DataFrame:
    """(image_id, y, x, value): each embedding as rows of ``width`` pixels."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "value"))
    return rows.select("image_id", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).alias("x"), F.col("value").cast("double").alias("value"))

"""Made-up bars for tests and timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sinusoid(spark: SparkSession, rows: int = 700, start_ms: int = 1_577_836_800_000) -> DataFrame:
    """One-minute bars on two sines and a slope; no random numbers."""
    i = F.col("id").cast("double")
    x = spark.range(rows).select("id", (F.lit(100.0) + i * 30 / max(rows - 1, 1) + 2 * F.sin(i / 7) + 4 * F.sin(i / 31)).alias("close"), (1000 + 100 * F.sin(i / 5)).alias("volume"))
    x = x.withColumn("open", F.col("close") * (1 + 0.001 * F.sin(F.col("id") / 11)))
    return x.select(F.lit("sinusoid").alias("series_id"), (F.lit(start_ms) + F.col("id") * 60_000).alias("timestamp_utc_ms"), "open", (F.greatest("open", "close") * 1.002).alias("high"), (F.least("open", "close") * 0.998).alias("low"), "close", "volume")


def random_walk(spark: SparkSession, rows: int = 2000, seed: int = 42, start_ms: int = 1_704_067_200_000) -> DataFrame:
    """Hourly bars on a walk of normal steps (the walk is one series, so one task sums it)."""
    n = lambda k: F.randn(seed + k)
    x = spark.range(0, rows, 1, 1).select("id", (0.8 * n(0)).alias("_step"), (n(1) * 0.001).alias("_o"), F.abs(0.001 + 0.0005 * n(2)).alias("_h"), F.abs(0.001 + 0.0005 * n(3)).alias("_l"), F.greatest(F.lit(1.0), F.exp(7 + 0.5 * n(4))).alias("volume"))
    x = x.withColumn("series_id", F.lit("random_walk"))
    x = x.withColumn("close", 100 + F.sum("_step").over(Window.partitionBy("series_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("open", F.col("close") * (1 + F.col("_o")))
    return x.select("series_id", (F.lit(start_ms) + F.col("id") * 3_600_000).alias("timestamp_utc_ms"), "open", (F.greatest("open", "close") * (1 + F.col("_h"))).alias("high"), (F.least("open", "close") * (1 - F.col("_l"))).alias("low"), "close", "volume")

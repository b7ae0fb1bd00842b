"""Bar tables: resampling, cleaning, deduplication and upsert of OHLCV series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY, DUBAI = 86_400_000_000, 14_400_000_000
OHLC = ("open", "high", "low", "close")


def epoch_micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one-row bars: series by event type, price by value, volume by the number in props."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value", "props")
    p = F.col("value")
    return e.where(p > 0).select(
        F.col("event_type").alias("series_id"), epoch_micros("ts").alias("us"), p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"), F.regexp_extract("props", r'"k": *(\d+)', 1).try_cast("bigint").alias("volume")
    )


def resample(bars: DataFrame, seconds: int, time_us: str = "us") -> DataFrame:
    """Right-closed, right-labelled bars; bins start at local (UTC+4) midnight of each series' first day.

    Empty bins give no bar and the last one may be partial. Partial aggregates
    combine before the one shuffle on series and bin.
    """
    step = seconds * 1_000_000
    t = F.col(time_us)
    if 86_400 % seconds == 0 and 14_400 % seconds == 0:  # every midnight is on the grid: the first day doesn't matter
        binned = bars.withColumn("_b", F.expr(f"({time_us} + {step} - 1) div {step} * {step}"))
    else:
        first = bars.groupBy("series_id").agg(F.expr(f"(min({time_us}) + {DUBAI}) div {DAY} * {DAY} - {DUBAI}").alias("_o"))
        binned = bars.join(first, "series_id").withColumn("_b", F.expr(f"_o + ({time_us} - _o + {step} - 1) div {step} * {step}"))
    return binned.groupBy("series_id", (F.col("_b") / 1000).cast("long").alias("timestamp_utc_ms")).agg(
        F.min_by("open", t).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", t).alias("close"), F.sum("volume").cast("double").alias("volume")
    )


def resample_many(bars: DataFrame, seconds: list[int]) -> DataFrame:
    """Several bar sizes, told apart by ``timeframe_s``."""
    return reduce(DataFrame.unionByName, (resample(bars, s).withColumn("timeframe_s", F.lit(s)) for s in seconds))


def bars(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    return resample(ticks(spark, sf_dir), seconds)


def timestamp_ms(x: Column, key: str = "series_id") -> Column:
    """Seconds, milli-, micro- or nanoseconds to ms by the median magnitude of the series."""
    m = F.percentile(F.abs(x), F.lit(0.5)).over(Window.partitionBy(key))
    return F.when(m >= 1e17, F.round(x / 1e6)).when(m >= 1e14, F.round(x / 1e3)).when(m >= 1e11, F.round(x)).when(m >= 1e8, F.round(x * 1e3)).cast("long")


def keep_last(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The latest arrival of each key."""
    rows = F.struct(F.col(arrival).alias("_a"), *[F.col(c) for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(rows, F.col(arrival)).alias("_r")).select(*keys, "_r.*").drop("_a")


def clean(df: DataFrame) -> DataFrame:
    """Whole positive prices, a high and low that hold the others, no negative volume."""
    o, h, lo, c = (F.col(x) for x in OHLC)
    return df.where((F.least(o, h, lo, c) > 0) & o.isNotNull() & h.isNotNull() & lo.isNotNull() & c.isNotNull() & (h >= F.greatest(o, c, lo)) & (lo <= F.least(o, c, h)) & (F.coalesce("volume", F.lit(0.0)) >= 0))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The union where new rows win."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return keep_last(both, keys, "_v").drop("_v")


def overlap_start(df: DataFrame, step_ms: int, rows: int = 60) -> DataFrame:
    """From when each series is to be fetched again."""
    return df.groupBy("series_id").agg((F.max("timestamp_utc_ms") - rows * step_ms).alias("from_ms"))

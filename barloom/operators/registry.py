"""Catalog inference, group counts and the experiment registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dataset_kind(path: Column) -> Column:
    p = F.lower(path)
    return F.when(F.contains(p, F.lit("funding")), "funding_rate").when(F.contains(p, F.lit("open_interest")), "open_interest").when(F.contains(p, F.lit("ohlcv")), "ohlcv").otherwise("unknown")


def symbol_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(path), r"([A-Z0-9]{2,15}(?:USDT|USDC|BUSD|USD))", 1), F.lit(""))


def asset_of(symbol: Column) -> Column:
    return F.regexp_replace(symbol, r"(USDT|USDC|BUSD|USD)$", "")


def timeframe_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(?:^|[_/\\.-])(\d{1,3}(?:min|m|h|d|D|w))(?:[_/\\.-]|$)", 1), F.lit(""))


def series_key(kind: Column, source: Column, asset: Column, symbol: Column, timeframe: Column, stem: Column) -> Column:
    return F.concat_ws("__", kind, source, asset, symbol, timeframe, F.substring(F.sha2(stem, 256), 1, 8))


def counts_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each column's values, null as UNKNOWN, in one pass by grouping sets."""
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias("value")) for c in columns)))
    return df.select(parts.alias("_x")).groupBy("_x.key", "_x.value").agg(F.count(F.lit(1)).alias("n"))


def matrix(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts by both columns, by the first, and over all."""
    return df.rollup(first, second).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def inverted_index(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def modal_interval(bars: DataFrame) -> DataFrame:
    """Most frequent distance of rows, its share and what it says of the series."""
    w = Window.partitionBy("series_id").orderBy("timestamp_utc_ms")
    d = bars.withColumn("_d", F.col("timestamp_utc_ms") - F.lag("timestamp_utc_ms").over(w)).where("_d > 0")
    c = d.groupBy("series_id", "_d").agg(F.count(F.lit(1)).alias("_n"))
    out = c.groupBy("series_id").agg(F.max(F.struct("_n", (-F.col("_d")).alias("_m"))).alias("_b"), F.sum("_n").alias("_all"))
    share = F.col("_b._n") / F.col("_all")
    return out.select("series_id", (-F.col("_b._m")).alias("modal_delta_ms"), share.alias("share"), F.when(share >= 0.95, "high").when(share >= 0.80, "medium").otherwise("low").alias("confidence"))


def class_distribution(labels: DataFrame, columns: list[str]) -> DataFrame:
    """Label, value, rows (long form)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("value")) for c in columns)))
    return labels.select(pairs.alias("_x")).groupBy("_x.label", "_x.value").agg(F.count(F.lit(1)).alias("n"))


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    row = F.struct(*[F.col(c) for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(row, F.col(by)).alias("_r")).select(key, "_r.*")


def evenly(df: DataFrame, k: int) -> DataFrame:
    """k rows of each series at evenly spaced places."""
    w = Window.partitionBy("series_id")
    x = df.withColumn("_i", F.row_number().over(w.orderBy("timestamp_utc_ms")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * (F.col("_n") - 1) / (k - 1)).cast("int"))
    return x.where(F.array_contains(spots, F.col("_i").cast("int"))).drop("_i", "_n")


def registry(experiments: DataFrame, metrics: DataFrame, datasets: DataFrame) -> DataFrame:
    """Experiments with their metrics and datasets, and a hash of both ids; ``review_status`` tells what they wait for."""
    out = experiments.join(metrics, "experiment_id", "left").join(datasets, "series_id", "left")
    return out.withColumn("registry_hash", F.substring(F.sha2(F.concat_ws("|", "experiment_id", "series_id"), 256), 1, 16))


#: Column, the texts that don't stop it, and the status if it has another one; the first counts.
REVIEWS = (
    ("walk_forward_status", ("OK",), "BLOCKED_WALK_FORWARD"),
    ("backtest_status", ("OK", None), "NEEDS_BACKTEST_REVIEW"),
    ("validation_status", ("PASS", None), "NEEDS_VALIDATION_REVIEW"),
    ("stress_status", ("OK", None), "NEEDS_STRESS_REVIEW"),
)


def review_status(gate: str = "ml_gate") -> Column:
    """What an experiment waits for: its data, its training, its backtest, the backtest's checks or its stress runs."""
    out = F.lit("RESEARCH_REGISTERED")
    for column, fine, otherwise in reversed(REVIEWS):
        good = F.col(column).isin(*[v for v in fine if v])
        out = F.when(F.coalesce(good, F.lit(None in fine)), out).otherwise(otherwise)
    return F.when(F.col(gate) == "ML_BLOCKED", "BLOCKED_DATA_QUALITY").otherwise(out)

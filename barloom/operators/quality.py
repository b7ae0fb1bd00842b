"""Data-quality audits of series and the gates they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import div, lag

#: Least rows by timeframe.
MIN_ROWS = {"7D": 40, "3D": 80, "1D": 180}


def min_rows(timeframe: str, odd: bool = False) -> int:
    return MIN_ROWS.get(timeframe, 200 if odd else 300)


def audit(bars: DataFrame, step_ms: int, gap: float = 1.5, outlier: float = 0.5) -> DataFrame:
    """One row a series: nulls, adjacent duplicates, disorder, gaps, bad prices, simple returns beyond ``outlier``; one window, one aggregate."""
    t = F.col("timestamp_utc_ms")
    d = t - lag(t)
    x = bars.withColumn("_d", d).withColumn("_r", div(F.col("close"), lag(F.col("close"))) - 1)
    n = lambda c: F.count(F.when(c, 1))
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")) | (F.least("open", "high", "low", "close") <= 0)
    out = x.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("rows"), n(F.col("close").isNull() | F.col("open").isNull()).alias("null_rows"), n(F.col("_d") == 0).alias("duplicate_count"),
        n(F.col("_d") > gap * step_ms).alias("gap_count"), n((F.col("_d") > 0) & (F.abs(F.col("_d") - step_ms) > max(1000, step_ms * 0.001))).alias("irregular_count"),
        n(bad).alias("invalid_ohlc"), n(F.col("volume") < 0).alias("negative_volume"), n(F.abs("_r") > outlier).alias("return_outlier_count"),
        F.min(t).alias("first_ms"), F.max(t).alias("last_ms"), F.percentile(F.when(F.col("_d") > 0, F.col("_d")), F.lit(0.5)).alias("median_delta_ms"),
    )
    return out.withColumns({"gap_ratio": div(F.col("gap_count"), F.col("rows")), "outlier_ratio": div(F.col("return_outlier_count"), F.col("rows"))})


def status(audited: DataFrame) -> DataFrame:
    """PASS, WARNING or FAIL with the warnings, and their first cause by priority."""
    warn = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in (("duplicate_timestamps", F.col("duplicate_count") > 0), ("gaps", F.col("gap_count") > 0), ("irregular", F.col("irregular_count") > 0), ("return_outliers", F.col("return_outlier_count") > 0)))))
    fail = (F.col("rows") == 0) | (F.col("invalid_ohlc") > 0) | (F.col("null_rows") > 0) | (F.col("negative_volume") > 0)
    cause = F.when(F.col("null_rows") > 0, "NULLS").when(F.col("invalid_ohlc") > 0, "INVALID_OHLC").when(F.col("negative_volume") > 0, "NEGATIVE_VOLUME").when(F.col("duplicate_count") > 0, "DUPLICATES").when(F.col("gap_count") > 0, "GAPS").when(F.col("return_outlier_count") > 0, "OUTLIERS").when(F.col("irregular_count") > 0, "IRREGULAR").otherwise("NONE")
    return audited.withColumn("warnings", warn).withColumn("status", F.when(fail, "FAIL").when(F.size("warnings") > 0, "WARNING").otherwise("PASS")).withColumn("root_cause", cause)


def ml_gate(judged: DataFrame, least: int = 300, ratio: float = 0.001) -> DataFrame:
    blocked = (F.col("status") == "FAIL") | (F.col("rows") < least) | (F.col("gap_ratio") > ratio) | (F.col("outlier_ratio") > ratio)
    return judged.withColumn("gate", F.when(blocked, "BLOCKED").when(F.col("status") == "WARNING", "CAUTION_ACCEPTABLE").otherwise("READY"))


def validity(rows: DataFrame, columns: list[str], lookback: int, least: float = 0.95) -> DataFrame:
    """Warm-up, share of values that are there, and whether the row is fit for a model."""
    from ..functions.rolling import whole

    share = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) / F.lit(float(max(len(columns), 1)))
    out = rows.withColumn("quality_is_warmup", F.row_number().over(whole()) - 1 < lookback).withColumn("quality_feature_share", share)
    return out.withColumn("quality_is_valid", ~F.col("quality_is_warmup") & (F.col("quality_feature_share") >= least))


def prune(rows: DataFrame, columns: list[str], most_null: float = 0.985) -> DataFrame:
    """Drops columns that are nearly all null or constant; one aggregate decides."""
    stats = rows.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(f"n_{i}") for i, c in enumerate(columns)], *[(F.min(c) == F.max(c)).alias(f"d_{i}") for i, c in enumerate(columns)]).first()
    return rows.drop(*[c for i, c in enumerate(columns) if (stats[f"n_{i}"] or 0) > most_null or stats[f"d_{i}"] is not False])


def same_values(a: DataFrame, b: DataFrame, columns: list[str], keys=("series_id", "timestamp_utc_ms")) -> DataFrame:
    """Greatest absolute difference of each column over the rows both have."""
    j = a.alias("a").join(b.alias("b"), list(keys))
    return j.agg(*[F.max(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))).alias(c) for c in columns])


def contains_any(x: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(x), F.lit(w))
    return out

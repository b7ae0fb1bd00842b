"""Rollups over series, runs, labels and windows; samples and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(series: DataFrame, by: tuple[str, ...] = ("source", "asset", "symbol", "kind")) -> DataFrame:
    """Series, timeframes, rows, and the first and last time of each group."""
    return series.groupBy(*by).agg(F.count(F.lit(1)).alias("series"), F.array_join(F.array_sort(F.collect_set("timeframe")), ",").alias("timeframes"), F.sum("rows").alias("rows"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


def timings(runs: DataFrame, by: str = "family") -> DataFrame:
    """Runs, those that went well or were skipped, and seconds of each family; the slowest first."""
    status = F.upper(F.coalesce("status", F.lit("UNKNOWN")))
    n = lambda c: F.count(F.when(c, 1))
    out = runs.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), n(status == "OK").alias("ok"), n(F.startswith(status, F.lit("SKIP"))).alias("skipped"), F.sum("seconds").alias("total_seconds"), F.max("seconds").alias("max_seconds"), F.avg("seconds").alias("avg_seconds"))
    return out.orderBy(F.desc("total_seconds"), by)


def to_retry(series: DataFrame, runs: DataFrame) -> DataFrame:
    """Series with a run that failed."""
    return series.join(runs.where(F.startswith(F.upper("status"), F.lit("ERROR"))).select("series_id").distinct(), "series_id", "left_semi")


def missing(expected: DataFrame, there: DataFrame, key: str = "series_id") -> DataFrame:
    """Keys that should be there and aren't."""
    return expected.select(key).distinct().join(there.select(key).distinct(), key, "left_anti")


def with_default(rows: DataFrame, record: DataFrame, key: str, column: str, default: str) -> DataFrame:
    """The record's column by key, a default where there is none."""
    return rows.join(record.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def layered(rows: DataFrame, general: float, by_source: DataFrame, by_symbol: DataFrame, column: str) -> DataFrame:
    """A value by symbol, else by source, else in general."""
    s, m = by_source.select("source", F.col(column).alias("_s")), by_symbol.select("symbol", F.col(column).alias("_m"))
    return rows.join(s, "source", "left").join(m, "symbol", "left").withColumn(column, F.coalesce("_m", "_s", F.lit(general))).drop("_s", "_m")


def first_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.min_by(rest, F.col(order)).alias("_r")).select(*keys, "_r.*")


def quality_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, warm-up, valid and eligible rows, nulls among the columns, first and last time of each series."""
    nulls = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0))
    n = lambda c: F.count(F.when(F.col(c), 1))
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), n("quality_is_warmup").alias("warmup_rows"), n("quality_is_valid").alias("valid_rows"), F.sum(nulls).alias("null_values"), F.min("timestamp_utc_ms").alias("first_ms"), F.max("timestamp_utc_ms").alias("last_ms"), F.min(F.when(F.col("quality_is_valid"), F.col("timestamp_utc_ms"))).alias("first_valid_ms"))


def label_balance(labels: DataFrame, columns: list[str]) -> DataFrame:
    """Of each class label: rows, missing ones, and the shares of above, at and below zero."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("v")) for c in columns)))
    x = labels.select(pairs.alias("_x")).select("_x.*")
    share = lambda c: F.avg(F.when(F.col("v").isNotNull(), c.cast("int")))
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("v").isNull(), 1)).alias("missing"), share(F.col("v") > 0).alias("above"), share(F.col("v") == 0).alias("zero"), share(F.col("v") < 0).alias("below"))


def over_windows(metrics: DataFrame, columns: list[str], by: str = "experiment_id", good: str = "balanced_accuracy", at_least: float = 0.5) -> DataFrame:
    """Windows, means of their metrics, and how many are good."""
    return metrics.groupBy(by).agg(F.count(F.lit(1)).alias("windows"), *[F.avg(c).alias(f"mean_{c}") for c in columns], F.count(F.when(F.col(good) > at_least, 1)).alias("good_windows"))


def edges_hash(bars: DataFrame, k: int = 5) -> DataFrame:
    """sha256 over the first and last k rows of each series, as text in time order.

    The k edges are picked by two ranks, which Spark limits on each partition
    before the shuffle; only they are gathered.
    """
    w = Window.partitionBy("series_id")
    up = bars.withColumn("_k", F.row_number().over(w.orderBy("timestamp_utc_ms"))).where(F.col("_k") <= k).drop("_k")
    down = bars.withColumn("_k", F.row_number().over(w.orderBy(F.desc("timestamp_utc_ms")))).where(F.col("_k") <= k).drop("_k")
    text = F.concat_ws(",", F.col("timestamp_utc_ms").cast("string"), *[F.round(F.col(c) * 10_000).cast("long").cast("string") for c in ("open", "high", "low", "close")])
    edge = up.unionByName(down).select("series_id", "timestamp_utc_ms", text.alias("_t")).distinct()
    lines = F.array_sort(F.collect_list(F.struct("timestamp_utc_ms", "_t")))
    return edge.groupBy("series_id").agg(F.sha2(F.concat_ws("\n", F.transform(lines, lambda r: r["_t"])), 256).alias("edges"))


def batches(first_ms: Column, last_ms: Column, step_ms: int, limit: int = 1000) -> Column:
    """Pages that hold the bars of a period."""
    return F.ceil(((last_ms - first_ms) / step_ms + 1) / limit).cast("long")


def file_key(content: Column, edge: int = 65_536) -> Column:
    """sha256 over a file's first and last bytes; over all of it where they meet."""
    n = F.octet_length(content)
    ends = F.concat(content.substr(F.lit(1), F.lit(edge)), content.substr(n - edge + 1, F.lit(edge)))
    return F.when(n <= 2 * edge, F.sha2(content, 256)).otherwise(F.sha2(ends, 256))

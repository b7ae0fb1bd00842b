"""Bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.bars import upsert


def stream_bars(ticks: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Right-closed bars of a streaming frame (series_id, ts timestamp, price, volume); closed bars leave in append mode.

    ``window`` is left-closed, so a tick on a boundary is moved one microsecond
    back: then it falls in the bar that ends there.
    """
    t = ticks.withColumn("_t", F.expr("ts - interval 1 microsecond")).withWatermark("_t", late)
    out = t.groupBy("series_id", F.window("_t", f"{seconds} seconds").alias("_w")).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.select("series_id", F.unix_millis("_w.end").alias("timestamp_utc_ms"), "open", "high", "low", "close", "volume")


def upsert_sink(path: str, keys: list[str]):
    """For ``foreachBatch``: each batch's rows win over those in ``path``, in a new version of the table."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = f"{path}/v{number - 1}"
        new = batch if number == 0 else upsert(spark.read.parquet(old), batch, keys)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return write

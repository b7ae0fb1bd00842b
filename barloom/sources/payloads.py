"""Exchange payloads, manifests and file tables as sources, and the sinks of tables."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Positions of open time, prices and volume in a kline, of which the spot and the linear form share the first six.
OPEN_TIME, FIELDS = 0, {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 5}
#: Tries, seconds of backoff a try, least seconds after a status, and the statuses tried again beside 5xx.
TRIES, BACKOFF, LEAST_WAIT, AGAIN = 4, 1.5, 2.0, (418, 429)


def _bar_columns(row: Column, seconds: int) -> list[Column]:
    opened = row.getItem(OPEN_TIME).try_cast("bigint")
    return [(opened + seconds * 1000).alias("timestamp_utc_ms"), *(row.getItem(i).try_cast("double").alias(n) for n, i in FIELDS.items())]


def klines(spark: SparkSession, path: str, seconds: int) -> DataFrame:
    """Bars of files that hold a list of klines each; a bar's time is its close. Values that don't parse are null."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "array<array<string>>")).alias("_k"))
    return rows.select(*_bar_columns(F.col("_k"), seconds)).where("timestamp_utc_ms is not null")


def _records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("_x")).select("_x.*")


def funding(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    x = _records(spark, path, "fundingRateTimestamp string, fundingRate string")
    return x.select(F.col("fundingRateTimestamp").try_cast("bigint").alias("timestamp_utc_ms"), F.lit(symbol).alias("symbol"), F.col("fundingRate").try_cast("double").alias("funding_rate")).where("timestamp_utc_ms is not null")


def open_interest(spark: SparkSession, path: str, symbol: str, interval: str = "1h") -> DataFrame:
    x = _records(spark, path, "timestamp string, openInterest string")
    return x.select(F.col("timestamp").try_cast("bigint").alias("timestamp_utc_ms"), F.lit(symbol).alias("symbol"), F.lit(interval).alias("oi_interval"), F.col("openInterest").try_cast("double").alias("open_interest")).where("timestamp_utc_ms is not null")


class _Page(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def fetch_json(url: str):
    """A page, tried again after a busy or failing server with a growing wait."""
    for n in range(1, TRIES + 1):
        try:
            with urllib.request.urlopen(url, timeout=30) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if n == TRIES or not (e.code in AGAIN or e.code >= 500):
                raise
            time.sleep(max(LEAST_WAIT, BACKOFF * n))
        except OSError:
            if n == TRIES:
                raise
            time.sleep(BACKOFF * n)


class KlineSource(DataSource):
    """Bars by pages of ``limit`` klines over HTTP: the range is known, so its pages are read in parallel.

    Options: ``url`` with ``{start}``, ``{end}`` and ``{limit}``, ``start_ms``,
    ``end_ms`` (not included), ``seconds`` of a bar, ``limit`` (1000).
    """

    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return "timestamp_utc_ms long, open double, high double, low double, close double, volume double"

    def reader(self, schema) -> DataSourceReader:
        return _KlineReader(self.options)


class _KlineReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.limit = options["url"], int(options.get("limit", 1000))
        self.start, self.end, self.step = int(options["start_ms"]), int(options["end_ms"]), int(options["seconds"]) * 1000

    def partitions(self):
        width = self.limit * self.step
        return [_Page(t, min(t + width, self.end)) for t in range(self.start, self.end, width)] or [_Page(self.start, self.start)]

    def read(self, page):
        if page.end <= page.start:
            return
        for k in fetch_json(self.url.format(start=page.start, end=page.end - 1, limit=self.limit)):
            if page.start <= int(k[OPEN_TIME]) < page.end:
                yield (int(k[OPEN_TIME]) + self.step, *(float(k[i]) for i in FIELDS.values()))


def manifest(spark: SparkSession, path: str, key: str = "series_id") -> DataFrame:
    """Records of a JSON manifest in any of three shapes: a list, ``{"results": [...]}``, or an object of records by id."""
    text = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", "array<map<string,string>>")
    nested = F.from_json(F.get_json_object("value", "$.results"), "array<map<string,string>>")
    by_id = F.from_json("value", "map<string,map<string,string>>")
    named = F.transform(F.map_entries(by_id), lambda e: F.map_concat(F.map_filter(e.value, lambda k, v: k != key), F.create_map(F.lit(key), e.key)))
    shape = F.when(F.get_json_object("value", "$.results").isNotNull(), nested).when(F.ltrim("value").startswith("["), as_list).otherwise(named)
    return text.select(F.explode(shape).alias("record")).select(F.col("record").getItem(key).alias(key), "record")


def file_table(spark: SparkSession, path: str, extension: str = "") -> DataFrame:
    """Path, size and time of every file below a folder, without its content."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return x.where(F.col("path").endswith(extension)) if extension else x


def folder_sizes(files: DataFrame) -> DataFrame:
    """Files and bytes of each folder, its subfolders included: every prefix of a path counts it."""
    parts = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.select(F.explode(above).alias("folder"), "length").groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def jsonl_tail(spark: SparkSession, path: str, schema: str, by: str, rows: int = 200) -> DataFrame:
    """The latest records of a JSON-lines log; broken lines are left out."""
    bad = "_corrupt"
    x = spark.read.schema(f"{schema}, {bad} string").option("columnNameOfCorruptRecord", bad).json(path)
    return x.where(F.col(bad).isNull()).drop(bad).orderBy(F.desc(by)).limit(rows)


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ("series_id",)) -> None:
    """Parquet by partition; only the partitions that the rows touch are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, separator: str = " | ") -> None:
    """CSV with a header; arrays become text."""
    flat = [F.array_join(c, separator).alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def rebase(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """A folder's name replaced in a text column, JSON included."""
    return df.withColumn(column, F.replace(F.col(column), F.lit(old), F.lit(new)))

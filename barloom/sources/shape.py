"""Bringing tables into the shape of bars: names, times, order of columns, which series are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.quality import min_rows

ZONE = "Asia/Dubai"
#: Column names, in any case, and what they are called here.
ALIASES = {
    "local_time": ("datetime", "date_time", "date", "open_time", "close_time", "time"),
    "timestamp_utc_ms": ("timestamp_utc_ms", "utc_timestamp_ms", "meta_timestamp_utc_ms", "timestamp_ms", "close_time_utc_ms"),
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "close": ("close", "c"),
    "volume": ("volume", "vol", "base_volume"),
    "quote_volume": ("quote_volume", "quote_asset_volume"),
    "number_of_trades": ("number_of_trades", "trades", "trade_count"),
    "taker_buy_base_volume": ("taker_buy_base_volume", "taker_buy_volume"),
}
PRICES = ("open", "high", "low", "close", "volume")
#: Prefixes of columns a model may read, and of those it must not.
INPUTS, HIDDEN = ("feat_", "regime_", "xasset_", "cost_"), ("label_", "meta_", "quality_")


def renamed(df: DataFrame) -> DataFrame:
    """Columns by their aliases. A column that has the name already keeps it; else the first alias in the table gets it."""
    by_alias = {a: name for name, aliases in ALIASES.items() for a in aliases}
    out, taken = [], set(df.columns)
    for c in df.columns:
        name = by_alias.get(c.strip().lower(), c)
        name = c if name in taken else name
        taken.add(name)
        out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)


def coerced(df: DataFrame, columns: tuple[str, ...] = PRICES) -> DataFrame:
    """Numbers; what is none, NaN and infinite becomes null."""
    number = lambda c: F.col(c).try_cast("double")
    return df.withColumns({c: F.when(~F.isnan(number(c)) & (F.abs(number(c)) != float("inf")), number(c)) for c in columns if c in df.columns})


def to_local(ms: Column) -> Column:
    """The local time without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.timestamp_millis(ms.cast("long")).cast("timestamp_ntz"))


def from_local(t: Column) -> Column:
    """UTC milliseconds of a local time without a zone."""
    return F.unix_millis(F.convert_timezone(F.lit(ZONE), F.lit("UTC"), t.cast("timestamp_ntz")).cast("timestamp"))


def closed(df: DataFrame, step_ms: int, opened: str = "open_ms") -> DataFrame:
    """A bar's time is when it closes."""
    return df.withColumn("timestamp_utc_ms", F.col(opened) + F.lit(step_ms)).withColumn("local_time", to_local(F.col("timestamp_utc_ms")))


def reconciled(df: DataFrame, least: float = 0.9) -> DataFrame:
    """Of both time columns, the timestamp rules where ``least`` of a series' are there; else it is made from the local time."""
    ms = F.col("timestamp_utc_ms").try_cast("long")
    ruled = F.avg(ms.isNotNull().cast("int")).over(Window.partitionBy("series_id")) >= least
    out = df.withColumn("timestamp_utc_ms", F.when(ruled, ms).otherwise(from_local(F.col("local_time"))))
    return out.withColumn("local_time", to_local(F.col("timestamp_utc_ms")))


def with_metadata(df: DataFrame, about: DataFrame) -> DataFrame:
    """Constant columns of each series, as meta_*; Spark broadcasts the table by its size."""
    return df.join(about.select("series_id", *[F.col(c).alias(f"meta_{c}") for c in about.columns if c != "series_id"]), "series_id", "left")


def ordered(df: DataFrame) -> DataFrame:
    """Keys, metadata, quality, prices, other columns, then regimes and features."""
    first = [c for c in ("series_id", "timestamp_utc_ms", "local_time") if c in df.columns]
    groups = [[c for c in df.columns if c.startswith(p)] for p in ("meta_", "quality_")] + [[c for c in PRICES if c in df.columns]]
    last = [[c for c in df.columns if c.startswith(p)] for p in ("regime_", "feat_")]
    placed = {*first, *(c for g in groups + last for c in g)}
    return df.select(*first, *(c for g in groups for c in g), *(c for c in df.columns if c not in placed), *(c for g in last for c in g))


def model_inputs(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(INPUTS) and not c.startswith(HIDDEN)]


def smaller(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def picked(df: DataFrame, prefixes: dict[str, tuple[str, ...]] | None = None, **allowed) -> DataFrame:
    """Rows whose columns are among the allowed values, or start with one of the prefixes (lower-cased); none given: all."""
    for c, values in allowed.items():
        if values:
            df = df.where(F.col(c).isin(list(values)))
    for c, starts in (prefixes or {}).items():
        any_of = F.lit(not starts)
        for p in starts:
            any_of = any_of | F.startswith(F.lower(F.trim(c)), F.lit(p.lower()))
        df = df.where(F.coalesce(any_of, F.lit(False)))
    return df


def long_enough(df: DataFrame, timeframe: str, odd: bool = False) -> DataFrame:
    """Series with the least rows of their timeframe; a count and a semi join, so that no window holds a series."""
    counted = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows(timeframe, odd))
    return df.join(counted, "series_id", "left_semi")

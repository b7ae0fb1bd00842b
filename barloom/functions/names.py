"""What names of series, files and columns say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Source names looked for in paths, in this order.
SOURCES = ("binance_spot", "binance_futures", "binance", "bybit_linear", "bybit_inverse", "bybit", "okx", "kraken", "coinbase", "kucoin")
#: Folders that hold series of one kind, one folder a source.
KIND_FOLDERS = ("ohlcv", "funding_rate", "open_interest")
#: Folders that tell where in the layout a file is, in this order.
LOCATIONS = ("custom_timeframes", "processed", "raw", "metadata", "diagnostics", "_logs")
#: Words for yes and no.
TRUE, FALSE = ("1", "true", "yes", "sim", "y"), ("0", "false", "no", "nao", "não", "n")
#: Seconds of a unit.
UNITS = {"s": 1, "min": 60, "h": 3600, "d": 86_400}


def _slashed(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"\\", "/"))


def _found(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def source_of(path: Column, given: Column | None = None) -> Column:
    """The given source; else the first known name in the path; else the folder below that of a kind."""
    known = F.array_compact(F.array(*(F.when(F.contains(_slashed(path), F.lit(s)), F.lit(s)) for s in SOURCES)))
    folder = _found(_slashed(path), rf"(?:^|/)(?:{'|'.join(KIND_FOLDERS)})/([^/]+)/")
    said = [F.nullif(F.trim(given), F.lit(""))] if given is not None else []
    return F.coalesce(*said, F.try_element_at(known, F.lit(1)), folder)


def location_of(path: Column) -> Column:
    """The layout's folder that the path goes through, with either slash."""
    out = F.lit(None).cast("string")
    for name in LOCATIONS:
        out = F.coalesce(out, F.when(F.contains(_slashed(path), F.lit(f"/{name}/")), F.lit(name.lstrip("_"))))
    return F.coalesce(out, F.lit("unknown"))


def timeframe_seconds(timeframe: Column) -> Column:
    """Seconds of 30s, 5min, 4h, 1D; null for anything else."""
    t = F.lower(F.trim(timeframe))
    n, unit = _found(t, r"^(\d+)(s|min|h|d)$").cast("long"), _found(t, r"^(\d+)(s|min|h|d)$", 2)
    per = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return n * per[unit]


def annualization(timeframe: Column) -> Column:
    """Bars in a year of 365 days; 365 where the timeframe says nothing."""
    s = timeframe_seconds(timeframe)
    return F.when(s > 0, F.lit(365.0 * 86_400) / s).otherwise(365.0)


def timeframe_label(seconds: Column) -> Column:
    """The largest unit that divides the seconds."""
    out = F.concat(seconds.cast("string"), F.lit("s"))
    for unit, n in (("min", 60), ("h", 3600), ("D", 86_400)):
        out = F.when(seconds % n == 0, F.concat((seconds / n).cast("long").cast("string"), F.lit(unit))).otherwise(out)
    return F.when(seconds > 0, out)


def horizon_bars(label: Column, default: int = 20) -> Column:
    """The horizon in a label's name: _h20_ or at its end, else any h20."""
    return F.coalesce(_found(label, r"_h(\d+)(?:_|$)").cast("int"), _found(label, r"h(\d+)").cast("int"), F.lit(default))


def parsed_list(text: Column, default: tuple[float, ...] = ()) -> Column:
    """Numbers of a comma-separated text; what is no number is left out, the default stands in for none."""
    got = F.array_compact(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double")))
    return F.when(F.size(got) > 0, got).otherwise(F.array(*[F.lit(float(x)) for x in default]).cast("array<double>"))


def permissive_bool(x: Column, default: bool = True) -> Column:
    """Yes and no in the words of manifests; the default for anything else."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False).otherwise(default)


def label_column(columns: list[str], candidates: tuple[str, ...], horizon: int) -> str | None:
    """The first candidate, its {h} filled in, that is a column."""
    return next((c for k in candidates if (c := k.format(h=horizon)) in columns), None)

"""What the families and joins are asked to grow by: as-of joins, slopes, entropy, labels against a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import back, div, ln, lag, whole


def as_of(bars: DataFrame, events: DataFrame, columns: list[str], keys: tuple[str, ...] = ("series_id",), most_ms: int | None = None) -> DataFrame:
    """Bars with the columns of the latest event at or before each, if it isn't older than ``most_ms``.

    A union and one window over the keys: a sort-merge of both sides, where a
    range join would compare all pairs. Events of the same time count as before
    the bar; of several, the one greatest by its columns.
    """
    held = F.struct(F.col("timestamp_utc_ms").alias("_at"), *[F.col(c) for c in columns])
    ev = events.groupBy(*keys, "timestamp_utc_ms").agg(F.max(held).alias("_e")).withColumn("_bar", F.lit(0))
    x = bars.withColumn("_bar", F.lit(1)).unionByName(ev, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("timestamp_utc_ms", "_bar").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_l", F.last("_e", ignorenulls=True).over(w)).where("_bar = 1")
    fresh = F.lit(True) if most_ms is None else F.col("timestamp_utc_ms") - F.col("_l._at") <= most_ms
    return x.select(*bars.columns, *[F.when(fresh, F.col(f"_l.{c}")).alias(c) for c in columns])


def slopes(bars: DataFrame, windows: tuple[int, ...] = (20, 50)) -> DataFrame:
    """feat_slope_{w}: least-squares slope of the log close over the last w rows."""
    x = bars.withColumn("_y", ln(F.col("close"))).withColumn("_x", F.row_number().over(whole()).cast("double"))
    full = lambda w: F.count("_y").over(back(w)) == w
    out = x.withColumns({f"feat_slope_{w}": F.when(full(w), div(F.covar_pop("_x", "_y").over(back(w)), F.var_pop("_x").over(back(w)))) for w in windows})
    return out.drop("_x", "_y")


def entropy(bars: DataFrame, windows: tuple[int, ...] = (20, 50)) -> DataFrame:
    """feat_entropy_{w}: bits of the signs of the last w returns."""
    r = ln(F.col("close"))
    x = bars.withColumn("_r", r - lag(r))
    x = x.withColumns({f"_s{k}": (F.signum("_r") == k - 1).cast("double") for k in range(3)})
    out = {}
    for w in windows:
        shares = [F.avg(f"_s{k}").over(back(w)) for k in range(3)]
        bits = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in shares), F.lit(0.0))
        out[f"feat_entropy_{w}"] = F.when(F.count("_r").over(back(w)) == w, bits)
    return x.withColumns(out).drop("_r", "_s0", "_s1", "_s2")


def against_benchmark(labels: DataFrame, column: str, benchmark: str) -> DataFrame:
    """label_rel_{column}: less the benchmark's at the same time; null where it has none. The benchmark itself is left out."""
    b = labels.where(F.col("series_id") == benchmark).select("timestamp_utc_ms", F.col(column).alias("_b"))
    out = labels.where(F.col("series_id") != benchmark).join(b, "timestamp_utc_ms", "left")
    return out.withColumn(f"label_rel_{column.removeprefix('label_')}", F.col(column) - F.col("_b")).drop("_b")

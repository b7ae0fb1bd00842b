"""Checks of grids, features, labels, trades and registries; each in one aggregate, in long form where it has names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import div, lag


def _all(cond: Column) -> Column:
    """Whether no row fails; rows without a verdict fail, no rows pass."""
    return F.coalesce(F.bool_and(F.coalesce(cond, F.lit(False))), F.lit(True))


def _long(row: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("passed")) for c in row.columns)))
    return row.select(pairs.alias("_x")).select("_x.*")


def time_grid(bars: DataFrame, step_ms: int, gap: float = 3.5, most_gaps: float = 0.01, most_irregular: float = 0.05) -> DataFrame:
    """Distances of rows per series: irregular ones, large gaps, their shares, and PASS, WARNING or FAIL."""
    t = F.col("timestamp_utc_ms")
    x = bars.withColumn("_d", t - lag(t))
    n = lambda c: F.count(F.when(c, 1))
    d = F.col("_d")
    out = x.groupBy("series_id").agg(
        F.count("_d").alias("total_deltas"), F.percentile("_d", F.lit(0.5)).alias("median_delta_ms"), F.min("_d").alias("min_delta_ms"), F.max("_d").alias("max_delta_ms"),
        n(F.abs(d - step_ms) > max(1000, step_ms * 0.001)).alias("irregular_delta_count"), n(d > gap * step_ms).alias("large_gap_count"),
    )
    out = out.withColumns({"irregular_ratio": div(F.col("irregular_delta_count"), F.col("total_deltas")), "large_gap_ratio": div(F.col("large_gap_count"), F.col("total_deltas"))})
    fail = (F.col("total_deltas") < 1) | (F.col("large_gap_ratio") > most_gaps) | (F.col("irregular_ratio") > most_irregular)
    return out.withColumn("status", F.when(fail, "FAIL").when(F.col("irregular_delta_count") + F.col("large_gap_count") > 0, "WARNING").otherwise("PASS"))


def preserved(before: DataFrame, after: DataFrame, columns: list[str], keys=("series_id", "timestamp_utc_ms")) -> DataFrame:
    """Whether a stage kept each row once and its columns as they were."""
    a = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(*columns)).alias("_v"))
    b = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), F.max(F.struct(*columns)).alias("_u"))
    j = a.join(b, list(keys), "full")
    row = j.agg(_all(F.col("_m").isNotNull()).alias("no_row_lost"), _all(F.col("_n").isNotNull()).alias("no_row_added"), _all(F.col("_n").eqNullSafe(F.col("_m"))).alias("same_multiplicity"), _all(F.col("_v").eqNullSafe(F.col("_u"))).alias("same_values"))
    return _long(row)


def label_audit(labels: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, nulls, infinities, range and whether a label is constant; a row per label."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("v")) for c in columns)))
    v = F.col("_x.v")
    out = labels.select(pairs.alias("_x")).groupBy("_x.label").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(v.isNull(), 1)).alias("null_count"), F.count(F.when(F.abs(v) == float("inf"), 1)).alias("inf_count"), F.min(v).alias("low"), F.max(v).alias("high"))
    out = out.withColumn("null_ratio", div(F.col("null_count"), F.col("rows")))
    return out.withColumn("status", F.when((F.col("inf_count") > 0) | (F.col("null_count") == F.col("rows")), "FAIL").when(F.col("low") == F.col("high"), "WARNING").otherwise("PASS"))


def trades(table: DataFrame, curve: DataFrame, keys=("series_id", "entry_ts", "side"), costs=("fee_bps", "slippage_bps", "funding_bps")) -> DataFrame:
    """Checks of trades and of their equity, with the verdict of each.

    Duplicates are counted per key, so the group of one key is one row of the
    shuffle. Row order isn't checked, as a table has none.
    """
    cost = sum((F.col(c) for c in costs), F.lit(0.0))
    ok = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    per = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), ok(F.col("entry_ts") < F.col("exit_ts")).alias("_o"), ok(F.abs("net_bps") < float("inf")).alias("_f"), ok(cost >= 0).alias("_c"))
    row = per.agg(F.expr("count(1) > 0").alias("has_trades"), _all(F.col("_o")).alias("entry_before_exit"), _all(F.col("_f")).alias("finite_returns"), _all(F.col("_c")).alias("nonnegative_costs"), _all(F.col("_n") == 1).alias("no_duplicate_trade_keys"))
    equity = curve.agg(_all(F.col("equity") > 0).alias("equity_positive"), _all(F.col("drawdown") <= 1e-7).alias("drawdown_nonpositive"))
    return _long(row).unionByName(_long(equity))


def registry(rows: DataFrame, key: str = "registry_hash", experiment: str = "experiment_id") -> DataFrame:
    """Rows present, ids unique and present; partial counts per id before the total."""
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.bool_and(F.coalesce(F.col(experiment) != "", F.lit(False))).alias("_e"))
    return _long(per.agg(F.expr("count(1) > 0").alias("registry_has_rows"), _all(F.col("_n") == 1).alias("registry_ids_unique"), _all(F.col("_e")).alias("experiment_ids_present")))

"""Costs, fills and prices of execution, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Funding in bps a day by exchange; spot has none, others 1.5.
FUNDING_PER_DAY = {"binance": 1.5, "bybit": 2.0, "kraken": 1.8}
#: Share of a bar's volume that is taken, bps at full participation, fills, and a limit order's slippage.
PARTICIPATION, IMPACT, LEAST_FILL, NO_VOLUME_FILL, LIMIT_FACTOR = 0.02, 250.0, 0.10, 0.50, 0.35


def finite(x: Column, default: float | None = None) -> Column:
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(ok, x).otherwise(F.lit(default))


def positive(x: Column) -> Column:
    return F.when(finite(x) > 0, x)


def quote_volume() -> Column:
    return F.coalesce(positive(F.col("close")) * positive(F.col("volume")), F.lit(0.0))


def funding_per_day(source: Column, given: Column | None = None) -> Column:
    """The row's own rate unless null or 0, else the exchange's."""
    s = F.lower(source)
    known = F.when(F.contains(s, F.lit("spot")), 0.0)
    for name, bps in FUNDING_PER_DAY.items():
        known = known.when(F.contains(s, F.lit(name)), bps)
    known = known.otherwise(1.5)
    return known if given is None else F.coalesce(F.when(finite(given) != 0, given), known)


def with_costs(rows: DataFrame, horizon_days: float, notional: float, fee: float = 20.0, slippage: float = 15.0, spread: float = 0.0, impact: float = 0.0, source: str = "source") -> DataFrame:
    """Round-trip costs in bps: fee, slippage with a penalty for the share of volume, both spreads and impacts, funding."""
    qv = quote_volume()
    share = F.coalesce(F.try_divide(F.lit(notional), qv), F.lit(0.0))
    slip = F.round(F.lit(slippage) + F.least(share, F.lit(PARTICIPATION)) * IMPACT, 8)
    own = F.col("cost_funding_bps_per_day") if "cost_funding_bps_per_day" in rows.columns else None
    fund = F.round(funding_per_day(F.col(source), own) * horizon_days, 8)
    both = 2 * (spread + impact)
    return rows.withColumns({"estimated_quote_volume": qv, "volume_participation": share, "fee_bps": F.lit(fee), "slippage_bps": slip, "spread_impact_bps": F.lit(both), "funding_bps": fund, "total_cost_bps": F.round(F.lit(fee + both) + slip + fund, 8)})


def fill_ratio(notional: Column) -> Column:
    """How much of an order the bar's volume fills."""
    qv = quote_volume()
    part = F.least(F.lit(1.0), F.greatest(F.lit(LEAST_FILL), F.try_divide(qv * PARTICIPATION, notional)))
    return F.when(notional <= 0, 0.0).when(qv <= 0, NO_VOLUME_FILL).otherwise(part)


def position_size(rows: DataFrame, equity: Column, stop_bps: float = 70.0, risk: float = 0.005, most: float = 0.20, leverage: float = 1.0) -> DataFrame:
    """Notional that loses ``risk`` of the equity at the stop, at most ``most`` of the equity, and what is filled of it."""
    asked = F.least(equity * (risk * 1e4 / max(abs(stop_bps), 1.0)), equity * (most * max(leverage, 1.0)))
    out = rows.withColumn("requested_notional", asked)
    out = out.withColumn("fill_ratio", fill_ratio(F.col("requested_notional")))
    out = out.withColumn("filled_notional", F.col("requested_notional") * F.col("fill_ratio"))
    return out.withColumn("margin_used", F.col("filled_notional") / leverage if leverage > 0 else F.lit(0.0))


def entry_price(side: Column, slippage_bps: Column, limit: bool = False) -> Column:
    """The open (limit: the close) moved by half the slippage against the trade, within the bar."""
    close = positive(F.col("close"))
    opened = F.coalesce(positive(F.col("open")), close)
    high = F.coalesce(positive(F.col("high")), F.greatest(opened, close))
    low = F.coalesce(positive(F.col("low")), F.least(opened, close))
    half = F.greatest(slippage_bps / 2, F.lit(0.0)) * (LIMIT_FACTOR if limit else 1.0) / 1e4
    price = (close if limit else opened) * F.when(side == "long", 1 + half).otherwise(1 - half)
    return F.least(F.greatest(price, low), high)


def path_exit(gross_bps: Column, best_bps: Column, worst_bps: Column, stop_bps: float, take_bps: float) -> Column:
    """Struct of the gross result and its reason: the stop comes before the target, as a path's order isn't known."""
    best, worst = finite(best_bps), finite(worst_bps)
    known = best.isNotNull() & worst.isNotNull()
    result = lambda bps, why: F.struct(bps.cast("double").alias("gross_bps"), F.lit(why).alias("reason"))
    out = F.when(~known, result(gross_bps, "HORIZON_NO_PATH_LABELS"))
    if stop_bps > 0:
        out = out.when(-F.abs(worst) <= -stop_bps, result(F.lit(-stop_bps), "STOP_LOSS_CONSERVATIVE"))
    if take_bps > 0:
        out = out.when(best >= take_bps, result(F.lit(take_bps), "TAKE_PROFIT"))
    return out.otherwise(result(gross_bps, "HORIZON"))

"""Trade simulation, portfolio admission, metrics and stress replay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import div, lead

#: Factors on fee, slippage, spread and impact, funding, and extra bps, by scenario.
SCENARIOS = (
    ("BASE_REPLAY", 1.0, 1.0, 1.0, 1.0, 0.0),
    ("COSTS_150PCT", 1.5, 1.5, 1.5, 1.5, 0.0),
    ("COSTS_200PCT", 2.0, 2.0, 2.0, 2.0, 0.0),
    ("SLIPPAGE_SHOCK", 1.0, 3.0, 2.0, 1.0, 5.0),
    ("FUNDING_SHOCK", 1.0, 1.0, 1.0, 4.0, 0.0),
    ("WORST_REGIME_PROXY", 1.5, 2.0, 2.0, 2.0, 25.0),
)


def candidates(bars: DataFrame, signal: DataFrame, horizon: int, latency: int = 1) -> DataFrame:
    """Signals with entry and exit rows, by position in the whole series, before the signals are joined."""
    c = F.col
    placed = bars.withColumns({"entry_ts": lead(c("timestamp_utc_ms"), latency), "entry_price": lead(c("open"), latency), "exit_ts": lead(c("timestamp_utc_ms"), latency + horizon), "exit_price": lead(c("close"), latency + horizon)})
    return placed.join(signal, ["series_id", "timestamp_utc_ms"]).where(c("exit_ts").isNotNull())


def simulate(cands: DataFrame, by: list[str], fraction: float = 0.1, fee: float = 20.0, slippage: float = 10.0, funding: float = 0.0, halt: float = 0.5) -> DataFrame:
    """One position at a time per group, with the equity so far as the next size: sequential, so a grouped map.

    A signal enters only after the last exit; below ``1 - halt`` of the highest
    equity no further trade is made.
    """
    kinds = {c: t for c, t in cands.dtypes}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp_utc_ms", ignore_index=True)
        equity = peak = 1.0
        last, out = -1, []
        for row in pdf.itertuples(index=False):
            if row.entry_ts <= last or equity < peak * (1 - halt):
                continue
            gross = (row.exit_price / row.entry_price - 1) * 1e4 * row.side
            net = gross - fee - slippage - funding * (row.exit_ts - row.entry_ts) / 86_400_000
            pnl = equity * fraction * net / 1e4
            equity, last = equity + pnl, row.exit_ts
            peak = max(peak, equity)
            out.append((*[getattr(row, b) for b in by], row.timestamp_utc_ms, row.entry_ts, row.exit_ts, int(row.side), gross, net, fee, slippage, gross - net - fee - slippage, pnl, equity))
        return pd.DataFrame(out, columns=[*by, "timestamp_utc_ms", "entry_ts", "exit_ts", "side", "gross_bps", "net_bps", "fee_bps", "slippage_bps", "funding_bps", "pnl", "equity"])

    schema = ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", timestamp_utc_ms long, entry_ts long, exit_ts long, side int, gross_bps double, net_bps double, fee_bps double, slippage_bps double, funding_bps double, pnl double, equity double"
    return cands.groupBy(*by).applyInPandas(run, schema)


def admit(trades: DataFrame, by: list[str], at_once: int = 5, fraction: float = 0.1) -> DataFrame:
    """Trades a portfolio takes: positions close first, one per series, at most ``at_once`` open."""
    kinds = {c: t for c, t in trades.dtypes}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["entry_ts", "series_id"], ignore_index=True)
        open_, equity, out = {}, 1.0, []
        for row in pdf.itertuples(index=False):
            for s in [s for s, (end, *_ ) in open_.items() if end <= row.entry_ts]:
                _, size, net = open_.pop(s)
                equity += size * net / 1e4
            if row.series_id in open_ or len(open_) >= at_once:
                continue
            size = equity * fraction
            open_[row.series_id] = (row.exit_ts, size, row.net_bps)
            out.append((*[getattr(row, b) for b in by], row.series_id, row.entry_ts, row.exit_ts, row.net_bps, size))
        return pd.DataFrame(out, columns=[*by, "series_id", "entry_ts", "exit_ts", "net_bps", "size"])

    return trades.groupBy(*by).applyInPandas(run, ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", series_id string, entry_ts long, exit_ts long, net_bps double, size double")


def equity_curve(trades: DataFrame, by: list[str], fraction: float = 0.1) -> DataFrame:
    """Compounded by exit; a loss counts at most 99 %."""
    w = Window.partitionBy(*by).orderBy("exit_ts", "entry_ts")
    step = F.greatest(F.lit(-0.99), F.col("net_bps") / 1e4 * fraction)
    out = trades.withColumn("equity", F.exp(F.sum(F.ln(1 + step)).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return out.withColumn("drawdown", div(F.col("equity"), F.greatest(F.lit(1.0), F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))) - 1)


def metrics(curve: DataFrame, by: list[str]) -> DataFrame:
    """Return, drawdown, win rate, profit factor and the longest run of losses (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy("exit_ts", "entry_ts")
    lost = F.col("net_bps") <= 0
    x = curve.withColumn("_n", F.row_number().over(w)).withColumn("_wins", F.sum((~lost).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.where(lost).groupBy(*by, "_wins").agg(F.count(F.lit(1)).alias("_len")).groupBy(*by).agg(F.max("_len").alias("longest_loss_run"))
    agg = x.groupBy(*by).agg(F.count(F.lit(1)).alias("trades"), (F.max_by("equity", "_n") - 1).alias("total_return"), F.min("drawdown").alias("max_drawdown"), F.avg((F.col("net_bps") > 0).cast("int")).alias("win_rate"), div(F.sum(F.when(~lost, F.col("net_bps"))), -F.sum(F.when(lost, F.col("net_bps")))).alias("profit_factor"), F.avg("net_bps").alias("mean_net_bps"))
    return agg.join(runs, by, "left").withColumn("longest_loss_run", F.coalesce("longest_loss_run", F.lit(0)))


def stress(trades: DataFrame, by: list[str], scenarios=SCENARIOS, capital: float = 10_000.0) -> DataFrame:
    """Trades under scaled costs, and the equity they replay to.

    ``trades`` have gross_bps, fee_bps, slippage_bps, spread_impact_bps, funding_bps
    and notional; profits add up in order of exit. Drawdown is from the highest
    equity, the capital at least. The base scenario gives the trades' own results.
    """
    names = ("_fee", "_slip", "_spread", "_fund", "_extra")
    s = F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), *(F.lit(v).alias(k) for k, v in zip(names, factors, strict=True))) for n, *factors in scenarios)))
    x = trades.withColumn("_c", s).select("*", "_c.*")
    costs = sum((F.col(c) * F.col(k) for c, k in (("slippage_bps", "_slip"), ("spread_impact_bps", "_spread"), ("funding_bps", "_fund"))), F.col("fee_bps") * F.col("_fee"))
    x = x.withColumn("_net", F.col("gross_bps") - F.col("_extra") - costs)
    w = Window.partitionBy(*by, "scenario").orderBy("exit_ts", "entry_ts").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_eq", F.lit(capital) + F.sum(F.col("notional") * F.col("_net") / 1e4).over(w))
    x = x.withColumn("_dd", div(F.col("_eq"), F.greatest(F.lit(capital), F.max("_eq").over(w))) - 1)
    last = F.max_by("_eq", F.struct("exit_ts", "entry_ts"))
    return x.groupBy(*by, "scenario").agg(F.count(F.lit(1)).alias("trades"), F.sum("_net").alias("net_bps_sum"), F.avg((F.col("_net") > 0).cast("int")).alias("win_rate"), (last / F.lit(capital) - 1).alias("total_return"), F.min("_dd").alias("max_drawdown"))

"""Execution with sizes, stops and a kill switch; portfolio admission with exposure caps; performance.

What doesn't depend on earlier trades (sides, path exits, costs apart from
slippage) is columns; only equity, overlap and the switch are folded over time,
one group a task.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import div


@dataclass(frozen=True)
class Rules:
    """Parameters of execution; bps are of the price, fractions of the equity."""

    capital: float = 10_000.0
    long_from: float = 0.55
    short_to: float = 0.45
    shorts: bool = True
    stop_bps: float = 70.0
    take_bps: float = 100.0
    risk: float = 0.005
    most: float = 0.20
    leverage: float = 1.0
    slippage_bps: float = 15.0
    participation: float = 0.02
    impact: float = 250.0
    least_fill: float = 0.10
    unknown_fill: float = 0.50
    edge_over_cost: bool = False
    least_edge_bps: float = 0.0
    switch: float = 0.20


def decided(cands: DataFrame, rules: Rules) -> DataFrame:
    """Adds side, the gross result after stop or target (the stop counts first), the reason, and why a signal can't be one.

    Read are proba, entry_ts, exit_ts, gross_bps, best_bps and worst_bps of the long side.
    """
    p = F.col("proba")
    finite = p.isNotNull() & ~F.isnan(p)
    side = F.when(p >= rules.long_from, 1).when(F.lit(rules.shorts) & (p <= rules.short_to), -1)
    x = cands.withColumn("side", F.when(finite, side))
    # a short's best is the long's worst, the other way round
    best = F.when(F.col("side") == 1, F.col("best_bps")).otherwise(-F.col("worst_bps"))
    worst = F.when(F.col("side") == 1, F.col("worst_bps")).otherwise(-F.col("best_bps"))
    reason = F.when(best.isNull() | worst.isNull(), "HORIZON_NO_PATH_LABELS").when(F.abs(worst) >= rules.stop_bps, "STOP_LOSS_CONSERVATIVE").when(best >= rules.take_bps, "TAKE_PROFIT").otherwise("HORIZON")
    x = x.withColumn("exit_reason", reason)
    gross = F.when(F.col("exit_reason") == "STOP_LOSS_CONSERVATIVE", -rules.stop_bps).when(F.col("exit_reason") == "TAKE_PROFIT", rules.take_bps).otherwise(F.col("gross_bps") * F.col("side"))
    x = x.withColumn("executed_bps", gross)
    why = F.when(~finite, "NOT_FINITE").when(F.col("side").isNull(), "BELOW_THRESHOLD").when(F.col("exit_ts").isNull() | F.col("entry_ts").isNull(), "NO_EXECUTION")
    return x.withColumn("_why", why).withColumn("_edge", F.abs(p - 0.5) * 1e4)


def execute(cands: DataFrame, by: list[str], rules: Rules = Rules(), found: dict[str, Rules] | None = None) -> DataFrame:
    """One row a signal: outcome TRADE with its size, costs and equity, or the reason why it is none.

    Needs the columns of ``decided`` and fixed_cost_bps, funding_bps and
    quote_volume. Of equal times, the earlier entry comes first. An exit stays at
    the horizon even where stop or target were met. After the switch fell, signals
    later than the exit that did it are HALTED. ``found``: the rules of each value
    of the first column of ``by``, for ``search``.
    """
    kinds = dict(cands.dtypes)
    names = [*by, "timestamp_utc_ms", "outcome", "side", "entry_ts", "exit_ts", "exit_reason", "filled_notional", "gross_bps", "cost_bps", "net_bps", "pnl", "portfolio_return", "equity", "drawdown"]
    schema = ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", timestamp_utc_ms long, outcome string, side int, entry_ts long, exit_ts long, exit_reason string, filled_notional double, gross_bps double, cost_bps double, net_bps double, pnl double, portfolio_return double, equity double, drawdown double"

    def sized(rules: Rules, equity: float, volume: float) -> tuple[float, float]:
        asked = min(equity * rules.risk * 1e4 / rules.stop_bps, equity * rules.most * max(rules.leverage, 1.0))
        if not volume > 0:
            return max(asked, 0.0) * rules.unknown_fill, rules.slippage_bps
        filled = max(asked, 0.0) * min(1.0, max(rules.least_fill, volume * rules.participation / asked if asked > 0 else 0.0))
        return filled, rules.slippage_bps + min(filled / volume, rules.participation) * rules.impact

    common = rules

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["timestamp_utc_ms", "entry_ts"], ignore_index=True)
        rules = found[pdf[by[0]].iloc[0]] if found else common
        equity = peak = rules.capital
        last_exit, halted, out = -1, None, []

        def none(key, row, why):
            out.append((*key, row.timestamp_utc_ms, why, *[None] * 11))

        for row in pdf.itertuples(index=False):
            key = [getattr(row, b) for b in by]
            why = row.why if isinstance(row.why, str) else None
            if why != "NOT_FINITE" and halted is not None and row.timestamp_utc_ms > halted:
                why = "HALTED"
            if why is None and row.entry_ts <= last_exit:
                why = "OVERLAP"
            if why:
                none(key, row, why)
                continue
            filled, slippage = sized(rules, equity, row.quote_volume)
            cost = row.fixed_cost_bps + slippage + row.funding_bps
            net = row.executed_bps - cost
            if filled <= 0:
                why = "NO_EXECUTION"
            elif net != net:
                why = "NOT_FINITE"
            elif rules.edge_over_cost and row.edge < cost + rules.least_edge_bps:
                why = "BELOW_THRESHOLD"
            if why:
                none(key, row, why)
                continue
            pnl = filled * net / 1e4
            share = max(-0.99, min(10.0, pnl / max(equity, 1.0)))
            equity += pnl
            peak, last_exit = max(peak, equity), int(row.exit_ts)
            if halted is None and rules.switch > 0 and 1 - equity / peak >= rules.switch:
                halted = last_exit
            out.append((*key, row.timestamp_utc_ms, "TRADE", int(row.side), int(row.entry_ts), last_exit, row.exit_reason, filled, row.executed_bps, cost, net, pnl, share, equity, equity / peak - 1))
        done = pd.DataFrame(out, columns=names)
        return done.astype({c: "Int64" for c in ("side", "entry_ts", "exit_ts")})

    ready = decided(cands, replace(rules, **{f: F.col(f"_{f}") for f in SEARCHED}) if found else rules).withColumnsRenamed({"_why": "why", "_edge": "edge"})
    return ready.groupBy(*by).applyInPandas(run, schema)


#: Rules that tell the configurations of a search apart before execution.
SEARCHED = ("long_from", "short_to", "shorts", "stop_bps", "take_bps")


def grid(base: Rules = Rules(), thresholds=(0.52, 0.55, 0.58, 0.60), stops=(50.0, 70.0, 100.0), takes=(70.0, 100.0, 150.0), shorts=(True, False), edges=(False,), leverages=(1.0,), most: int = 36) -> dict[str, Rules]:
    """The first ``most`` configurations, by name; the last parameter changes fastest, and a short's threshold mirrors the long's."""
    every = itertools.islice(itertools.product(thresholds, stops, takes, shorts, edges, leverages), most)
    return {f"t{t:g}_s{s:g}_p{p:g}_{'both' if sh else 'long'}_{'edge' if e else 'any'}_x{x:g}": replace(base, long_from=t, short_to=1.0 - t, stop_bps=s, take_bps=p, shorts=sh, edge_over_cost=e, leverage=x) for t, s, p, sh, e, x in every}


def search(cands: DataFrame, by: list[str], configs: dict[str, Rules]) -> DataFrame:
    """``execute`` for every configuration, one group a configuration and group, in one pass over the candidates."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("config"), *(F.lit(getattr(r, f)).alias(f"_{f}") for f in SEARCHED)) for name, r in configs.items())))
    x = cands.withColumn("_c", each).select("*", "_c.*").drop("_c")
    return execute(x, ["config", *by], found=configs)


def outcomes(executed: DataFrame, by: list[str]) -> DataFrame:
    """How many signals of each group came to what."""
    return executed.groupBy(*by, "outcome").agg(F.count(F.lit(1)).alias("signals"))


def performance(trades: DataFrame, by: list[str], target: float = 0.30, most_drawdown: float = 0.20, least_days: float = 30.0, least_trades: int = 30) -> DataFrame:
    """Return, yearly return, drawdown, Calmar, win rate, profit factor, longest losing streak, days covered, status.

    ``trades`` have portfolio_return, net_bps, entry_ts and exit_ts; returns
    compound in order of exit, and a loss counts at most 99 %. The yearly return is
    null for no days, and -1 where nothing is left.
    """
    w = Window.partitionBy(*by).orderBy("exit_ts", "entry_ts")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    r = F.col("portfolio_return")
    x = trades.withColumn("_eq", F.exp(F.sum(F.ln(1 + F.greatest(F.lit(-0.99), r))).over(so_far)))
    x = x.withColumns({"_dd": F.col("_eq") / F.max("_eq").over(so_far) - 1, "_n": F.row_number().over(w), "_island": F.sum((r >= 0).cast("int")).over(so_far)})
    streak = x.where(r < 0).groupBy(*by, "_island").agg(F.count(F.lit(1)).alias("_s")).groupBy(*by).agg(F.max("_s").alias("longest_losing_streak"))
    g = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_trades"), (F.max_by("_eq", "_n") - 1).alias("total_return"), F.min("_dd").alias("max_drawdown"), F.avg((r > 0).cast("int")).alias("win_rate"),
        div(F.sum(F.when(r > 0, r).otherwise(0.0)), F.abs(F.sum(F.when(r < 0, r)))).alias("profit_factor"), F.avg("net_bps").alias("avg_trade_net_bps"), F.percentile("net_bps", F.lit(0.5)).alias("median_trade_net_bps"),
        F.max(r).alias("best_trade"), F.min(r).alias("worst_trade"), (F.greatest(F.max("exit_ts") - F.min("entry_ts"), F.lit(0)) / 86_400_000).alias("coverage_days"),
    )
    base, days = 1 + F.col("total_return"), F.col("coverage_days")
    cagr = F.when(days > 0, F.when(base <= 0, -1.0).otherwise(F.pow(base, 365.0 / days) - 1))
    g = g.withColumn("cagr", F.when(F.abs(cagr) < float("inf"), cagr))
    g = g.withColumns({"calmar": div(F.col("cagr"), F.abs("max_drawdown")), "meets_target": F.coalesce(F.col("cagr") >= target, F.lit(False)), "within_drawdown": F.abs("max_drawdown") <= most_drawdown})
    enough = (days >= least_days) & (F.col("total_trades") >= least_trades)
    g = g.withColumn("status", F.when(enough, "RESEARCH_METRICS_READY").otherwise("RESEARCH_ONLY_INSUFFICIENT_SAMPLE"))
    return g.join(streak, by, "left").withColumn("longest_losing_streak", F.coalesce("longest_losing_streak", F.lit(0)))


def score(target: float = 0.30, most_drawdown: float = 0.20) -> Column:
    """What a parameter search ranks by, over the columns of ``performance``."""
    cagr, mdd = F.coalesce("cagr", F.lit(-1.0)), F.abs("max_drawdown")
    bonus = F.when((cagr >= target) & (mdd <= most_drawdown), 0.5).otherwise(0.0)
    few = F.when(F.col("total_trades") < 30, 0.2).otherwise(0.0)
    return F.round(cagr - 3.0 * F.greatest(F.lit(0.0), mdd - most_drawdown) + 0.10 * F.coalesce("profit_factor", F.lit(0.0)) + 0.05 * F.coalesce("win_rate", F.lit(0.0)) + bonus - few, 10)


def ranked(found: DataFrame, config: str, target: float = 0.30, most_drawdown: float = 0.20) -> DataFrame:
    """Configurations by score, the best first; of equal ones, by name. One row a configuration, so one task ranks them."""
    x = found.withColumn("score", score(target, most_drawdown))
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), config)))


def trade_groups(trades: DataFrame, by: tuple[str, ...] = ("source", "asset", "symbol", "timeframe", "side")) -> DataFrame:
    """Trades, mean net, win rate and summed return of each group; the largest first."""
    out = trades.groupBy(*by).agg(F.count(F.lit(1)).alias("trades"), F.avg("net_bps").alias("avg_net_bps"), F.avg((F.col("portfolio_return") > 0).cast("int")).alias("win_rate"), F.sum("portfolio_return").alias("total_slot_return"))
    return out.orderBy(F.desc("trades"), *by)


def admit_capped(trades: DataFrame, by: list[str], capital: float = 10_000.0, at_once: int = 5, total: float = 1.0, per_symbol: float = 0.25, most: float = 0.20, leverage: float = 1.0) -> DataFrame:
    """One row a trade: ADMITTED with its notional and equity after it closed, or CAPACITY or CONFLICT.

    Trades come in order of entry. Those over by then close first, in the order
    they were admitted. A symbol is held once; a notional is what was asked for, as
    far as the caps on all, on the symbol and on one position leave room. Needs
    symbol, entry_ts, exit_ts, filled_notional and net_bps.
    """
    kinds = dict(trades.dtypes)
    names = [*by, "symbol", "entry_ts", "exit_ts", "outcome", "notional", "pnl", "equity"]
    lev = max(leverage, 1.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["entry_ts", "exit_ts", "symbol"], ignore_index=True)
        cash, held, out = capital, [], []

        def close(until: float) -> None:
            nonlocal cash, held
            for p in held:
                if p[-1] <= until:
                    cash += p[1]
                    out[p[0]][-1] = cash
            held = [p for p in held if p[-1] > until]

        for row in pdf.itertuples(index=False):
            close(row.entry_ts)
            used = sum(p[2] for p in held)
            room = min(row.filled_notional, cash * total * lev - used, cash * per_symbol * lev, cash * most * lev)
            why = "CAPACITY" if len(held) >= at_once else "CONFLICT" if any(p[3] == row.symbol for p in held) else "ADMITTED" if room > 0 else "CAPACITY"
            line = [*[getattr(row, b) for b in by], row.symbol, row.entry_ts, row.exit_ts, why, None, None, None]
            if why == "ADMITTED":
                pnl = room * row.net_bps / 1e4
                line[-3:-1] = room, pnl
                held.append((len(out), pnl, room, row.symbol, row.exit_ts))
            out.append(line)
        close(float("inf"))
        return pd.DataFrame(out, columns=names).astype({"notional": "float64", "pnl": "float64", "equity": "float64"})

    schema = ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", symbol string, entry_ts long, exit_ts long, outcome string, notional double, pnl double, equity double"
    return trades.groupBy(*by).applyInPandas(run, schema)

"""Forward-looking labels over bars; rows frames ahead, never range frames."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import blocked
from ..functions.rolling import ahead, back, div, flag, lag, lead, ln, roll, whole


def _column(name: str):
    return lambda: F.col(name)  # made when it is used, as columns need a session


C, H, L = map(_column, ("close", "high", "low"))
#: Round-trip costs in bps by source.
COSTS = {"default": (20.0, 15.0, 0.0), "binance_spot": (20.0, 10.0, 0.0), "bybit_linear": (12.0, 12.0, 2.0)}


def _next(default):
    return lambda horizons=default, *_, **__: (0, max(horizons))


@blocked(_next((1, 5, 20)))
def forward_returns(bars: DataFrame, horizons=(1, 5, 20), seconds: int = 3600, source: str = "default") -> DataFrame:
    """Returns of holding each horizon, long and short, gross and net of fee, slippage and funding, as fractions and in bps; and the log return."""
    fee, slip, funding = COSTS[source]
    cols = {}
    for h in horizons:
        gross = {"long": div(lead(C(), h), C()) - 1, "short": 1 - div(lead(C(), h), C())}
        cost = (fee + slip + funding * h * seconds / 86400) / 1e4
        for side, g in gross.items():
            for kind, x in (("gross", g), ("net", g - cost)):
                cols |= {f"label_fwd_ret_{kind}_{side}_h{h}": x, f"label_fwd_ret_{kind}_{side}_bps_h{h}": x * 1e4}
        cols[f"label_fwd_logret_h{h}"] = ln(div(lead(C(), h), C()))
    return bars.withColumns(cols)


@blocked(_next((3, 5)))
def directional(bars: DataFrame, horizons=(3, 5), thresholds=(5, 25, 100), source: str = "default") -> DataFrame:
    """The return net of fee and slippage (not funding) in bps, and 1 above, -1 below each threshold, else 0. The last rows are 0, not null."""
    fee, slip, _ = COSTS[source]
    out = bars.withColumns({f"_net{h}": div(lead(C(), h), C()) - 1 - fee / 1e4 - slip / 1e4 for h in horizons})
    cols = {f"label_dir_net_ret_bps_h{h}": F.col(f"_net{h}") * 1e4 for h in horizons}
    cols |= {f"label_dir_h{h}_thr{t}bps": F.when(F.col(f"_net{h}") > t / 1e4, 1.0).when(F.col(f"_net{h}") < -t / 1e4, -1.0).otherwise(0.0) for h in horizons for t in thresholds}
    return out.withColumns(cols).drop(*(f"_net{h}" for h in horizons))


#: Quantiles of the rolling forward return.
QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


@blocked(lambda horizons=(10,), window=1000, *_, **__: (window, max(horizons)))
def quantile_bucket(bars: DataFrame, horizons=(10,), window: int = 1000) -> DataFrame:
    """The forward return, its rolling quantiles (of a fifth of the window or 50 rows at least) and its bucket among them.

    2 from the 90 % quantile on, 1 from 75 %, -2 up to 10 %, -1 up to 25 %, in this order; else 0, null without a forward return.
    """
    out, least = bars.withColumns({f"label_fwd_ret_for_quantile_h{h}": div(lead(C(), h), C()) - 1 for h in horizons}), max(50, int(window * 0.2))
    cols = {}
    for h in horizons:
        x = F.col(f"label_fwd_ret_for_quantile_h{h}")
        cols[f"_q{h}"] = F.when(F.count(x).over(back(window)) >= least, F.percentile(x, F.array(*(F.lit(p) for p in QUANTILES))).over(back(window)))
    out, cols = out.withColumns(cols), {}
    for h in horizons:
        x, q = F.col(f"label_fwd_ret_for_quantile_h{h}"), F.col(f"_q{h}")
        cols |= {f"label_fwd_ret_h{h}_rolling_q{round(p * 100)}": q[i] for i, p in enumerate(QUANTILES)}
        cols[f"label_fwd_ret_quantile_bucket_h{h}"] = F.when(x.isNull(), None).when(x >= q[4], 2.0).when(x >= q[3], 1.0).when(x <= q[0], -2.0).when(x <= q[1], -1.0).otherwise(0.0)
    return out.withColumns(cols).drop(*(f"_q{h}" for h in horizons))


@blocked(_next((5, 20)))
def path_extremes(bars: DataFrame, horizons=(5, 20)) -> DataFrame:
    """Best and worst of the path over the next h bars (fewer at the end) for both sides, the close's return and the range."""
    cols = {}
    for h in horizons:
        hi, lo = F.max(H()).over(ahead(1, h)), F.min(L()).over(ahead(1, h))
        own = {"mfe_long": div(hi, C()) - 1, "mae_long": div(lo, C()) - 1, "mfe_short": 1 - div(lo, C()), "mae_short": 1 - div(hi, C())}
        cols |= {f"label_future_{n}_h{h}": x for n, x in own.items()} | {f"label_future_{n}_bps_h{h}": x * 1e4 for n, x in own.items()}
        cols |= {f"label_future_close_ret_bps_h{h}": (div(lead(C(), h), C()) - 1) * 1e4, f"label_future_range_bps_h{h}": (div(hi, lo) - 1) * 1e4}
    return bars.withColumns(cols)


@blocked(lambda horizons=(10,), seconds=3600, window=1000, *_, **__: (window + 1, max(horizons)))
def future_volatility(bars: DataFrame, horizons=(10,), seconds: int = 3600, window: int = 1000) -> DataFrame:
    """Deviation of the next h log returns, by year and in bps, and whether it is above its rolling 75 % (1) and 90 % quantile (2)."""
    out, least = bars.withColumn("_r", ln(C()) - lag(ln(C()))), max(50, int(window * 0.2))
    f = {h: ahead(1, h) for h in horizons}
    out = out.withColumns({f"label_future_rv_h{h}": F.when(F.count("_r").over(w) >= max(2, h // 3), F.stddev_samp("_r").over(w)) for h, w in f.items()})
    cols = {}
    for h in horizons:
        x = F.col(f"label_future_rv_h{h}")
        cols[f"_q{h}"] = F.when(F.count(x).over(back(window)) >= least, F.percentile(x, F.array(F.lit(0.75), F.lit(0.9))).over(back(window)))
    out, cols = out.withColumns(cols), {}
    for h in horizons:
        x, q = F.col(f"label_future_rv_h{h}"), F.col(f"_q{h}")
        cols |= {f"label_future_rv_ann_h{h}": x * math.sqrt(365 * 86400 / seconds), f"label_future_rv_bps_h{h}": x * 1e4, f"label_future_vol_regime_h{h}": F.when(x > q[1], 2.0).when(x > q[0], 1.0).otherwise(0.0)}
    return out.withColumns(cols).drop("_r", *(f"_q{h}" for h in horizons))


@blocked(_next((10,)))
def trend_regime(bars: DataFrame, horizons=(10,), thresholds=(25, 50, 100)) -> DataFrame:
    """The return over h bars in bps, and 1 above, -1 below each threshold, else 0."""
    out = bars.withColumns({f"label_future_trend_ret_bps_h{h}": (div(lead(C(), h), C()) - 1) * 1e4 for h in horizons})
    x = {h: F.col(f"label_future_trend_ret_bps_h{h}") for h in horizons}
    return out.withColumns({f"label_future_trend_regime_h{h}_thr{t}bps": F.when(x[h] > t, 1.0).when(x[h] < -t, -1.0).otherwise(0.0) for h in horizons for t in thresholds})


def barrier_grid(kind: str = "fixed", stops=(50, 100), takes=(50, 100, 200), horizons=(5, 16)) -> list[dict]:
    """Configurations; a fixed take-profit of half the stop or less is left out."""
    return [{"config_id": f"{kind}_sl{s}_tp{t}_h{h}", "stop": s / 1e4 if kind == "fixed" else s, "take": t / 1e4 if kind == "fixed" else t, "horizon": h, "kind": kind} for s in stops for t in takes for h in horizons if kind != "fixed" or t > 0.5 * s]


@blocked(lambda configs, *_, **__: (0, max(c["horizon"] for c in configs)))
def triple_barrier(bars: DataFrame, configs: list[dict], width: str | None = None, floor: float = 0.001) -> DataFrame:
    """First touch in long form: a row per bar, configuration and side.

    Paths are built once per horizon as an array over the rows ahead; what each
    configuration and side touches first is found inside it, and only results
    become rows. The stop comes first within a bar; without a touch the exit is at
    the last bar's close. ``width`` names a column that scales the barriers, else
    they are fractions; either way they are at least ``floor``. Rows without a bar
    ahead or without a width have null labels. Besides the touch: the levels, the
    barriers in bps, and the best and worst of the path as the side sees them.
    """
    keys = ["series_id", "timestamp_utc_ms", *(["_home"] if "_home" in bars.columns else [])]
    parts = []
    for h in sorted({c["horizon"] for c in configs}):
        own = [c for c in configs if c["horizon"] == h]
        unit = F.col(width).cast("double") if width else F.lit(1.0)
        path = bars.select(*keys, "close", unit.alias("_unit"), F.collect_list(F.struct("high", "low", F.col("close").alias("c"), F.col("timestamp_utc_ms").alias("t"))).over(ahead(1, h)).alias("_p"), F.max(H()).over(ahead(1, h)).alias("_hi"), F.min(L()).over(ahead(1, h)).alias("_lo"))
        conf = F.array(*(F.struct(F.lit(c["config_id"]).alias("config_id"), F.lit(float(c["stop"])).alias("stop"), F.lit(float(c["take"])).alias("take"), F.lit(side == "long").alias("long")) for c in own for side in ("long", "short")))
        x = path.withColumn("_c", conf)
        # null stays null: greatest would give the floor
        x = x.withColumn("_c", F.expr(f"transform(_c, k -> named_struct('config_id', k.config_id, 'long', k.long, 'sl', if(_unit is null, null, greatest(k.stop * _unit, {floor}D)), 'tp', if(_unit is null, null, greatest(k.take * _unit, {floor}D))))"))
        x = x.withColumn("_c", F.expr("transform(_c, k -> named_struct('config_id', k.config_id, 'long', k.long, 'sl', k.sl, 'tp', k.tp, 'sl_level', if(k.long, close * (1 - k.sl), close * (1 + k.sl)), 'tp_level', if(k.long, close * (1 + k.tp), close * (1 - k.tp))))"))
        x = x.withColumn("_c", F.expr("transform(_c, k -> named_struct('k', k, 'i', coalesce(array_position(transform(_p, p -> if(k.long, p.low <= k.sl_level, p.high >= k.sl_level)), true), 0), 'j', coalesce(array_position(transform(_p, p -> if(k.long, p.high >= k.tp_level, p.low <= k.tp_level)), true), 0)))"))
        x = x.withColumn("_c", F.expr("transform(_c, z -> named_struct('k', z.k, 'event', case when size(_p) = 0 or _unit is null then '' when z.i > 0 and (z.j = 0 or z.i <= z.j) then 'stop_loss' when z.j > 0 then 'take_profit' else 'time' end, 'bar', cast(case when size(_p) = 0 or _unit is null then null when z.i > 0 and (z.j = 0 or z.i <= z.j) then z.i when z.j > 0 then z.j else size(_p) end as int)))"))
        x = x.withColumn("_c", F.expr("transform(_c, z -> named_struct('z', z, 'last', try_element_at(_p, z.bar)))")).select(*keys, "close", "_hi", "_lo", F.explode("_c").alias("_c"))
        k, event, last = F.col("_c.z.k"), F.col("_c.z.event"), F.col("_c.last")
        price = F.when(event == "stop_loss", k["sl_level"]).when(event == "take_profit", k["tp_level"]).when(event == "time", last["c"])
        ret = F.when(k["long"], div(price, C()) - 1).otherwise(1 - div(price, C()))
        some = F.when(event != "", True)
        up, down = div(F.col("_hi"), C()) - 1, div(F.col("_lo"), C()) - 1
        parts.append(x.select(
            *keys, k["config_id"].alias("config_id"), F.when(k["long"], "long").otherwise("short").alias("side"), F.when(event == "stop_loss", -1.0).when(event == "take_profit", 1.0).when(event == "time", 0.0).alias("label"), event.alias("event"),
            F.col("_c.z.bar").alias("holding_bars"), price.alias("exit_price"), ret.alias("gross_return"), last["t"].alias("exit_timestamp_utc_ms"),
            F.when(some, F.when(k["long"], up).otherwise(-down)).alias("mfe"), F.when(some, F.when(k["long"], down).otherwise(-up)).alias("mae"),
            k["tp_level"].alias("tp_level"), k["sl_level"].alias("sl_level"), (k["tp"] * 1e4).alias("tp_barrier_bps"), (k["sl"] * 1e4).alias("sl_barrier_bps"),
        ))
    return reduce(DataFrame.unionByName, parts)


@blocked(_next((5, 10, 20, 30, 60, 120)))
def risk_reward(bars: DataFrame, horizons=(5, 10, 20, 30, 60, 120), thresholds=(0.75, 1.0, 1.5, 2.0, 3.0)) -> DataFrame:
    """Best rise over deepest fall of the next h bars; no fall gives null, and a null ratio the flag 0."""
    out = bars.withColumns({f"label_future_rr_long_h{h}": div(div(F.max(H()).over(ahead(1, h)), C()) - 1, F.abs(div(F.min(L()).over(ahead(1, h)), C()) - 1)) for h in horizons})
    return out.withColumns({f"label_future_rr_long_h{h}_gt_{str(float(t)).replace('.', '_')}": flag(F.col(f"label_future_rr_long_h{h}") >= t) for h in horizons for t in thresholds})


@blocked(_next((5, 10, 20, 30, 60, 120)))
def tail_events(bars: DataFrame, horizons=(5, 10, 20, 30, 60, 120), thresholds=(50, 100, 150, 250, 500)) -> DataFrame:
    """Greatest rise and fall of the next h bars in bps, and whether they pass each threshold."""
    out = bars.withColumns({f"label_future_tail_{n}_bps_h{h}": (div(x.over(ahead(1, h)), C()) - 1) * 1e4 for h in horizons for n, x in (("up", F.max(H())), ("down", F.min(L())))})
    cols = {}
    for h in horizons:
        for t in thresholds:
            cols |= {f"label_tail_up_h{h}_gt_{t}bps": flag(F.col(f"label_future_tail_up_bps_h{h}") >= t), f"label_tail_down_h{h}_lt_{t}bps": flag(F.col(f"label_future_tail_down_bps_h{h}") <= -t)}
    return out.withColumns(cols)


def full_grid() -> list[dict]:
    """All 462 configurations, with the window of the width that scales them (none: bps)."""
    # Stops, targets, horizons and windows of each kind.
    kinds = (("vol", (20, 50, 100), (0.75, 1.0, 1.5), (1.0, 1.5, 2.0, 3.0), (8, 16, 32, 64, 128)), ("atr", (14, 21, 50), (0.75, 1.0, 1.5), (1.0, 1.5, 2.0), (8, 16, 32, 64)), ("fixed", (0,), (15, 25, 50, 75, 100, 150), (20, 40, 75, 100, 150, 250), (5, 10, 20, 30, 60, 120)))
    return [c | {"window": w, "config_id": f"w{w}_{c['config_id']}" if w else c["config_id"]} for kind, windows, sl, tp, hs in kinds for w in windows for c in barrier_grid(kind, sl, tp, hs)]


def all_barriers(bars: DataFrame, configs: list[dict]) -> DataFrame:
    """``triple_barrier`` of configurations of every kind and window."""
    parts = []
    for kind, window in sorted({(c["kind"], c["window"]) for c in configs}):
        own = [c for c in configs if (c["kind"], c["window"]) == (kind, window)]
        if kind == "fixed":
            parts.append(triple_barrier(bars, own))
        else:
            parts.append(triple_barrier(barrier_width(bars, kind, window), own, "width"))
    return reduce(DataFrame.unionByName, parts)


def meta_labels(touched: DataFrame, configs: list[dict], seconds: int = 3600, source: str = "default") -> DataFrame:
    """Net return (funding over the whole horizon) and whether a touch of the target also pays its costs; null counts as 0."""
    fee, slip, funding = COSTS[source]
    table = F.create_map(*(F.lit(v) for c in configs for v in (c["config_id"], float(c["horizon"]))))
    cost = (F.lit(fee + slip) + table[F.col("config_id")] * (funding * seconds / 86400)) / 1e4
    out = touched.withColumn("net_return", F.col("gross_return") - cost)
    return out.withColumn("meta_success_net", flag((F.col("label") == 1.0) & (F.col("net_return") > 0)))


@blocked(lambda kind="vol", window=20: (window + 1, 0))
def barrier_width(bars: DataFrame, kind: str = "vol", window: int = 20) -> DataFrame:
    """Bars with the column ``width``: rolling volatility, or ATR (first true range: high less low) over close."""
    if kind == "vol":
        return bars.withColumn("_r", ln(C()) - lag(ln(C()))).withColumn("width", roll(F.stddev_samp, F.col("_r"), window)).drop("_r")
    out = bars.withColumn("_tr", F.greatest(H() - L(), F.abs(H() - lag(C())), F.abs(L() - lag(C()))))
    return out.withColumn("width", div(roll(F.avg, F.col("_tr"), window), C())).drop("_tr")


def cross_sectional_rank(labels: DataFrame, column: str) -> DataFrame:
    from pyspark.sql import Window

    return labels.withColumn(f"{column}_rank", F.when(F.col(column).isNotNull(), F.percent_rank().over(Window.partitionBy("timestamp_utc_ms").orderBy(F.col(column)))))


def truncated(bars: DataFrame, rows: int) -> DataFrame:
    """The first rows of each series, for tests of leakage."""
    return bars.withColumn("_n", F.row_number().over(whole())).where(F.col("_n") <= rows).drop("_n")

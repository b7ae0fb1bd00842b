"""SQL of the queries in plain window functions, for comparison on the same tables."""

from __future__ import annotations

import math

LN2 = math.log(2)


def bars_sql(seconds: int = 3600, name: str = "bars") -> str:
    step = seconds * 1_000_000
    return f"""ticks AS (SELECT event_type AS series_id, epoch_us(ts) AS us, value AS p, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) AS vol FROM events WHERE value > 0),
origin AS (SELECT series_id, (min(us) + 14400000000) // 86400000000 * 86400000000 - 14400000000 AS o FROM ticks GROUP BY series_id),
{name} AS (SELECT series_id, (o + (us - o + {step} - 1) // {step} * {step}) // 1000 AS timestamp_utc_ms, arg_min(p, us) AS open, max(p) AS high, min(p) AS low, arg_max(p, us) AS close, CAST(sum(vol) AS DOUBLE) AS volume
FROM ticks JOIN origin USING (series_id) GROUP BY 1, 2)"""


W = "(PARTITION BY series_id ORDER BY timestamp_utc_ms)"


def frame(a: int, b: int) -> str:
    edge = lambda k: "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"(PARTITION BY series_id ORDER BY timestamp_utc_ms ROWS BETWEEN {edge(a)} AND {edge(b)})"


def roll(agg: str, x: str, k: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(1 - k, 0)} = {k} THEN {agg}({x}) OVER {frame(1 - k, 0)} END"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {W}"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER {W}"


def z(x: str, k: int) -> str:
    return div(f"{x} - ({roll('avg', x, k)})", roll("stddev_samp", x, k))


def flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"


PREPARED = f"""a AS (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS lc, CASE WHEN volume > 0 THEN ln(volume) END AS lv, {lag('close')} AS pc FROM bars),
b AS (SELECT *, lc - {lag('lc')} AS r, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, (high + low + close) / 3 AS tp, sign(close - open) * volume AS sv, close * volume AS dv, {div('high', 'low')} - 1 AS rng FROM a),
c AS (SELECT *, CASE WHEN r < 0 THEN r ELSE 0.0 END AS down, {', '.join(f"{lag('r', k)} AS rl{k}" for k in (1, 2))}, {', '.join(f"{roll('stddev_samp', 'r', k)} AS sd{k}" for k in (20, 50))} FROM b)"""


def corr(x: str, y: str, k: int) -> str:
    f = frame(1 - k, 0)
    return f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) OVER {f} = {k} THEN corr({x}, {y}) OVER {f} END"


def family_columns(name: str, w: tuple) -> dict[str, str]:
    out: dict[str, str] = {}
    ann = math.sqrt(365 * 24)
    rg = "nullif(high - low, 0)"
    if name == "returns":
        out = {"feat_log_close": "lc", "feat_ret_simple_1": f"{div('close', 'pc')} - 1"} | {f"feat_ret_log_{k}": f"lc - {lag('lc', k)}" for k in w}
    if name == "return_lags":
        out = {f"feat_ret_log_1_lag_{k}": lag("r", k) for k in w}
    if name == "range_candle":
        out = {"feat_hl_range": f"{div('high', 'low')} - 1", "feat_oc_return": f"{div('close', 'open')} - 1", "feat_body_size_ratio": f"abs(close - open) / {rg}", "feat_upper_wick_ratio": f"(high - greatest(open, close)) / {rg}", "feat_lower_wick_ratio": f"(least(open, close) - low) / {rg}", "feat_close_position_in_range": f"(close - low) / {rg}", "feat_candle_direction": "CAST(sign(close - open) AS DOUBLE)", "feat_body_signed_ratio": f"(close - open) / {rg}"}
    if name == "volume":
        out = {"feat_log_volume": "lv", "feat_log1p_volume": "ln(1 + volume)", "feat_volume_ret_1": f"lv - {lag('lv')}"}
    if name == "atr":
        out = {"feat_true_range": "tr", "feat_true_range_close_ratio": div("tr", "close")}
    if name == "volume_pressure":
        out = {"feat_signed_volume": "sv"}
    if name == "liquidity_proxy":
        out = {"feat_dollar_volume": "dv"}
    if name == "time_context":
        hour, dow = "((timestamp_utc_ms + 14400000) // 3600000 % 24)", "(((timestamp_utc_ms + 14400000) // 86400000 + 3) % 7)"
        out = {"feat_hour_sin": f"sin(2 * pi() * {hour} / 24)", "feat_hour_cos": f"cos(2 * pi() * {hour} / 24)", "feat_dow_sin": f"sin(2 * pi() * {dow} / 7)", "feat_dow_cos": f"cos(2 * pi() * {dow} / 7)", "feat_is_weekend": flag(f"{dow} >= 5")}
    if name == "ml_safety":
        out = {"feat_valid_ohlcv_flag": flag("close > 0 AND high >= low AND open IS NOT NULL AND volume IS NOT NULL"), "feat_zero_volume_flag": flag("volume <= 0")}
    for k in w:
        f = frame(1 - k, 0)
        mean, sd = roll("avg", "close", k), roll("stddev_samp", "close", k)
        hi, lo = roll("max", "close", k), roll("min", "close", k)
        hh, ll = roll("max", "high", k), roll("min", "low", k)
        if name == "rolling_return":
            out |= {f"feat_roll_ret_sum_{k}": roll("sum", "r", k), f"feat_roll_ret_mean_{k}": roll("avg", "r", k)}
        if name == "volatility":
            s = roll("stddev_samp", "r", k)
            out |= {f"feat_rv_std_{k}": s, f"feat_rv_abs_mean_{k}": roll("avg", "abs(r)", k), f"feat_rv_quadratic_{k}": f"sqrt({roll('sum', 'r * r', k)})", f"feat_rv_std_ann_{k}": f"({s}) * {ann}"}
        if name == "sma":
            out |= {f"feat_sma_{k}": mean, f"feat_close_sma_{k}_ratio": f"{div('close', mean)} - 1"}
        if name == "bollinger":
            up, low = f"({mean}) + 2 * ({sd})", f"({mean}) - 2 * ({sd})"
            out |= {f"feat_bb_z_{k}": div(f"close - ({mean})", sd), f"feat_bb_width_{k}": div(f"4 * ({sd})", mean), f"feat_bb_upper_dist_{k}": f"{div('close', up)} - 1", f"feat_bb_lower_dist_{k}": f"{div('close', low)} - 1", f"feat_bb_percent_b_{k}": div(f"close - ({low})", f"4 * ({sd})")}
        if name == "volume":
            out |= {f"feat_volume_z_{k}": z("lv", k), f"feat_volume_ma_ratio_{k}": f"{div('volume', roll('avg', 'volume', k))} - 1", f"feat_absret_volume_corr_{k}": corr("abs(r)", "lv", k)}
        if name == "drawdown_distance":
            out |= {f"feat_dist_roll_max_{k}": f"{div('close', hi)} - 1", f"feat_dist_roll_min_{k}": f"{div('close', lo)} - 1", f"feat_position_roll_range_{k}": div(f"close - ({lo})", f"({hi}) - ({lo})")}
        if name == "trend_strength":
            out[f"feat_trend_strength_{k}"] = div(f"lc - {lag('lc', k)}", f"({roll('stddev_samp', 'r', k)}) * sqrt({k})")
        if name == "autocorrelation":
            out |= {f"feat_ret_autocorr_w{k}_lag{j}": corr("r", f"rl{j}", k) for j in (1, 2)}
        if name == "atr":
            out |= {f"feat_atr_{k}": roll("avg", "tr", k), f"feat_atr_{k}_ratio": div(roll("avg", "tr", k), "close")}
        if name == "range_volatility":
            hl, co = "ln(high / low)", "ln(close / open)"
            gk = f"0.5 * {hl} * {hl} - {2 * LN2 - 1} * {co} * {co}"
            out |= {f"feat_parkinson_vol_{k}": f"sqrt(({roll('avg', f'{hl} * {hl}', k)}) / {4 * LN2})", f"feat_garman_klass_vol_{k}": f"sqrt(CASE WHEN ({roll('avg', gk, k)}) < 0 THEN 0.0 ELSE ({roll('avg', gk, k)}) END)"}
        if name == "donchian":
            out |= {f"feat_donchian_high_dist_{k}": f"{div('close', hh)} - 1", f"feat_donchian_low_dist_{k}": f"{div('close', ll)} - 1", f"feat_donchian_mid_dist_{k}": f"{div('close', f'(({hh}) + ({ll})) / 2')} - 1", f"feat_donchian_width_{k}": div(f"({hh}) - ({ll})", "close")}
        if name == "higher_moments":
            out |= {f"feat_ret_skew_{k}": f"CASE WHEN count(r) OVER {f} = {k} THEN skewness(r) OVER {f} END", f"feat_ret_kurt_{k}": f"CASE WHEN count(r) OVER {f} = {k} THEN kurtosis(r) OVER {f} END"}
        if name == "risk_proxy":
            m = roll("avg", "r", k)
            out |= {f"feat_rolling_sharpe_proxy_{k}": f"{div(m, roll('stddev_samp', 'r', k))} * {ann}", f"feat_rolling_sortino_proxy_{k}": f"{div(m, roll('stddev_samp', 'down', k))} * {ann}"}
            out |= {f"feat_var_q00{q}_{k}": f"CASE WHEN count(r) OVER {f} = {k} THEN quantile_cont(r, 0.0{q}) OVER {f} END" for q in (1, 5)}
        if name == "volume_pressure":
            out |= {f"feat_signed_volume_sum_{k}": roll("sum", "sv", k), f"feat_volume_pressure_{k}": div(roll("sum", "sv", k), roll("sum", "volume", k))}
        if name == "liquidity_proxy":
            out |= {f"feat_dollar_volume_mean_{k}": roll("avg", "dv", k), f"feat_dollar_volume_z_{k}": z("dv", k), f"feat_amihud_illiq_{k}": roll("avg", div("abs(r)", "dv"), k)}
        if name == "shock_features":
            out |= {f"feat_ret_shock_z_{k}": z("r", k), f"feat_range_shock_z_{k}": z("rng", k), f"feat_dollar_volume_shock_z_{k}": z("dv", k), f"feat_large_move_flag_{k}": flag(f"abs({z('r', k)}) >= 2.5")}
        if name == "market_structure":
            g = frame(-k, -1)
            hi, lo = f"CASE WHEN count(high) OVER {g} = {k} THEN max(high) OVER {g} END", f"CASE WHEN count(low) OVER {g} = {k} THEN min(low) OVER {g} END"
            out |= {f"feat_breakout_up_{k}": flag(f"close > ({hi})"), f"feat_breakout_down_{k}": flag(f"close < ({lo})"), f"feat_close_to_prev_high_{k}": f"{div('close', hi)} - 1", f"feat_close_to_prev_low_{k}": f"{div('close', lo)} - 1"}
        if name == "regime":
            out |= {f"feat_efficiency_ratio_{k}": div(f"abs(lc - {lag('lc', k)})", roll("sum", "abs(r)", k)), f"feat_vol_regime_z_{k}": z(f"sd{k}", k), f"feat_vol_of_vol_{k}": roll("stddev_samp", f"sd{k}", k)}
    return out


def family_sql(name: str, w: tuple, digits: int) -> str:
    cols = ", ".join(f"round({v}, {digits}) + 0.0 AS {k}" for k, v in family_columns(name, w).items())
    return f"WITH {bars_sql()}, {PREPARED} SELECT series_id, timestamp_utc_ms, {cols} FROM c"


def oscillators_sql(w: tuple, cci: tuple, digits: int) -> str:
    cols, smooth = {}, {}
    for k in w:
        hh, ll = roll("max", "high", k), roll("min", "low", k)
        cols |= {f"feat_stoch_k_{k}": "100 * " + div(f"close - ({ll})", f"({hh}) - ({ll})"), f"feat_williams_r_{k}": "-100 * " + div(f"({hh}) - close", f"({hh}) - ({ll})")}
        smooth[f"feat_stoch_d_{k}"] = roll("avg", f"feat_stoch_k_{k}", 3)
    # the window's mean can't be named inside a lambda, so lists come first
    lists = ", ".join(f"list(tp) OVER {frame(1 - k, 0)} AS l{k}" for k in cci)
    for k in cci:
        cols[f"feat_cci_{k}"] = f"CASE WHEN len(l{k}) = {k} THEN (tp - m{k}) / nullif(0.015 * list_avg(list_transform(l{k}, lambda x: abs(x - m{k}))), 0) END"
    means = ", ".join(f"list_avg(l{k}) AS m{k}" for k in cci)
    inner = ", ".join(f"{v} AS {n}" for n, v in cols.items())
    final = ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in cols) + ", " + ", ".join(f"round({v}, {digits}) + 0.0 AS {n}" for n, v in smooth.items())
    return f"WITH {bars_sql()}, {PREPARED}, d AS (SELECT *, {lists} FROM c), e AS (SELECT *, {means} FROM d), f AS (SELECT *, {inner} FROM e) SELECT series_id, timestamp_utc_ms, {final} FROM f"


def net_label(h: int, t: float) -> str:
    """1, -1 or 0: the return of h bars less 20 and 15 bps, above t bps, below -t, or else."""
    net = f"({div(lead('close', h), 'close')} - 1 - 0.002 - 0.0015)"
    return f"CASE WHEN {net} > {t / 1e4} THEN 1.0 WHEN {net} < {-t / 1e4} THEN -1.0 ELSE 0.0 END"


def labels_sql(name: str) -> str:
    gross = {h: f"({div(lead('close', h), 'close')} - 1)" for h in (1, 3, 5, 10, 20)}
    cols: dict[str, str] = {}
    if name == "forward_returns":
        for h in (1, 5, 20):
            short = f"(1 - {div(lead('close', h), 'close')})"
            for kind, cost in (("gross", ""), ("net", " - 0.0035")):
                for side, g in (("long", gross[h]), ("short", short)):
                    cols |= {f"label_fwd_ret_{kind}_{side}_h{h}": f"{g}{cost}", f"label_fwd_ret_{kind}_{side}_bps_h{h}": f"({g}{cost}) * 1e4"}
            cols[f"label_fwd_logret_h{h}"] = f"ln({div(lead('close', h), 'close')})"
    if name == "directional":
        for h in (3, 5):
            cols[f"label_dir_net_ret_bps_h{h}"] = f"({gross[h]} - 0.002 - 0.0015) * 1e4"
            cols |= {f"label_dir_h{h}_thr{t}bps": net_label(h, t) for t in (5, 25, 100)}
    if name == "trend_regime":
        cols["label_future_trend_ret_bps_h10"] = f"{gross[10]} * 1e4"
        for t in (25, 50, 100):
            cols[f"label_future_trend_regime_h10_thr{t}bps"] = f"CASE WHEN {gross[10]} * 1e4 > {t} THEN 1.0 WHEN {gross[10]} * 1e4 < -{t} THEN -1.0 ELSE 0.0 END"
    if name == "path_extremes":
        for h in (5, 20):
            hi, lo = f"max(high) OVER {frame(1, h)}", f"min(low) OVER {frame(1, h)}"
            own = {"mfe_long": f"{div(hi, 'close')} - 1", "mae_long": f"{div(lo, 'close')} - 1", "mfe_short": f"1 - {div(lo, 'close')}", "mae_short": f"1 - {div(hi, 'close')}"}
            cols |= {f"label_future_{n}_h{h}": x for n, x in own.items()} | {f"label_future_{n}_bps_h{h}": f"({x}) * 1e4" for n, x in own.items()}
            cols |= {f"label_future_close_ret_bps_h{h}": f"{gross[h]} * 1e4", f"label_future_range_bps_h{h}": f"({div(hi, lo)} - 1) * 1e4"}
    if name == "quantile_bucket":
        f = frame(-999, 0)
        at = {p: f"CASE WHEN count(f) OVER {f} >= 200 THEN quantile_cont(f, {p}) OVER {f} END" for p in (0.1, 0.25, 0.5, 0.75, 0.9)}
        qs = ", ".join(f"{x} AS q{round(100 * p)}" for p, x in at.items())
        shown = ", ".join(f"round(q{round(100 * p)}, 6) + 0.0 AS label_fwd_ret_h10_rolling_q{round(100 * p)}" for p in at)
        return f"""WITH {bars_sql()}, a AS (SELECT *, {gross[10]} AS f FROM bars), b AS (SELECT *, {qs} FROM a)
SELECT series_id, timestamp_utc_ms, round(f, 6) + 0.0 AS label_fwd_ret_for_quantile_h10, {shown}, CASE WHEN f IS NULL THEN NULL WHEN f >= q90 THEN 2.0 WHEN f >= q75 AND f < q90 THEN 1.0 WHEN f > q10 AND f <= q25 THEN -1.0 WHEN f <= q10 THEN -2.0 ELSE 0.0 END AS label_fwd_ret_quantile_bucket_h10 FROM b"""
    if name == "future_volatility":
        f, g = frame(1, 10), frame(-999, 0)
        above = lambda p: f"count(v) OVER {g} >= 200 AND v > quantile_cont(v, {p}) OVER {g}"
        return f"""WITH {bars_sql()}, a AS (SELECT *, ln(close) - {lag('ln(close)')} AS r FROM bars), b AS (SELECT *, CASE WHEN count(r) OVER {f} >= 3 THEN stddev_samp(r) OVER {f} END AS v FROM a)
SELECT series_id, timestamp_utc_ms, round(v, 6) + 0.0 AS label_future_rv_h10, round(v * {math.sqrt(365 * 24)}, 6) + 0.0 AS label_future_rv_ann_h10, round(v * 1e4, 6) + 0.0 AS label_future_rv_bps_h10, CASE WHEN {above(0.9)} THEN 2.0 WHEN {above(0.75)} THEN 1.0 ELSE 0.0 END AS label_future_vol_regime_h10 FROM b"""
    final = ", ".join(f"round({v}, 6) + 0.0 AS {k}" for k, v in cols.items())
    return f"WITH {bars_sql()} SELECT series_id, timestamp_utc_ms, {final} FROM bars"


def barrier_sql(configs: list[dict], width: str = "CAST(1 AS DOUBLE)", floor: float = 0.001) -> str:
    """Every bar, configuration and side against its bars ahead; ``width`` is an expression over bars, null before it is known."""
    values = ", ".join(f"('{c['config_id']}', CAST({c['stop']} AS DOUBLE), CAST({c['take']} AS DOUBLE), {c['horizon']}, '{s}')" for c in configs for s in ("long", "short"))
    wide = lambda x: f"CASE WHEN width IS NULL THEN NULL WHEN {x} * width < {floor} THEN {floor} ELSE {x} * width END"
    return f"""WITH {bars_sql()}, tr AS (SELECT *, greatest(high - low, coalesce(abs(high - {lag('close')}), 0), coalesce(abs(low - {lag('close')}), 0)) AS tr FROM bars),
n AS (SELECT *, row_number() OVER {W} AS k, {width} AS width FROM tr), g(config_id, stop, take, h, side) AS (VALUES {values}),
y AS (SELECT n.series_id, n.timestamp_utc_ms, n.k, n.close, n.width, g.config_id, g.h, g.side, {wide('stop')} AS stop, {wide('take')} AS take FROM n, g),
x AS (SELECT *, CASE side WHEN 'long' THEN close * (1 - stop) ELSE close * (1 + stop) END AS sl, CASE side WHEN 'long' THEN close * (1 + take) ELSE close * (1 - take) END AS tp FROM y),
j AS (SELECT x.series_id, x.timestamp_utc_ms, x.close, config_id, side, stop, take, sl, tp, CASE WHEN any_value(x.width) IS NOT NULL THEN max(p.k) - x.k END AS len, min(CASE WHEN (side = 'long' AND p.low <= sl) OR (side = 'short' AND p.high >= sl) THEN p.k - x.k END) AS i, min(CASE WHEN (side = 'long' AND p.high >= tp) OR (side = 'short' AND p.low <= tp) THEN p.k - x.k END) AS t, arg_max(p.close, p.k) AS lastc, max(p.high) / x.close - 1 AS up, min(p.low) / x.close - 1 AS down, x.k FROM x LEFT JOIN n p ON p.series_id = x.series_id AND p.k > x.k AND p.k <= x.k + x.h GROUP BY x.series_id, x.timestamp_utc_ms, x.close, config_id, side, stop, take, sl, tp, x.k),
r AS (SELECT *, CASE WHEN len IS NULL THEN '' WHEN i IS NOT NULL AND (t IS NULL OR i <= t) THEN 'stop_loss' WHEN t IS NOT NULL THEN 'take_profit' ELSE 'time' END AS event FROM j),
e AS (SELECT *, CASE event WHEN '' THEN NULL WHEN 'stop_loss' THEN sl WHEN 'take_profit' THEN tp ELSE lastc END AS px, CASE event WHEN 'stop_loss' THEN i WHEN 'take_profit' THEN t WHEN 'time' THEN len END AS hold FROM r)
SELECT e.series_id, e.timestamp_utc_ms, config_id, side, CASE event WHEN '' THEN NULL WHEN 'stop_loss' THEN -1.0 WHEN 'take_profit' THEN 1.0 ELSE 0.0 END AS label, event, CAST(hold AS INTEGER) AS holding_bars, round(px, 6) AS exit_price, round(CASE side WHEN 'long' THEN px / e.close - 1 ELSE 1 - px / e.close END, 6) + 0.0 AS gross_return, p.timestamp_utc_ms AS exit_timestamp_utc_ms,
round(CASE WHEN event = '' THEN NULL WHEN side = 'long' THEN up ELSE -down END, 6) + 0.0 AS mfe, round(CASE WHEN event = '' THEN NULL WHEN side = 'long' THEN down ELSE -up END, 6) + 0.0 AS mae, round(tp, 6) + 0.0 AS tp_level, round(sl, 6) + 0.0 AS sl_level, round(take * 1e4, 6) + 0.0 AS tp_barrier_bps, round(stop * 1e4, 6) + 0.0 AS sl_barrier_bps FROM e LEFT JOIN n p ON p.series_id = e.series_id AND p.k = e.k + e.hold"""

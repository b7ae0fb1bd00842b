"""Feature families: a registry of column builders over bars.

Families are added in at most two selects over one sort per series, as all
frames share partition and order. Exponential averages recurse over the order
and run as a grouped map.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import blocked
from ..functions.rolling import ahead, back, div, flag, lag, ln, roll

def _column(name: str):
    return lambda: F.col(name)  # made when it is used, as columns need a session


O, H, L, C, V = map(_column, ("open", "high", "low", "close", "volume"))  # noqa: E741
R, LC = _column("_r"), _column("_lc")
FAMILIES: dict = {}


def family(*windows):
    def add(f):
        FAMILIES[f.__name__] = (f, windows)
        return f

    return add


def prepared(bars: DataFrame) -> DataFrame:
    """Columns that several families share."""
    out = bars.withColumn("_lc", ln(C())).withColumn("_r", LC() - lag(LC())).withColumn("_lv", ln(V()))
    tr = F.when(lag(C()).isNotNull(), F.greatest(H() - L(), F.abs(H() - lag(C())), F.abs(L() - lag(C()))))
    return out.withColumns({"_tr": tr, "_tp": (H() + L() + C()) / 3, "_sv": F.signum(C() - O()) * V(), "_dv": C() * V(), "_down": F.when(R() < 0, R()).otherwise(0.0), "_rl1": lag(R()), "_range": div(H(), L()) - 1})


def _z(x: Column, n: int) -> Column:
    sd = roll(F.stddev_samp, x, n)
    return div(x - roll(F.avg, x, n), F.when(sd != 0, sd))


@family(1, 2, 3, 5, 7, 11, 15, 27, 41, 77, 137)
def returns(w):
    return {"feat_log_close": LC(), "feat_ret_simple_1": div(C(), lag(C())) - 1} | {f"feat_ret_log_{k}": LC() - lag(LC(), k) for k in w}


@family(1, 2, 3, 5, 10, 20)
def return_lags(w):
    return {f"feat_ret_log_1_lag_{k}": lag(R(), k) for k in w}


@family(3, 5, 7, 11, 15, 27, 41, 77, 137)
def rolling_return(w):
    return {f"feat_roll_ret_{n}_{k}": roll(a, R(), k) for k in w for n, a in (("sum", F.sum), ("mean", F.avg))}


@family(5, 7, 11, 15, 27, 41, 77, 137)
def volatility(w, seconds: int = 3600):
    ann = math.sqrt(365 * 86400 / seconds)
    out = {}
    for k in w:
        sd = roll(F.stddev_samp, R(), k)
        out |= {f"feat_rv_std_{k}": sd, f"feat_rv_abs_mean_{k}": roll(F.avg, F.abs(R()), k), f"feat_rv_quadratic_{k}": F.sqrt(roll(F.sum, R() * R(), k)), f"feat_rv_std_ann_{k}": sd * ann}
    return out


@family(3, 5, 7, 11, 15, 27, 41, 77, 137)
def sma(w):
    return {k2: v for k in w for k2, v in ((f"feat_sma_{k}", roll(F.avg, C(), k)), (f"feat_close_sma_{k}_ratio", div(C(), roll(F.avg, C(), k)) - 1))}


@family(20, 50, 100)
def bollinger(w):
    out = {}
    for k in w:
        m, s = roll(F.avg, C(), k), roll(F.stddev_samp, C(), k)
        up, low = m + 2 * s, m - 2 * s
        out |= {f"feat_bb_z_{k}": div(C() - m, s), f"feat_bb_width_{k}": div(up - low, m), f"feat_bb_upper_dist_{k}": div(C(), up) - 1, f"feat_bb_lower_dist_{k}": div(C(), low) - 1, f"feat_bb_percent_b_{k}": div(C() - low, up - low)}
    return out


@family()
def range_candle(w):
    rng = F.when(H() - L() != 0, H() - L())
    return {"feat_hl_range": div(H(), L()) - 1, "feat_oc_return": div(C(), O()) - 1, "feat_body_size_ratio": div(F.abs(C() - O()), rng), "feat_upper_wick_ratio": div(H() - F.greatest(O(), C()), rng), "feat_lower_wick_ratio": div(F.least(O(), C()) - L(), rng), "feat_close_position_in_range": div(C() - L(), rng), "feat_candle_direction": F.signum(C() - O()), "feat_body_signed_ratio": div(C() - O(), rng)}


@family(5, 10, 20, 50, 100, 200)
def volume(w):
    lv, ar = F.col("_lv"), F.abs(R())
    out = {"feat_log_volume": lv, "feat_log1p_volume": F.log1p(V()), "feat_volume_ret_1": lv - lag(lv)}
    for k in w:
        both = F.when(ar.isNotNull() & lv.isNotNull(), 1)
        corr = F.when(F.count(both).over(back(k)) == k, F.corr(ar, lv).over(back(k)))
        out |= {f"feat_volume_z_{k}": _z(lv, k), f"feat_volume_ma_ratio_{k}": div(V(), roll(F.avg, V(), k)) - 1, f"feat_absret_volume_corr_{k}": corr}
    return out


@family(20, 50, 100, 200, 288)
def drawdown_distance(w):
    out = {}
    for k in w:
        hi, lo = roll(F.max, C(), k), roll(F.min, C(), k)
        out |= {f"feat_dist_roll_max_{k}": div(C(), hi) - 1, f"feat_dist_roll_min_{k}": div(C(), lo) - 1, f"feat_position_roll_range_{k}": div(C() - lo, hi - lo)}
    return out


@family(10, 20, 50, 100, 200)
def trend_strength(w):
    return {f"feat_trend_strength_{k}": div(LC() - lag(LC(), k), roll(F.stddev_samp, R(), k) * math.sqrt(k)) for k in w}


@family(20, 50, 100)
def autocorrelation(w, lags=(1, 2, 3, 5)):
    out = {}
    for k in w:
        for j in lags:
            x = F.col(f"_rl{j}")
            both = F.when(R().isNotNull() & x.isNotNull(), 1)
            out[f"feat_ret_autocorr_w{k}_lag{j}"] = F.when(F.count(both).over(back(k)) == k, F.corr(R(), x).over(back(k)))
    return out


@family(7, 14, 21, 50)
def atr(w):
    tr = F.col("_tr")
    return {"feat_true_range": tr, "feat_true_range_close_ratio": div(tr, C())} | {n: v for k in w for n, v in ((f"feat_atr_{k}", roll(F.avg, tr, k)), (f"feat_atr_{k}_ratio", div(roll(F.avg, tr, k), C())))}


@family(5, 10, 20, 50, 100)
def range_volatility(w):
    hl, co = F.ln(div(H(), L())), F.ln(div(C(), O()))
    gk = 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co
    return {n: v for k in w for n, v in ((f"feat_parkinson_vol_{k}", F.sqrt(roll(F.avg, hl * hl, k) / (4 * math.log(2)))), (f"feat_garman_klass_vol_{k}", F.sqrt(F.when(roll(F.avg, gk, k) < 0, 0.0).otherwise(roll(F.avg, gk, k)))))}


@family(20, 50, 100)
def donchian(w):
    out = {}
    for k in w:
        hi, lo = roll(F.max, H(), k), roll(F.min, L(), k)
        out |= {f"feat_donchian_high_dist_{k}": div(C(), hi) - 1, f"feat_donchian_low_dist_{k}": div(C(), lo) - 1, f"feat_donchian_mid_dist_{k}": div(C(), (hi + lo) / 2) - 1, f"feat_donchian_width_{k}": div(hi - lo, C())}
    return out


def _mad(window: Column, mean: Column) -> Column:
    return F.aggregate(window, F.lit(0.0), lambda a, x: a + F.abs(x - mean))


@family(14, 21, 50)
def oscillators(w, cci=(20, 50)):
    out = {}
    for k in w:
        hi, lo = roll(F.max, H(), k), roll(F.min, L(), k)
        out |= {f"feat_stoch_k_{k}": 100 * div(C() - lo, hi - lo), f"feat_williams_r_{k}": -100 * div(hi - C(), hi - lo)}
    tp = F.col("_tp")
    for k in cci:
        m = roll(F.avg, tp, k)
        window = F.collect_list(tp).over(back(k))
        mad = _mad(window, m) / k
        out[f"feat_cci_{k}"] = F.when(F.count(tp).over(back(k)) == k, div(tp - m, 0.015 * mad))
    return out


@family(20, 50, 100, 200)
def higher_moments(w):
    out = {}
    for k in w:
        full = F.count(R()).over(back(k)) == k
        g1, g2 = F.skewness(R()).over(back(k)), F.kurtosis(R()).over(back(k))
        out |= {f"feat_ret_skew_{k}": F.when(full, g1 * (math.sqrt(k * (k - 1)) / (k - 2))), f"feat_ret_kurt_{k}": F.when(full, ((k + 1) * g2 + 6) * ((k - 1) / ((k - 2) * (k - 3))))}
    return out


@family(20, 50, 100, 200)
def risk_proxy(w, seconds: int = 3600):
    ann, down = math.sqrt(365 * 86400 / seconds), F.col("_down")
    out = {}
    for k in w:
        m, full = roll(F.avg, R(), k), F.count(R()).over(back(k)) == k
        out |= {f"feat_rolling_sharpe_proxy_{k}": div(m, roll(F.stddev_samp, R(), k)) * ann, f"feat_rolling_sortino_proxy_{k}": div(m, roll(F.stddev_samp, down, k)) * ann}
        q = F.percentile(R(), F.array(F.lit(0.01), F.lit(0.05))).over(back(k))
        out |= {f"feat_var_q001_{k}": F.when(full, q[0]), f"feat_var_q005_{k}": F.when(full, q[1])}
    return out


@family(10, 20, 50, 100)
def volume_pressure(w):
    sv = F.col("_sv")
    return {"feat_signed_volume": sv} | {n: v for k in w for n, v in ((f"feat_signed_volume_sum_{k}", roll(F.sum, sv, k)), (f"feat_volume_pressure_{k}", div(roll(F.sum, sv, k), roll(F.sum, V(), k))))}


@family(10, 20, 50, 100)
def liquidity_proxy(w):
    dv = F.col("_dv")
    out = {"feat_dollar_volume": dv}
    for k in w:
        out |= {f"feat_dollar_volume_mean_{k}": roll(F.avg, dv, k), f"feat_dollar_volume_z_{k}": _z(dv, k), f"feat_amihud_illiq_{k}": roll(F.avg, div(F.abs(R()), dv), k)}
    return out


@family(20, 50, 100)
def shock_features(w):
    out = {}
    for k in w:
        z = _z(R(), k)
        out |= {f"feat_ret_shock_z_{k}": z, f"feat_range_shock_z_{k}": _z(F.col("_range"), k), f"feat_dollar_volume_shock_z_{k}": _z(F.col("_dv"), k), f"feat_large_move_flag_{k}": flag(F.abs(z) >= 2.5)}
    return out


@family(20, 50, 100)
def market_structure(w):
    out = {}
    for k in w:
        f = ahead(-k, -1)
        hi, lo = F.when(F.count(H()).over(f) == k, F.max(H()).over(f)), F.when(F.count(L()).over(f) == k, F.min(L()).over(f))
        out |= {f"feat_breakout_up_{k}": flag(C() > hi), f"feat_breakout_down_{k}": flag(C() < lo), f"feat_close_to_prev_high_{k}": div(C(), hi) - 1, f"feat_close_to_prev_low_{k}": div(C(), lo) - 1}
    return out


@family()
def time_context(w):
    hour = F.expr("(timestamp_utc_ms + 14400000) div 3600000 % 24")
    dow = F.expr("((timestamp_utc_ms + 14400000) div 86400000 + 3) % 7")
    return {"feat_hour_sin": F.sin(2 * math.pi * hour / 24), "feat_hour_cos": F.cos(2 * math.pi * hour / 24), "feat_dow_sin": F.sin(2 * math.pi * dow / 7), "feat_dow_cos": F.cos(2 * math.pi * dow / 7), "feat_is_weekend": flag(dow >= 5)}


@family()
def ml_safety(w):
    whole_row = O().isNotNull() & H().isNotNull() & L().isNotNull() & C().isNotNull() & V().isNotNull()
    return {"feat_valid_ohlcv_flag": flag(whole_row & (C() > 0) & (H() >= L())), "feat_zero_volume_flag": flag(V() <= 0)}


@family(20, 50, 100, 200)
def regime(w):
    """Second-level families: the columns _sd{k} are windows themselves."""
    out = {}
    for k in w:
        out |= {f"feat_efficiency_ratio_{k}": div(F.abs(LC() - lag(LC(), k)), roll(F.sum, F.abs(R()), k)), f"feat_vol_regime_z_{k}": _z(F.col(f"_sd{k}"), k), f"feat_vol_of_vol_{k}": roll(F.stddev_samp, F.col(f"_sd{k}"), k)}
    return out


def _chosen(families: dict | list | None) -> dict:
    return families if isinstance(families, dict) else {n: FAMILIES[n][1] for n in (families or FAMILIES)}


def look_back(families: dict | list | None = None) -> int:
    """Rows behind that the families' frames reach at most: a window over a window, lags and the return before."""
    return 2 * max([k for w in _chosen(families).values() for k in w] + [50]) + 10


@blocked(lambda families=None: (look_back(families), 0))
def features(bars: DataFrame, families: dict | list | None = None) -> DataFrame:
    """Bars with the columns of the families: all by default, with their own windows unless given."""
    chosen = _chosen(families)
    rows = prepared(bars)
    extra = {}
    if "autocorrelation" in chosen:
        extra |= {f"_rl{j}": lag(R(), j) for j in (1, 2, 3, 5)}
    if "regime" in chosen:
        extra |= {f"_sd{k}": roll(F.stddev_samp, R(), k) for k in chosen["regime"]}
    rows = rows.withColumns(extra) if extra else rows
    columns = {}
    for name, windows in chosen.items():
        columns |= FAMILIES[name][0](windows)
    out = rows.select(*bars.columns, *[v.alias(k) for k, v in columns.items()])
    if "oscillators" in chosen:  # %D smooths %K, a window over a window
        out = out.withColumns({f"feat_stoch_d_{k}": roll(F.avg, F.col(f"feat_stoch_k_{k}"), 3) for k in chosen["oscillators"]})
    return out


def ewm_features(bars: DataFrame, spans=(3, 5, 7, 11, 15, 27, 41, 77, 137), rsi=(7, 14, 21, 30)) -> DataFrame:
    """EMA, RSI and MACD; each value needs the one before, so a series runs in order in one task."""
    names = [f"feat_ema_{k}" for k in spans] + [f"feat_close_ema_{k}_ratio" for k in spans] + ["feat_ema_3_5_spread"] * ({3, 5} <= set(spans)) + [n for k in rsi for n in (f"feat_rsi_{k}", f"feat_rsi_{k}_norm")] + ["feat_macd", "feat_macd_signal", "feat_macd_hist", "feat_macd_close_ratio", "feat_macd_hist_close_ratio"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp_utc_ms", ignore_index=True)
        c = pdf["close"]
        out = pdf[["series_id", "timestamp_utc_ms"]].copy()
        for k in spans:
            out[f"feat_ema_{k}"] = c.ewm(span=k, adjust=False, min_periods=max(2, k // 2)).mean()
            out[f"feat_close_ema_{k}_ratio"] = c / out[f"feat_ema_{k}"] - 1
        if {3, 5} <= set(spans):
            out["feat_ema_3_5_spread"] = out["feat_ema_3"] / out["feat_ema_5"] - 1
        d = c.diff()
        for k in rsi:
            up, down = (x.ewm(alpha=1 / k, adjust=False, min_periods=k).mean() for x in (d.clip(lower=0), -d.clip(upper=0)))
            out[f"feat_rsi_{k}"] = 100 - 100 / (1 + up / down.where(down != 0))
            out[f"feat_rsi_{k}_norm"] = (out[f"feat_rsi_{k}"] - 50) / 50
        macd = c.ewm(span=12, adjust=False, min_periods=12).mean() - c.ewm(span=26, adjust=False, min_periods=26).mean()
        out["feat_macd"], out["feat_macd_signal"] = macd, macd.ewm(span=9, adjust=False, min_periods=9).mean()
        out["feat_macd_hist"] = out["feat_macd"] - out["feat_macd_signal"]
        for name in ("feat_macd", "feat_macd_hist"):
            out[f"{name}_close_ratio"] = out[name] / c.where(c != 0)
        return out[["series_id", "timestamp_utc_ms", *names]]

    schema = "series_id string, timestamp_utc_ms long, " + ", ".join(f"{n} double" for n in names)
    return bars.select("series_id", "timestamp_utc_ms", "close").groupBy("series_id").applyInPandas(run, schema)

"""The queries of the engine over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blocks import in_blocks
from ..operators import features as feat
from ..operators import labels as lab
from ..sources import bars as src
from . import extra, more, oracle, research

#: Windows and digits of each family's query.
FAMILY_QUERIES = {
    "returns": ((1, 5, 27), 6), "return_lags": ((1, 3, 10), 6), "rolling_return": ((3, 15), 6), "volatility": ((7, 41), 6), "sma": ((7, 41), 6), "bollinger": ((20,), 6),
    "range_candle": ((), 6), "volume": ((10, 50), 6), "drawdown_distance": ((20, 100), 6), "trend_strength": ((10, 50), 6), "atr": ((7, 21), 6), "range_volatility": ((10, 50), 6),
    "donchian": ((20, 50), 6), "higher_moments": ((20, 50), 5), "risk_proxy": ((20, 50), 5), "volume_pressure": ((10, 50), 5), "liquidity_proxy": ((10, 50), 4),
    "shock_features": ((20, 50), 5), "market_structure": ((20, 50), 6), "time_context": ((), 6), "ml_safety": ((), 6), "regime": ((20, 50), 5),
}
KEYS = ("series_id", "timestamp_utc_ms")


def rounded(df: DataFrame, digits: int = 6, keys=KEYS) -> DataFrame:
    cols = [F.col(c) if c in keys else (F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(*cols)


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*KEYS, *[c for c in df.columns if c.startswith(prefix)])


def _family(name: str, windows: tuple, digits: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(_named(feat.features(src.bars(spark, sf_dir), {name: windows}), "feat_"), digits)

    return run


def _autocorrelation(spark, sf_dir):
    out = _named(feat.features(src.bars(spark, sf_dir), {"autocorrelation": (20,)}), "feat_")
    return rounded(out.drop("feat_ret_autocorr_w20_lag3", "feat_ret_autocorr_w20_lag5"), 5)


def _oscillators(spark, sf_dir):
    return rounded(_named(feat.features(src.bars(spark, sf_dir), {"oscillators": (14,)}).drop("feat_cci_50"), "feat_"), 5)


def _labels(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(_named(getattr(lab, name)(src.bars(spark, sf_dir)), "label_"))

    return run


def _bars(seconds: int):
    def run(spark, sf_dir):
        return rounded(src.bars(spark, sf_dir, seconds))

    return run


def _barriers(spark, sf_dir):
    return rounded(lab.triple_barrier(src.bars(spark, sf_dir), lab.barrier_grid()), keys=("label",))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars, features, labels and a summary per series."""
    families = {"returns": (1,), "volatility": (7,), "sma": (7,)}
    both = lambda b: lab.directional(lab.forward_returns(feat.features(b, families), (5,)), (5,), (25,))
    rows = in_blocks(src.bars(spark, sf_dir), both, feat.look_back(families), 5)
    net = F.col("label_fwd_ret_net_long_bps_h5")
    out = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label_dir_h5_thr25bps") == 1.0).cast("int")).alias("hit_rate"), F.avg(net).alias("mean_net_bps"), F.avg("feat_rv_std_7").alias("mean_rv_7"), F.avg("feat_close_sma_7_ratio").alias("mean_sma_ratio"))
    return rounded(out, 4)


def queries() -> dict:
    out = {"flagship": flagship}
    out |= {f"bars_{n}": _bars(s) for n, s in (("15m", 900), ("1h", 3600), ("4h", 14400), ("7min", 420), ("3d", 259200))}
    out |= {f"feat_{n}": _family(n, *v) for n, v in FAMILY_QUERIES.items()}
    out |= {"feat_autocorrelation": _autocorrelation, "feat_oscillators": _oscillators, "feat_ewm": lambda s, d: rounded(feat.ewm_features(src.bars(s, d)))}
    out |= {f"label_{n}": _labels(n) for n in ("forward_returns", "directional", "quantile_bucket", "path_extremes", "future_volatility", "trend_regime")}
    return out | {"label_triple_barrier": _barriers} | research.queries() | extra.queries() | more.queries()


def oracle_sql() -> dict[str, str]:
    cols = "series_id, timestamp_utc_ms, round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume"
    out = {f"bars_{n}": f"WITH {oracle.bars_sql(s)} SELECT {cols} FROM bars" for n, s in (("15m", 900), ("1h", 3600), ("4h", 14400), ("7min", 420), ("3d", 259200))}
    out |= {f"feat_{n}": oracle.family_sql(n, *v) for n, v in FAMILY_QUERIES.items()}
    out["feat_autocorrelation"] = oracle.family_sql("autocorrelation", (20,), 5)
    out["feat_oscillators"] = oracle.oscillators_sql((14,), (20,), 5)
    out |= {f"label_{n}": oracle.labels_sql(n) for n in ("forward_returns", "directional", "quantile_bucket", "path_extremes", "future_volatility", "trend_regime")}
    out["label_triple_barrier"] = oracle.barrier_sql(lab.barrier_grid())
    f = oracle
    gross = f"({f.div(f.lead('close', 5), 'close')} - 1)"
    out["flagship"] = f"""WITH {f.bars_sql()}, {f.PREPARED}, d AS (SELECT *, {f.roll('stddev_samp', 'r', 7)} AS rv, {f.div('close', f.roll('avg', 'close', 7))} - 1 AS sr, ({gross} - 0.0035) * 1e4 AS net, CASE WHEN {gross} - 0.002 - 0.0015 > 0.0025 THEN 1 ELSE 0 END AS hit FROM c)
SELECT series_id, count(*) AS n, round(avg(hit), 4) + 0.0 AS hit_rate, round(avg(net), 4) + 0.0 AS mean_net_bps, round(avg(rv), 4) + 0.0 AS mean_rv_7, round(avg(sr), 4) + 0.0 AS mean_sma_ratio FROM d GROUP BY series_id"""
    return out | research.oracle_sql() | extra.oracle_sql() | more.oracle_sql()

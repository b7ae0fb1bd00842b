"""Labels, windows, training and search against values by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, dataset, features, labels, portfolio, quality

COLS = "series_id string, timestamp_utc_ms long, open double, high double, low double, close double, volume double"


def bars(spark, closes, high=1.0, low=1.0):
    return spark.createDataFrame([("s", k, c, c * high, c * low, c, 1.0) for k, c in enumerate(map(float, closes))], COLS)


def column(df, name):
    return [r[0] for r in df.orderBy("timestamp_utc_ms").select(name).collect()]


def test_directional_is_one_net_return(spark):
    # up 60 bps: 25 net of 35; down 30 bps: -65 net, as a short pays nothing extra
    df = labels.directional(bars(spark, [10000, 10060, 10060 * 0.997]), (1,), (20, 25, 65))
    assert column(df, "label_dir_h1_thr20bps") == [1.0, -1.0, 0.0]
    assert column(df, "label_dir_h1_thr65bps")[0] == 0.0
    assert [round(x, 6) if x is not None else None for x in column(df, "label_dir_net_ret_bps_h1")] == [25.0, -65.0, None]


def test_quantile_buckets_at_their_edges(spark):
    flat = labels.quantile_bucket(bars(spark, [100.0] * 80), (1,), 60)
    got = column(flat, "label_fwd_ret_quantile_bucket_h1")
    assert got[:49] == [0.0] * 49 and got[49:79] == [2.0] * 30 and got[79] is None  # equal to all quantiles: the highest counts
    r = np.random.default_rng(0).normal(0, 0.01, 300)
    prices = 100 * np.cumprod(1 + r)
    df = labels.quantile_bucket(bars(spark, prices), (1,), 100)
    f = prices[1:] / prices[:-1] - 1
    for k in (60, 150, 298):
        q = np.quantile(f[max(0, k - 99) : k + 1], [0.1, 0.25, 0.75, 0.9])
        want = 2.0 if f[k] >= q[3] else 1.0 if f[k] >= q[2] else -2.0 if f[k] <= q[0] else -1.0 if f[k] <= q[1] else 0.0
        assert column(df, "label_fwd_ret_quantile_bucket_h1")[k] == want


def test_range_regimes_and_trend_are_strict(spark):
    x = labels.path_extremes(bars(spark, [100, 100, 100], 1.1, 0.9), (1,))
    assert column(x, "label_future_range_bps_h1")[0] == pytest.approx((110 / 90 - 1) * 1e4)
    flat = labels.future_volatility(bars(spark, [100.0] * 120), (3,), window=60)
    assert set(column(flat, "label_future_vol_regime_h3")) == {0.0}  # not above its own quantiles
    t = labels.trend_regime(bars(spark, [1000, 1002.5, 1002.5 * 1.0026]), (1,), (25,))
    assert column(t, "label_future_trend_regime_h1_thr25bps")[1:] == [1.0, 0.0]


def test_barriers_have_a_floor_after_the_multiplier_and_none_without_a_width(spark):
    df = bars(spark, [100, 100.05, 100.2, 100.2]).withColumn("w", F.when(F.col("timestamp_utc_ms") > 0, 0.0004))
    got = {(r.side, r.timestamp_utc_ms): r for r in labels.triple_barrier(df, [{"config_id": "c", "stop": 1.0, "take": 2.0, "horizon": 2}], "w").collect()}
    assert got["long", 0].label is None and got["long", 0].event == "" and got["long", 0].tp_level is None
    one = got["long", 1]
    assert one.tp_barrier_bps == pytest.approx(10.0) and one.sl_barrier_bps == pytest.approx(10.0)  # 8 and 4 without the floor
    assert one.event == "take_profit" and one.exit_price == pytest.approx(100.05 * 1.001) and one.holding_bars == 1
    assert one.mfe == pytest.approx(100.2 / 100.05 - 1) and got["short", 1].mae == pytest.approx(1 - 100.2 / 100.05)
    fixed = labels.triple_barrier(df, [{"config_id": "c", "stop": 0.0005, "take": 0.0005, "horizon": 1}]).where("side = 'long'")
    assert {round(r.tp_barrier_bps, 6) for r in fixed.collect()} == {10.0}


def test_blocks_give_the_same_features_and_labels(spark):
    r = np.random.default_rng(1)
    df = bars(spark, 100 * np.cumprod(1 + r.normal(0, 0.01, 400)), 1.01, 0.99)
    families = {"returns": (1, 5), "volatility": (7,), "regime": (20,), "oscillators": (14,), "autocorrelation": (20,), "market_structure": (20,)}
    for f in (lambda b, n: features.features(b, families, block_rows=n), lambda b, n: labels.future_volatility(b, (5,), window=50, block_rows=n), lambda b, n: labels.quantile_bucket(b, (5,), 50, block_rows=n), lambda b, n: labels.triple_barrier(b, labels.barrier_grid(horizons=(5,)), block_rows=n)):
        whole, parts = f(df, None), f(df, 60)
        keys = [c for c in ("series_id", "timestamp_utc_ms", "config_id", "side") if c in whole.columns]
        a, b = (x.toPandas().sort_values(keys, ignore_index=True)[whole.columns] for x in (whole, parts))
        assert len(a) == len(b)
        for c in whole.columns:
            same = np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True) if a[c].dtype.kind == "f" else a[c].equals(b[c])
            assert same, c


def test_outliers_are_simple_returns_above_half(spark):
    got = quality.audit(bars(spark, [100, 149, 75, 37, 18.4, 18.4]), 1).first()  # +49 %, -49.7 %, -50.7 %, -50.3 %
    assert got.return_outlier_count == 2


def windows_by_hand(n, train, test, step):
    out, start = [], 0
    while True:
        end = min(start + train + test, n)
        if end - start - train < max(50, int(test * 0.25)):
            return out
        out.append((len(out) + 1, start, start + train, end))
        if end >= n:
            return out
        start += step


def test_windows_match_their_definition(spark):
    for n, train, test, step in ((700, 300, 100, 100), (430, 300, 100, 40), (349, 300, 100, 100), (350, 300, 100, 100), (1000, 300, 400, 50), (400, 300, 100, 10)):
        got = dataset.walk_forward_windows(bars(spark, range(1, n + 1)), train, test, step)
        assert [(r.window_id, r.train_start, r.train_end, r.test_end) for r in got.orderBy("window_id").collect()] == windows_by_hand(n, train, test, step)


def test_weighted_training_matches_numpy(spark):
    r, n = np.random.default_rng(2), 420
    x, w = r.normal(size=(n, 2)), r.uniform(0, 2, n)
    y = np.where(x[:, 0] + r.normal(size=n) > 0, 1.0, -1.0)
    df = spark.createDataFrame([("s", 10 * k, float(x[k, 0]), float(x[k, 1]), float(y[k]), float(w[k])) for k in range(n)], "series_id string, timestamp_utc_ms long, a double, b double, y double, w double")
    own = dict(train=200, test=100, step=100, purge_ms=50, weight="w")
    got = {(v.window_id, v.timestamp_utc_ms): v.proba_long for v in dataset.walk_forward(df, ["a", "b"], "y", **own).collect()}
    models = {v.window_id: v for v in dataset.walk_forward_models(df, ["a", "b"], "y", **own).collect()}
    want = {}
    for k, a, e, end in windows_by_hand(n, 200, 100, 100):
        use = [i for i in range(a, e) if 10 * i < 10 * e - 50]
        m, s = x[use].mean(0), x[use].std(0)
        z, t, v = np.clip((x - m) / s, -8, 8), y > 0, w[use] / w[use].mean()
        b, c = np.zeros(2), 0.0
        for _ in range(35):
            err = (1 / (1 + np.exp(-(z[use] @ b + c))) - t[use]) * v
            b, c = b - 0.05 * (z[use].T @ err / len(use) + 1e-4 * b), c - 0.05 * err.mean()
        assert models[k].coef == pytest.approx(b, abs=1e-6) and models[k].intercept == pytest.approx(c, abs=1e-6) and models[k].train_rows == len(use)
        want |= {(k, 10 * i): 1 / (1 + np.exp(-(z[i] @ b + c))) for i in range(e, end)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    assert dataset.walk_forward(df, ["a", "b"], "y", 200, 100, 100, purge_ms=1100).count() == 0  # too few rows left to train on


def test_metrics_over_nothing_are_zero(spark):
    pred = spark.createDataFrame([("s", 0, 0), ("s", 0, 0)], "series_id string, actual_binary int, pred_binary int")
    r = dataset.classification_metrics(pred, ["series_id"]).first()
    assert (r.rows, r.accuracy, r.precision_pos, r.recall_pos, r.specificity, r.balanced_accuracy, r.positive_rate) == (2, 1.0, 0.0, 0.0, 1.0, 0.5, 0.0)


def test_search_gives_what_each_configuration_gives_alone(spark):
    r = np.random.default_rng(3)
    rows = [("s", 10 * k, 10 * k + 1, 10 * k + 8, float(r.uniform(0.3, 0.7)), float(r.normal(0, 80)), float(r.uniform(0, 200)), float(-r.uniform(0, 120)), 2.0, 0.5, 1e6) for k in range(200)]
    df = spark.createDataFrame(rows, "series_id string, timestamp_utc_ms long, entry_ts long, exit_ts long, proba double, gross_bps double, best_bps double, worst_bps double, fixed_cost_bps double, funding_bps double, quote_volume double")
    configs = backtest.grid(most=8)
    assert len(configs) == 8 and len(backtest.grid()) == 36
    both = backtest.search(df, ["series_id"], configs).collect()
    results = set()
    for name, rules in configs.items():
        mine = sorted(((x.timestamp_utc_ms, x.outcome, x.net_bps, x.equity) for x in both if x.config == name), key=str)
        assert mine == sorted(((x.timestamp_utc_ms, x.outcome, x.net_bps, x.equity) for x in backtest.execute(df, ["series_id"], rules).collect()), key=str)
        results.add(str(mine))
    assert len(results) == 8


def test_stress_replays_equity(spark):
    t = spark.createDataFrame([("s", 1, 2, 100.0, 10.0, 5.0, 2.0, 1.0, 1000.0), ("s", 3, 4, -50.0, 10.0, 5.0, 2.0, 1.0, 2000.0)], "series_id string, entry_ts long, exit_ts long, gross_bps double, fee_bps double, slippage_bps double, spread_impact_bps double, funding_bps double, notional double")
    got = {r.scenario: r for r in portfolio.stress(t, ["series_id"]).collect()}
    assert list(sorted(got)) == ["BASE_REPLAY", "COSTS_150PCT", "COSTS_200PCT", "FUNDING_SHOCK", "SLIPPAGE_SHOCK", "WORST_REGIME_PROXY"]
    assert got["SLIPPAGE_SHOCK"].net_bps_sum == pytest.approx(50 - 2 * (10 + 15 + 4 + 1 + 5))
    top, end = 10_000 + 8.2, 10_000 + 8.2 - 13.6
    assert got["BASE_REPLAY"].total_return == pytest.approx(end / 10_000 - 1) and got["BASE_REPLAY"].max_drawdown == pytest.approx(end / top - 1)

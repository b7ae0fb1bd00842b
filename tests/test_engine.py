"""Invariants of the time-series operators."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import dataset, features, labels, portfolio, quality
from barloom.sources import bars as src


@pytest.fixture(scope="module")
def sinus(spark):
    n = 400
    i = F.col("id")
    close = 100 + i * 30 / n + 2 * F.sin(i / 7) + 4 * F.sin(i / 31)
    x = spark.range(n).select(F.lit("s").alias("series_id"), (F.lit(1_577_836_800_000) + i * 300_000).alias("timestamp_utc_ms"), close.alias("close"), (close * (1 + 0.001 * F.sin(i / 11))).alias("open"), (1000 + 100 * F.sin(i / 5)).alias("volume"))
    return x.withColumn("high", F.greatest("open", "close") * 1.002).withColumn("low", F.least("open", "close") * 0.998).cache()


def test_features_dont_look_ahead(sinus):
    names = {"returns": (1, 5), "volatility": (7,), "donchian": (20,), "regime": (20,), "oscillators": (14,)}
    whole = features.features(sinus, names)
    part = features.features(labels.truncated(sinus, 200), names)
    cols = [c for c in whole.columns if c.startswith("feat_")]
    a = whole.where(F.col("timestamp_utc_ms") < 1_577_836_800_000 + 200 * 300_000).select("timestamp_utc_ms", *cols).orderBy("timestamp_utc_ms").toPandas()
    b = part.select("timestamp_utc_ms", *cols).orderBy("timestamp_utc_ms").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_all_families_build(sinus):
    out = features.features(sinus)
    assert len([c for c in out.columns if c.startswith("feat_")]) > 250
    assert not [c for c in out.columns if c.startswith("_")]


def test_ewm_is_recursive(sinus):
    out = features.ewm_features(sinus, (3, 5), (7,)).orderBy("timestamp_utc_ms").toPandas()
    c = sinus.orderBy("timestamp_utc_ms").toPandas()["close"]
    y, want = c[0], [None]
    for x in c[1:]:
        y = 0.5 * x + 0.5 * y
        want.append(y)
    assert pd.isna(out["feat_ema_3"][0])
    assert max(abs(a - b) for a, b in zip(out["feat_ema_3"][1:], want[1:], strict=True)) < 1e-9


def test_barrier_stop_comes_first(spark):
    rows = [("s", k, 100.0, 100.0, 110.0 if k == 2 else 100.0, 90.0 if k == 2 else 100.0, 1.0) for k in range(5)]
    b = spark.createDataFrame(rows, "series_id string, timestamp_utc_ms long, open double, close double, high double, low double, volume double")
    out = {(r.side, r.timestamp_utc_ms): r for r in labels.triple_barrier(b, [{"config_id": "c", "stop": 0.05, "take": 0.05, "horizon": 3}]).collect()}
    assert out["long", 0].event == out["short", 1].event == "stop_loss"
    assert out["long", 0].holding_bars == 2 and out["long", 2].event == "time"
    assert out["long", 4].label is None and out["long", 4].event == ""


def test_cleaning_and_upsert(spark):
    cols = "series_id string, timestamp_utc_ms long, open double, high double, low double, close double, volume double"
    good, bad = ("s", 1, 1.0, 2.0, 0.5, 1.5, 1.0), [("s", 2, 1.0, 0.5, 0.5, 1.5, 1.0), ("s", 3, -1.0, 2.0, 0.5, 1.5, 1.0), ("s", 4, 1.0, 2.0, 0.5, None, 1.0), ("s", 5, 1.0, 2.0, 0.5, 1.5, -1.0)]
    df = spark.createDataFrame([good, *bad], cols)
    assert src.clean(df).collect()[0].timestamp_utc_ms == 1 and src.clean(df).count() == 1
    new = spark.createDataFrame([("s", 1, 9.0, 9.0, 9.0, 9.0, 1.0)], cols)
    out = {r.timestamp_utc_ms: r.open for r in src.upsert(df, new, ["series_id", "timestamp_utc_ms"]).collect()}
    assert out[1] == 9.0 and len(out) == 5


def test_simulation_never_overlaps_and_base_stress_replays(spark, sinus):
    signal = sinus.select("series_id", "timestamp_utc_ms", F.lit(1).alias("side"))
    t = portfolio.simulate(portfolio.candidates(sinus, signal, 3), ["series_id"]).cache()
    rows = t.orderBy("entry_ts").collect()
    assert all(b.entry_ts > a.exit_ts for a, b in zip(rows, rows[1:]))
    base = portfolio.stress(t.withColumns({"spread_impact_bps": F.lit(0.0), "notional": F.lit(100.0)}), ["series_id"]).where("scenario = 'BASE_REPLAY'").first()
    assert base.net_bps_sum == pytest.approx(sum(r.net_bps for r in rows))
    assert portfolio.admit(t.withColumn("run", F.lit(1)), ["run"]).count() == len(rows)


def test_walk_forward_predicts_out_of_sample_only(spark, sinus):
    x = labels.directional(features.features(sinus, {"returns": (1, 5)}), (3,), (5,))
    out = dataset.walk_forward(x, ["feat_ret_log_1", "feat_ret_log_5"], "label_dir_h3_thr5bps", 150, 60, 60)
    assert out.groupBy("window_id", "timestamp_utc_ms").count().where("count > 1").count() == 0
    assert out.where("proba_long <= 0 or proba_long >= 1").count() == 0 and out.count() > 100
    assert quality.prune(x.withColumn("feat_same", F.lit(1.0)), ["feat_same", "feat_ret_log_1"]).columns.count("feat_same") == 0


def test_streaming_bars_match_batch(spark, tmp_path):
    from barloom.streaming.bars import stream_bars

    rows = [("s", (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=30 * k)).to_pydatetime(), float(k), k) for k in range(1, 41)]
    rows.append(("s", pd.Timestamp("2024-01-02").to_pydatetime(), 1.0, 1))
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, price double, volume long")
    df.write.parquet(str(tmp_path / "in"))
    q = stream_bars(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 300).writeStream.format("memory").queryName("stream_bars").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    first = spark.sql("select * from stream_bars order by timestamp_utc_ms").first()
    assert (first.open, first.close, first.volume) == (1.0, 10.0, 55)

"""Naming, shaping, triage, rollups and extensions on small tables."""

import hashlib

from pyspark.sql import functions as F

from barloom.functions import names
from barloom.operators import extensions, registry, summaries, triage
from barloom.sources import shape, synthetic

RECORD = "series_id string, dataset_kind string, status string, errors array<string>, warnings array<string>, rows long, gap_ratio double, return_outlier_count long"


def test_names(spark):
    x = spark.createDataFrame([("sim", "1, x,2.5"), ("N", ""), (None, None)], "b string, t string")
    got = x.select(names.permissive_bool(F.col("b")).alias("b"), names.parsed_list(F.col("t"), (9,)).alias("t")).collect()
    assert [r.b for r in got] == [True, False, True]
    assert got[0].t == [1.0, 2.5] and got[1].t == [9.0]
    labels = spark.createDataFrame([("label_dir_h20_thr5",), ("x_h7",), ("path9",), ("none",)], "n string")
    assert [r[0] for r in labels.select(names.horizon_bars(F.col("n"))).collect()] == [20, 7, 9, 20]
    assert names.label_column(["b_h5"], ("a_h{h}", "b_h{h}"), 5) == "b_h5"


def test_shape(spark):
    x = spark.createDataFrame([("a", "1600000000000", None, 1.0), ("b", "x", "2020-09-13 16:26:40", 2.0), ("b", None, "2020-09-13 16:26:41", 3.0)], "series_id string, Timestamp_ms string, Date string, feat_x double")
    y = shape.reconciled(shape.renamed(x).withColumn("local_time", F.col("local_time").cast("timestamp_ntz")))
    got = {(r.series_id, r.timestamp_utc_ms, str(r.local_time)) for r in y.collect()}
    assert got == {("a", 1600000000000, "2020-09-13 16:26:40"), ("b", 1600000000000, "2020-09-13 16:26:40"), ("b", 1600000001000, "2020-09-13 16:26:41")}
    assert shape.ordered(y).columns == ["series_id", "timestamp_utc_ms", "local_time", "feat_x"]
    assert shape.model_inputs(y) == ["feat_x"]
    assert shape.picked(y, {"series_id": ("B",)}).count() == 2 and shape.picked(y, series_id=("a",)).count() == 1
    about = spark.createDataFrame([("a", "spot")], "series_id string, source string")
    assert {r.meta_source for r in shape.with_metadata(y, about).collect()} == {"spot", None}
    assert shape.long_enough(y, "7D").count() == 0
    twice = spark.createDataFrame([(1.0, 2.0)], "o double, open double")
    assert shape.renamed(twice).columns == ["o", "open"]


def test_triage(spark):
    rows = [
        ("fine", "ohlcv", "PASS", [], [], 900, 0.0, 0),
        ("gap", "ohlcv", "WARNING", [], ["12 Gaps temporais"], 900, 0.0005, 0),
        ("gaps", "ohlcv", "WARNING", [], ["12 Gaps temporais"], 900, 0.5, 0),
        ("other", "notes", "WARNING", [], ["histórico curto"], 2, None, None),
        ("bad", "ohlcv", "FAIL", ["OHLC inválido em 3"], ["retornos absolutos"], 900, None, 5),
    ]
    got = {r.series_id: r for r in triage.gate(triage.enriched(spark.createDataFrame(rows, RECORD)).withColumn("audit_status", F.lit(None).cast("string"))).collect()}
    assert {k: (r.root_cause, r.ml_quality_status, r.ml_gate, r.ml_gate_usable) for k, r in got.items()} == {
        "fine": ("NO_ISSUE_DETECTED", "ML_READY", "ML_READY", True),
        "gap": ("TIME_GAPS", "ML_CAUTION", "ML_CAUTION_ACCEPTABLE", True),
        "gaps": ("TIME_GAPS", "ML_BLOCKED", "ML_BLOCKED", False),
        "other": ("SHORT_HISTORY", "ML_NOT_APPLICABLE", "ML_NOT_APPLICABLE", False),
        "bad": ("OHLCV_VALUE_INTEGRITY", "ML_BLOCKED", "ML_BLOCKED", False),
    }
    assert [r.series_id for r in triage.report(spark.createDataFrame(rows, RECORD)).collect()] == ["bad", "other", "gap", "gaps"]
    s = spark.createDataFrame([("ok",), ("critical",), ("odd",), (None,)], "s string").select(triage.normal_status(F.col("s"))).collect()
    assert [r[0] for r in s] == ["PASS", "FAIL", "WARNING", "UNKNOWN"]


def test_contract(spark):
    bars = spark.createDataFrame([("a", 2, 1, 1.0, 2.0, 0.5, 1.0, 1.0), ("a", 1, 2, 1.0, 0.4, 0.5, 1.0, -1.0), ("a", 1, 3, 0.0, 2.0, 0.5, 3.0, 1.0)], "series_id string, timestamp_utc_ms long, n int, open double, high double, low double, close double, volume double")
    r = triage.input_contract(bars, "n").first()
    assert r.status == "FAIL" and r.timestamp_duplicate_count == 1 and r.timestamp_falling_count == 2 and r.high_lt_low_count == 1 and r.volume_negative_count == 1 and r.open_non_positive_count == 1


def test_rollups(spark):
    runs = spark.createDataFrame([("s1", "f", "OK", 2.0), ("s2", "f", "SKIPPED_x", 0.0), ("s2", "g", "ERROR_y", 5.0)], "series_id string, family string, status string, seconds double")
    assert [(r.family, r.runs, r.ok, r.skipped) for r in summaries.timings(runs).collect()] == [("g", 1, 0, 0), ("f", 2, 1, 1)]
    series = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "series_id string")
    assert [r[0] for r in summaries.to_retry(series, runs).collect()] == ["s2"]
    assert [r[0] for r in summaries.missing(series, runs).collect()] == ["s3"]
    blob = bytes(range(256)) * 600
    x = spark.createDataFrame([(b"ab",), (blob,)], "c binary").select(summaries.file_key(F.col("c"))).collect()
    assert [r[0] for r in x] == [hashlib.sha256(b"ab").hexdigest(), hashlib.sha256(blob[:65536] + blob[-65536:]).hexdigest()]
    w = spark.createDataFrame([("e", 0.6, 1.0), ("e", 0.4, 3.0)], "experiment_id string, balanced_accuracy double, n double")
    r = summaries.over_windows(w, ["n"]).first()
    assert (r.windows, r.mean_n, r.good_windows) == (2, 2.0, 1)
    s = spark.createDataFrame([("ML_READY", "OK", None, None, None), ("ML_READY", "OK", "OK", "FAIL", None), ("ML_BLOCKED", "OK", None, None, None), (None, None, None, None, None)], "ml_gate string, walk_forward_status string, backtest_status string, validation_status string, stress_status string")
    assert [r[0] for r in s.select(registry.review_status()).collect()] == ["RESEARCH_REGISTERED", "NEEDS_VALIDATION_REVIEW", "BLOCKED_DATA_QUALITY", "BLOCKED_WALK_FORWARD"]


def test_layers(spark):
    rows = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "z")], "source string, symbol string")
    by_s, by_m = spark.createDataFrame([("p", 2.0)], "source string, bps double"), spark.createDataFrame([("x", 1.0)], "symbol string, bps double")
    assert {(r.symbol, r.bps) for r in summaries.layered(rows, 9.0, by_s, by_m, "bps").collect()} == {("x", 1.0), ("y", 2.0), ("z", 9.0)}


def test_as_of(spark):
    bars = spark.createDataFrame([("a", t) for t in (5, 10, 30)] + [("b", 10)], "series_id string, timestamp_utc_ms long")
    ev = spark.createDataFrame([("a", 10, 1.0), ("a", 10, 2.0), ("a", 12, None)], "series_id string, timestamp_utc_ms long, rate double")
    got = {(r.series_id, r.timestamp_utc_ms): r.rate for r in extensions.as_of(bars, ev, ["rate"], most_ms=15).collect()}
    assert got == {("a", 5): None, ("a", 10): 2.0, ("a", 30): None, ("b", 10): None}
    assert extensions.as_of(bars, ev.limit(0), ["rate"]).where("rate is not null").count() == 0


def test_random_walk(spark):
    x = synthetic.random_walk(spark, 50)
    assert x.count() == 50 and x.where("high < greatest(open, close) or low > least(open, close) or volume < 1").count() == 0

"""Payload sources, manifests, file tables, sinks, blocks and checks."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from barloom.functions.blocks import in_blocks
from barloom.operators import checks, costs, dataset, labels
from barloom.sources import payloads


def test_klines_and_metrics_parse(spark, tmp_path):
    rows = [[1000, "1.5", "2", "1", "1.7", "10", 0, "0", 5, "0", "0", "0"], [61000, "bad", "2", "1", "1.7", "10", 0, "0", 5, "0", "0", "0"], ["x", "1", "1", "1", "1", "1"]]
    (tmp_path / "k.json").write_text(json.dumps(rows))
    got = sorted(map(tuple, payloads.klines(spark, str(tmp_path / "k.json"), 60).collect()))
    assert got == [(61000, 1.5, 2.0, 1.0, 1.7, 10.0), (121000, None, 2.0, 1.0, 1.7, 10.0)]
    (tmp_path / "f.json").write_text('[{"fundingRateTimestamp": "8", "fundingRate": "0.1"}, {"fundingRate": "1"}]')
    assert [tuple(r) for r in payloads.funding(spark, str(tmp_path / "f.json"), "S").collect()] == [(8, "S", 0.1)]
    (tmp_path / "o.json").write_text('[{"timestamp": "9", "openInterest": "3"}]')
    assert [tuple(r) for r in payloads.open_interest(spark, str(tmp_path / "o.json"), "S").collect()] == [(9, "S", "1h", 3.0)]


def test_pages_are_read_in_parallel_and_tried_again(spark):
    seen = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            start, end = (int(v) for v in self.path.strip("/").split("-"))
            seen.append(start)
            if seen.count(start) == 1 and start == 0:
                self.send_response(429)
                self.end_headers()
                return
            body = json.dumps([[t, "1", "2", "0.5", "1", "3"] for t in range(start, end + 1, 60_000)]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(payloads.KlineSource)
    url = f"http://127.0.0.1:{server.server_port}/{{start}}-{{end}}"
    df = spark.read.format("klines").options(url=url, start_ms="0", end_ms=str(25 * 60_000), seconds="60", limit="10").load()
    times = sorted(r.timestamp_utc_ms for r in df.collect())
    server.shutdown()
    assert times == [60_000 * (k + 1) for k in range(25)]
    assert seen.count(0) >= 2 and {600_000, 1_200_000} <= set(seen)


@pytest.mark.parametrize("text", ['[{"series_id": "a", "n": "1"}]', '{"results": [{"series_id": "a", "n": "1"}]}', '{"a": {"n": "1"}}', '{"a": {"series_id": "old", "n": "1"}}'])
def test_manifest_shapes(spark, tmp_path, text):
    (tmp_path / "m.json").write_text(text)
    (row,) = payloads.manifest(spark, str(tmp_path / "m.json")).collect()
    assert row.series_id == "a" and row.record["n"] == "1"


def test_file_table_and_sizes(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.bin").write_bytes(b"1234")
    (tmp_path / "a" / "y.txt").write_bytes(b"12")
    files = payloads.file_table(spark, str(tmp_path))
    sizes = {r.folder.rsplit("/", 1)[-1]: (r.files, r.bytes) for r in payloads.folder_sizes(files).collect()}
    assert sizes["a"] == (2, 6) and sizes["b"] == (1, 4)
    assert payloads.file_table(spark, str(tmp_path), ".txt").count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 2, [])], "series_id string, n int, w array<string>")
    payloads.write_table(df, str(tmp_path / "t"))
    payloads.write_table(df.where("n = 1").withColumn("n", F.lit(9)), str(tmp_path / "t"))
    assert {r.series_id: r.n for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"a": 9, "b": 2}
    payloads.append_log(df, str(tmp_path / "l"))
    payloads.append_log(df, str(tmp_path / "l"))
    (tmp_path / "l" / "part-bad.json").write_text("{broken\n")
    assert [r.n for r in payloads.jsonl_tail(spark, str(tmp_path / "l"), "series_id string, n int", "n", 3).collect()] == [2, 2, 1]
    payloads.write_csv(df, str(tmp_path / "c"))
    assert {r.w for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"x | y", None}


def test_blocks_give_what_whole_series_give(spark):
    b = spark.range(700).select(F.when(F.col("id") < 600, "hot").otherwise("s").alias("series_id"), (F.col("id") * 7_000_000).alias("timestamp_utc_ms"), *[(100 + F.sin(F.col("id") * k)).alias(c) for k, c in enumerate(("open", "high", "low", "close"), 1)])
    f = lambda d: labels.tail_events(d, (5, 20), (50,))
    key = lambda d: d.orderBy("series_id", "timestamp_utc_ms").collect()
    assert key(in_blocks(b, f, 0, 20, rows=64).select(*f(b).columns)) == key(f(b))
    with pytest.raises(ValueError):
        in_blocks(b, f, 65, rows=64)


def test_no_task_holds_a_hot_series(spark):
    b = spark.range(1000).select(F.lit("hot").alias("series_id"), (F.col("id") * 60_000_000).alias("timestamp_utc_ms"), F.lit(1.0).alias("close"))
    sizes = in_blocks(b, lambda d: d.withColumn("_g", F.col("series_id.block")), 10, rows=100).groupBy("_g").count().collect()
    assert len(sizes) == 10 and {r["count"] for r in sizes} == {100}


def test_grid_and_choice():
    g = labels.full_grid()
    assert len(g) == len({c["config_id"] for c in g}) == 462
    assert dataset.choose_features(["feat_a", "feat_rsi_7", "feat_b", "cost_x"], 3) == ["feat_rsi_7", "cost_x", "feat_a"]


def test_all_kinds_of_barriers(spark):
    b = spark.range(200).select(F.lit("s").alias("series_id"), (F.col("id") * 3_600_000).alias("timestamp_utc_ms"), (100 + F.sin(F.col("id"))).alias("close")).withColumns({"open": F.col("close"), "high": F.col("close") * 1.01, "low": F.col("close") * 0.99})
    g = [c for c in labels.full_grid() if c["config_id"] in ("w20_vol_sl1.0_tp1.0_h8", "w14_atr_sl1.0_tp1.0_h8", "fixed_sl50_tp100_h5")]
    rows = labels.all_barriers(b, g)
    n = {r.config_id: (r["rows"], r["labelled"]) for r in rows.groupBy("config_id").agg(F.count(F.lit(1)).alias("rows"), F.count("label").alias("labelled")).collect()}
    assert n == {"fixed_sl50_tp100_h5": (400, 398), "w20_vol_sl1.0_tp1.0_h8": (400, 2 * 179), "w14_atr_sl1.0_tp1.0_h8": (400, 2 * 186)}


def test_checks_find_what_is_wrong(spark):
    a = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 2.0)], "series_id string, timestamp_utc_ms long, close double")
    ok = lambda d: {r.name: r.passed for r in d.collect()}
    assert all(ok(checks.preserved(a, a, ["close"])).values())
    assert ok(checks.preserved(a, a.where("timestamp_utc_ms = 1"), ["close"]))["no_row_lost"] is False
    assert ok(checks.preserved(a, a.withColumn("close", F.lit(1.0)), ["close"]))["same_values"] is False
    t = spark.createDataFrame([("s", 2, 1, 1, float("nan"), -1.0, 0.0, 0.0)] * 2, "series_id string, entry_ts long, exit_ts long, side int, net_bps double, fee_bps double, slippage_bps double, funding_bps double")
    e = spark.createDataFrame([(-1.0, 0.1)], "equity double, drawdown double")
    got = ok(checks.trades(t, e))
    assert got.pop("has_trades") and not any(got.values())
    assert ok(checks.trades(t.limit(0), e.limit(0)))["has_trades"] is False


def test_costs_bound_fills_and_prices(spark):
    r = spark.createDataFrame([("kraken", 100.0, 101.0, 99.0, 100.0, 0.0), ("binance_spot", 100.0, 100.05, 99.0, 100.0, 1e9)], "source string, open double, high double, low double, close double, volume double")
    x = costs.with_costs(r, 1.0, 1000.0)
    x = costs.position_size(x, F.lit(1000.0)).withColumn("px", costs.entry_price(F.lit("long"), F.lit(40.0)))
    a, b = x.orderBy("volume").collect()
    assert (a.funding_bps, a.fill_ratio) == (1.8, 0.5) and (b.funding_bps, b.fill_ratio) == (0.0, 1.0)
    assert b.px == 100.05 and a.px == pytest.approx(100.2)

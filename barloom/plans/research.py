"""Queries of datasets, audits, evaluation and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import backtest, dataset, features, labels, portfolio, quality, registry
from ..sources import bars as src
from . import oracle as o

STEP = 3_600_000


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _bars(spark, d) -> DataFrame:
    return src.bars(spark, d)


def clean_bars(spark, d):
    b = _bars(spark, d)
    even = F.expr("timestamp_utc_ms div 3600000 % 7 = 0")
    dirty = b.withColumn("low", F.when(even, F.col("high") + 1).otherwise(F.col("low"))).withColumn("close", F.when(F.expr("timestamp_utc_ms div 3600000 % 11 = 0"), F.lit(-1.0)).otherwise(F.col("close")))
    return _r(src.clean(dirty))


def upsert_bars(spark, d):
    b = _bars(spark, d)
    cut = 1_704_672_000_000
    new = b.where(F.col("timestamp_utc_ms") >= cut - 60 * STEP).withColumns({c: F.col(c) * 2 for c in ("open", "high", "low", "close")})
    return _r(src.upsert(b.where(F.col("timestamp_utc_ms") < cut), new, ["series_id", "timestamp_utc_ms"]))


def timestamp_units(spark, d):
    b = _bars(spark, d).withColumn("_k", F.length("series_id") % 4)
    raw = F.col("timestamp_utc_ms") * F.element_at(F.array(F.lit(0.001), F.lit(1.0), F.lit(1000.0), F.lit(1000000.0)), F.col("_k") + 1)
    x = b.withColumn("raw", raw)
    return x.select("series_id", "timestamp_utc_ms", src.timestamp_ms(F.col("raw")).alias("normalised_ms"))


def overlap(spark, d):
    return src.overlap_start(_bars(spark, d), STEP)


def audit(spark, d):
    out = quality.ml_gate(quality.status(quality.audit(_bars(spark, d), STEP)))
    return _r(out.withColumn("warnings", F.array_join("warnings", " | ")))


def modal(spark, d):
    return _r(registry.modal_interval(_bars(spark, d)))


def class_distribution(spark, d):
    x = labels.directional(_bars(spark, d), (3,), (25, 100))
    return registry.class_distribution(x, ["label_dir_h3_thr25bps", "label_dir_h3_thr100bps"])


def counts(spark, d):
    return registry.counts_by(spark.read.parquet(f"{d}/orders.parquet"), ["o_orderstatus", "o_orderpriority"])


def matrix(spark, d):
    return registry.matrix(spark.read.parquet(f"{d}/orders.parquet"), "o_orderpriority", "o_orderstatus")


def inverted(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    return registry.inverted_index(n, "n_regionkey", "n_name").select(F.col("n_regionkey").cast("long").alias("n_regionkey"), F.array_join("values", ",").alias("names"))


def names(spark, d):
    p = F.concat(F.lit("data/ohlcv/binance/"), F.upper("series_id"), F.lit("USDT_"), F.element_at(F.array(F.lit("15min"), F.lit("4h"), F.lit("1d")), F.length("series_id") % 3 + 1), F.lit(".parquet"))
    s = _bars(spark, d).select("series_id").distinct().withColumn("path", p)
    out = s.withColumn("kind", registry.dataset_kind(F.col("path"))).withColumn("symbol", registry.symbol_of(F.col("path"))).withColumn("asset", registry.asset_of(F.col("symbol"))).withColumn("timeframe", registry.timeframe_of(F.col("path")))
    return out.withColumn("series_key", registry.series_key(F.col("kind"), F.lit("binance"), F.col("asset"), F.col("symbol"), F.col("timeframe"), F.col("path")))


def linspace(spark, d):
    return registry.evenly(_bars(spark, d), 11).select("series_id", "timestamp_utc_ms", F.round("close", 6).alias("close"))


def assembled(spark, d) -> DataFrame:
    b = _bars(spark, d)
    f = features.features(b, {"returns": (1, 5), "volatility": (7,)})
    return dataset.assemble(f, labels.directional(b, (5,), (25,)), "view", ("feat_ret_log_1", "feat_ret_log_5"))


def dataset_rows(spark, d):
    x = dataset.trainable(assembled(spark, d), "label_dir_h5_thr25bps")
    table = spark.createDataFrame([("default", 20.0, 15.0), ("click", 12.0, 12.0)], "series_id string, fee_bps double, slippage_bps double")
    x = dataset.costs(x, table)
    cols = ["series_id", "timestamp_utc_ms", "feat_ret_log_1", "feat_ret_log_5", "feat_rv_std_7", "label_dir_h5_thr25bps", "xasset_view_feat_ret_log_1", "xasset_view_feat_ret_log_5", "cost_fee_bps", "cost_slippage_bps", "is_trainable", "sample_weight"]
    return _r(x.select(*cols))


def windows(spark, d):
    return dataset.walk_forward_windows(_bars(spark, d), 300, 100, 100)


def predictions(spark, d):
    x = assembled(spark, d)
    return _r(dataset.walk_forward(x, ["feat_ret_log_1", "feat_ret_log_5", "feat_rv_std_7"], "label_dir_h5_thr25bps", 300, 100, 100, purge_ms=5 * STEP))


def prediction_metrics(spark, d):
    return _r(dataset.classification_metrics(predictions(spark, d), ["series_id"]))


def _trades(spark, d) -> DataFrame:
    b = _bars(spark, d)
    s = features.features(b, {"returns": (5,)}).where(F.abs("feat_ret_log_5") > 0.5).select("series_id", "timestamp_utc_ms", F.when(F.col("feat_ret_log_5") < 0, 1).otherwise(-1).alias("side"))
    return portfolio.candidates(b, s, 3)


def trade_candidates(spark, d):
    c = _trades(spark, d)
    return _r(c.select("series_id", "timestamp_utc_ms", "side", "entry_ts", "exit_ts", "entry_price", "exit_price"))


def simulated(spark, d):
    return _r(portfolio.simulate(_trades(spark, d), ["series_id"]))


def all_candidates(spark, d) -> DataFrame:
    """Every candidate as a trade, with costs: for operators that don't depend on equity."""
    net = (F.col("exit_price") / F.col("entry_price") - 1) * 1e4 * F.col("side")
    return _trades(spark, d).withColumns({"gross_bps": net, "fee_bps": F.lit(20.0), "slippage_bps": F.lit(10.0), "funding_bps": F.lit(2.0)}).withColumn("net_bps", F.col("gross_bps") - 32.0)


def curve(spark, d):
    out = portfolio.equity_curve(all_candidates(spark, d), ["series_id"], 0.001)
    return _r(out.select("series_id", "entry_ts", "exit_ts", "net_bps", "equity", "drawdown"), 5)


def trade_metrics(spark, d):
    return _r(portfolio.metrics(portfolio.equity_curve(all_candidates(spark, d), ["series_id"], 0.001), ["series_id"]), 4)


def stressed(spark, d):
    x = all_candidates(spark, d).withColumns({"spread_impact_bps": F.lit(4.0), "notional": F.lit(10.0)})
    return _r(portfolio.stress(x, ["series_id"]), 3)


def admitted(spark, d):
    t = portfolio.simulate(_trades(spark, d), ["series_id"]).withColumn("run", F.lit(1))
    return _r(portfolio.admit(t, ["run"], 3))


def grid_candidates(spark, d) -> DataFrame:
    """Candidates with probabilities that thresholds tell apart and paths that stops and targets do."""
    x = all_candidates(spark, d)
    lean = F.expr("(timestamp_utc_ms div 3600000 % 20) / 100.0")
    gross, wide = F.col("gross_bps") * F.col("side"), F.expr("40.0 + timestamp_utc_ms div 3600000 % 140")
    return x.select("series_id", "timestamp_utc_ms", "entry_ts", "exit_ts", F.when(F.col("side") == 1, 0.5 + lean).otherwise(0.5 - lean).alias("proba"), (gross / 100).alias("gross_bps"), wide.alias("best_bps"), (F.lit(110.0) - wide).alias("worst_bps"), F.lit(2.0).alias("fixed_cost_bps"), F.lit(1.0).alias("funding_bps"), (F.col("close") * F.col("volume")).alias("quote_volume"))


def grid(spark, d):
    """A search over the default grid: what each configuration makes of each series, by rank of its score."""
    done = backtest.search(grid_candidates(spark, d), ["series_id"], backtest.grid()).where("outcome = 'TRADE'")
    out = backtest.performance(done, ["config", "series_id"])
    return _r(backtest.ranked(out, "config"), 4)


def top_trades(spark, d):
    return _r(all_candidates(spark, d).select("series_id", "timestamp_utc_ms", "net_bps").orderBy(F.desc("net_bps"), "series_id", "timestamp_utc_ms").limit(10), 4)


def ranks(spark, d):
    x = labels.forward_returns(_bars(spark, d), (5,))
    return _r(labels.cross_sectional_rank(x, "label_fwd_ret_gross_long_h5").select("series_id", "timestamp_utc_ms", "label_fwd_ret_gross_long_h5_rank"))


def experiment_registry(spark, d):
    b = _bars(spark, d)
    e = b.select("series_id").distinct().withColumn("experiment_id", F.concat(F.lit("exp_"), F.col("series_id")))
    m = portfolio.metrics(portfolio.equity_curve(all_candidates(spark, d).where(F.col("series_id") != "view"), ["series_id"], 0.001), ["series_id"]).select(F.concat(F.lit("exp_"), F.col("series_id")).alias("experiment_id"), "trades")
    s = b.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))
    out = registry.registry(e, m, s).withColumns({"ml_gate": F.when(F.col("series_id") == "click", "ML_BLOCKED").otherwise("ML_READY"), "walk_forward_status": F.lit("OK"), "backtest_status": F.when(F.col("trades").isNull(), "MISSING").otherwise("OK"), "validation_status": F.lit(None).cast("string"), "stress_status": F.lit("OK")})
    return out.withColumn("status", registry.review_status()).select("series_id", "experiment_id", "trades", "rows", "status", "registry_hash")


def barrier_vol(spark, d):
    x = labels.barrier_width(_bars(spark, d), "atr", 14)
    out = labels.triple_barrier(x, labels.barrier_grid("atr", (1.0,), (1.5,), (8,)), "width")
    return out.groupBy("series_id", "side", "event").agg(F.count(F.lit(1)).alias("n"), F.sum("holding_bars").alias("bars"))


def queries() -> dict:
    own = (clean_bars, upsert_bars, timestamp_units, overlap, audit, modal, class_distribution, counts, matrix, inverted, names, linspace, dataset_rows, windows, predictions, prediction_metrics, trade_candidates, simulated, curve, trade_metrics, stressed, admitted, grid, top_trades, ranks, experiment_registry, barrier_vol)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    b = o.bars_sql()
    ohlcv = "round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume"
    w = o.W
    cand = f"""{b}, p AS (SELECT *, ln(close) - lag(ln(close), 5) OVER {w} AS r5, lead(timestamp_utc_ms, 1) OVER {w} AS entry_ts, lead(open, 1) OVER {w} AS entry_price, lead(timestamp_utc_ms, 4) OVER {w} AS exit_ts, lead(close, 4) OVER {w} AS exit_price FROM bars),
cand AS (SELECT series_id, timestamp_utc_ms, CASE WHEN r5 < 0 THEN 1 ELSE -1 END AS side, entry_ts, exit_ts, entry_price, exit_price FROM p WHERE abs(r5) > 0.5 AND exit_ts IS NOT NULL),
t AS (SELECT *, (exit_price / entry_price - 1) * 1e4 * side AS gross, (exit_price / entry_price - 1) * 1e4 * side - 32.0 AS net_bps FROM cand)"""
    eq = f"""{cand}, e AS (SELECT *, exp(sum(ln(1 + greatest(-0.99, net_bps / 1e4 * 0.001))) OVER (PARTITION BY series_id ORDER BY exit_ts, entry_ts ROWS UNBOUNDED PRECEDING)) AS equity, row_number() OVER (PARTITION BY series_id ORDER BY exit_ts, entry_ts) AS n FROM t),
f AS (SELECT *, equity / greatest(1.0, max(equity) OVER (PARTITION BY series_id ORDER BY n ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown, sum(CASE WHEN net_bps > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS wins FROM e)"""
    scen = ", ".join(f"('{n}', {', '.join(map(str, v))})" for n, *v in portfolio.SCENARIOS)
    run = "(PARTITION BY series_id, scenario ORDER BY exit_ts, entry_ts ROWS UNBOUNDED PRECEDING)"
    d = f"timestamp_utc_ms - lag(timestamp_utc_ms) OVER {w}"
    lab = lambda t: o.net_label(3, t)
    g5 = f"({o.div(o.lead('close', 5), 'close')} - 1)"
    out = {
        "clean_bars": f"WITH {b}, x AS (SELECT series_id, timestamp_utc_ms, open, high, CASE WHEN timestamp_utc_ms // 3600000 % 7 = 0 THEN high + 1 ELSE low END AS low, CASE WHEN timestamp_utc_ms // 3600000 % 11 = 0 THEN -1.0 ELSE close END AS close, volume FROM bars) SELECT series_id, timestamp_utc_ms, {ohlcv} FROM x WHERE least(open, high, low, close) > 0 AND high >= greatest(open, close, low) AND low <= least(open, close, high) AND volume >= 0",
        "upsert_bars": f"WITH {b}, x AS (SELECT series_id, timestamp_utc_ms, CASE WHEN timestamp_utc_ms >= 1704456000000 THEN 2 ELSE 1 END AS m, * EXCLUDE (series_id, timestamp_utc_ms) FROM bars) SELECT series_id, timestamp_utc_ms, round(open * m, 6) + 0.0 AS open, round(high * m, 6) + 0.0 AS high, round(low * m, 6) + 0.0 AS low, round(close * m, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume FROM x",
        "timestamp_units": f"WITH {b} SELECT series_id, timestamp_utc_ms, CASE WHEN length(series_id) % 4 = 0 THEN CAST(round(timestamp_utc_ms * 0.001) * 1000 AS BIGINT) ELSE timestamp_utc_ms END AS normalised_ms FROM bars",
        "overlap": f"WITH {b} SELECT series_id, max(timestamp_utc_ms) - 60 * 3600000 AS from_ms FROM bars GROUP BY 1",
        "audit": f"""WITH {b}, x AS (SELECT *, {d} AS d, {o.div('close', o.lag('close'))} - 1 AS r FROM bars),
a AS (SELECT series_id, count(*) AS rows, count(*) FILTER (close IS NULL OR open IS NULL) AS null_rows, count(*) FILTER (d = 0) AS duplicate_count, count(*) FILTER (d > 5400000) AS gap_count, count(*) FILTER (d > 0 AND abs(d - 3600000) > 3600) AS irregular_count, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high) OR least(open, high, low, close) <= 0) AS invalid_ohlc, count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER (abs(r) > 0.5) AS return_outlier_count, min(timestamp_utc_ms) AS first_ms, max(timestamp_utc_ms) AS last_ms, median(CASE WHEN d > 0 THEN d END) + 0.0 AS median_delta_ms FROM x GROUP BY 1)
SELECT *, round(gap_count / rows, 6) + 0.0 AS gap_ratio, round(return_outlier_count / rows, 6) + 0.0 AS outlier_ratio, array_to_string(list_filter([CASE WHEN duplicate_count > 0 THEN 'duplicate_timestamps' END, CASE WHEN gap_count > 0 THEN 'gaps' END, CASE WHEN irregular_count > 0 THEN 'irregular' END, CASE WHEN return_outlier_count > 0 THEN 'return_outliers' END], lambda v: v IS NOT NULL), ' | ') AS warnings,
CASE WHEN invalid_ohlc + null_rows + negative_volume > 0 THEN 'FAIL' WHEN duplicate_count + gap_count + irregular_count + return_outlier_count > 0 THEN 'WARNING' ELSE 'PASS' END AS status,
CASE WHEN null_rows > 0 THEN 'NULLS' WHEN invalid_ohlc > 0 THEN 'INVALID_OHLC' WHEN negative_volume > 0 THEN 'NEGATIVE_VOLUME' WHEN duplicate_count > 0 THEN 'DUPLICATES' WHEN gap_count > 0 THEN 'GAPS' WHEN return_outlier_count > 0 THEN 'OUTLIERS' WHEN irregular_count > 0 THEN 'IRREGULAR' ELSE 'NONE' END AS root_cause,
CASE WHEN invalid_ohlc + null_rows + negative_volume > 0 OR rows < 300 OR gap_count / rows > 0.001 OR return_outlier_count / rows > 0.001 THEN 'BLOCKED' WHEN duplicate_count + gap_count + irregular_count + return_outlier_count > 0 THEN 'CAUTION_ACCEPTABLE' ELSE 'READY' END AS gate FROM a""",
        "modal": f"WITH {b}, x AS (SELECT series_id, {d} AS d FROM bars), c AS (SELECT series_id, d, count(*) AS n FROM x WHERE d > 0 GROUP BY 1, 2), m AS (SELECT series_id, arg_max(d, n * 1000000000000000 - d) AS modal_delta_ms, max(n) / sum(n) AS s FROM c GROUP BY 1) SELECT series_id, modal_delta_ms, round(s, 6) + 0.0 AS share, CASE WHEN s >= 0.95 THEN 'high' WHEN s >= 0.8 THEN 'medium' ELSE 'low' END AS confidence FROM m",
        "class_distribution": f"WITH {b}, x AS (SELECT {lab(25)} AS a, {lab(100)} AS c FROM bars) SELECT 'label_dir_h3_thr25bps' AS label, CAST(a AS DOUBLE) AS value, count(*) AS n FROM x GROUP BY 1, 2 UNION ALL SELECT 'label_dir_h3_thr100bps', CAST(c AS DOUBLE), count(*) FROM x GROUP BY 1, 2",
        "counts": "SELECT 'o_orderstatus' AS key, coalesce(o_orderstatus, 'UNKNOWN') AS value, count(*) AS n FROM orders GROUP BY 1, 2 UNION ALL SELECT 'o_orderpriority', coalesce(o_orderpriority, 'UNKNOWN'), count(*) FROM orders GROUP BY 1, 2",
        "matrix": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(grouping(o_orderpriority) * 2 + grouping(o_orderstatus) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
        "inverted": "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1",
        "names": """WITH s AS (SELECT DISTINCT event_type AS series_id FROM events WHERE value > 0), p AS (SELECT series_id, ['15min', '4h', '1d'][length(series_id) % 3 + 1] AS timeframe, upper(series_id) AS asset FROM s), q AS (SELECT *, 'data/ohlcv/binance/' || asset || 'USDT_' || timeframe || '.parquet' AS path FROM p)
SELECT series_id, path, 'ohlcv' AS kind, asset || 'USDT' AS symbol, asset, timeframe, 'ohlcv__binance__' || asset || '__' || asset || 'USDT__' || timeframe || '__' || substr(sha256(path), 1, 8) AS series_key FROM q""",
        "linspace": f"WITH {b}, x AS (SELECT *, row_number() OVER {w} - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM bars) SELECT series_id, timestamp_utc_ms, round(close, 6) AS close FROM x WHERE i IN (SELECT j * (x.n - 1) // 10 FROM range(11) g(j))",
        "dataset_rows": f"""WITH {b}, x AS (SELECT *, ln(close) AS lc, ln(close) - lag(ln(close)) OVER {w} AS r FROM bars), y AS (SELECT *, lc - lag(lc, 5) OVER {w} AS r5, {o.roll('stddev_samp', 'r', 7)} AS v, {o.net_label(5, 25)} AS l FROM x)
SELECT y.series_id, y.timestamp_utc_ms, round(y.r, 6) + 0.0 AS feat_ret_log_1, round(y.r5, 6) + 0.0 AS feat_ret_log_5, round(y.v, 6) + 0.0 AS feat_rv_std_7, CAST(y.l AS DOUBLE) AS label_dir_h5_thr25bps, round(z.r, 6) + 0.0 AS xasset_view_feat_ret_log_1, round(z.r5, 6) + 0.0 AS xasset_view_feat_ret_log_5, CASE y.series_id WHEN 'click' THEN 12.0 ELSE 20.0 END + 0.0 AS cost_fee_bps, CASE y.series_id WHEN 'click' THEN 12.0 ELSE 15.0 END + 0.0 AS cost_slippage_bps, y.l IS NOT NULL AS is_trainable, 1.0 AS sample_weight FROM y LEFT JOIN y z ON z.series_id = 'view' AND z.timestamp_utc_ms = y.timestamp_utc_ms AND y.series_id <> 'view'""",
        "windows": f"""WITH RECURSIVE {b}, n AS (SELECT series_id, count(*) AS n FROM bars GROUP BY 1),
w AS (SELECT series_id, n, 1 AS window_id, 0 AS train_start FROM n WHERE least(400, n) - 300 >= 50 UNION ALL SELECT series_id, n, window_id + 1, train_start + 100 FROM w WHERE least(train_start + 400, n) < n AND least(train_start + 500, n) - (train_start + 400) >= 50)
SELECT series_id, CAST(window_id AS INTEGER) AS window_id, CAST(train_start AS BIGINT) AS train_start, CAST(train_start + 300 AS BIGINT) AS train_end, CAST(least(train_start + 400, n) AS BIGINT) AS test_end FROM w""",
        "trade_candidates": f"WITH {cand} SELECT series_id, timestamp_utc_ms, side, entry_ts, exit_ts, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price FROM cand",
        "curve": f"WITH {eq} SELECT series_id, entry_ts, exit_ts, round(net_bps, 5) + 0.0 AS net_bps, round(equity, 5) + 0.0 AS equity, round(drawdown, 5) + 0.0 AS drawdown FROM f",
        "trade_metrics": f"""WITH {eq}, l AS (SELECT series_id, max(c) AS longest_loss_run FROM (SELECT series_id, wins, count(*) AS c FROM f WHERE net_bps <= 0 GROUP BY 1, 2) GROUP BY 1)
SELECT series_id, count(*) AS trades, round(arg_max(equity, n) - 1, 4) + 0.0 AS total_return, round(min(drawdown), 4) + 0.0 AS max_drawdown, round(avg(CASE WHEN net_bps > 0 THEN 1 ELSE 0 END), 4) AS win_rate, round(sum(CASE WHEN net_bps > 0 THEN net_bps END) / -sum(CASE WHEN net_bps <= 0 THEN net_bps END), 4) AS profit_factor, round(avg(net_bps), 4) + 0.0 AS mean_net_bps, any_value(longest_loss_run) AS longest_loss_run FROM f LEFT JOIN l USING (series_id) GROUP BY series_id""",
        "stressed": f"""WITH {cand}, s(scenario, f, s, m, u, x) AS (VALUES {scen}), y AS (SELECT series_id, scenario, entry_ts, exit_ts, gross - 20.0 * f - 10.0 * s - 4.0 * m - 2.0 * u - x AS net FROM t, s),
z AS (SELECT *, 10000.0 + sum(10.0 * net / 1e4) OVER {run} AS eq FROM y), q AS (SELECT *, eq / greatest(10000.0, max(eq) OVER {run}) - 1 AS dd FROM z)
SELECT series_id, scenario, count(*) AS trades, round(sum(net), 3) + 0.0 AS net_bps_sum, round(avg(CASE WHEN net > 0 THEN 1 ELSE 0 END), 3) AS win_rate, round(arg_max(eq, (exit_ts, entry_ts)) / 10000.0 - 1, 3) + 0.0 AS total_return, round(min(dd), 3) + 0.0 AS max_drawdown FROM q GROUP BY 1, 2""",
        "top_trades": f"WITH {cand} SELECT series_id, timestamp_utc_ms, round(net_bps, 4) AS net_bps FROM t ORDER BY t.net_bps DESC, series_id, timestamp_utc_ms LIMIT 10",
        "ranks": f"WITH {b}, x AS (SELECT *, {g5} AS g FROM bars) SELECT series_id, timestamp_utc_ms, CASE WHEN g IS NOT NULL THEN round(percent_rank() OVER (PARTITION BY timestamp_utc_ms ORDER BY g NULLS FIRST), 6) + 0.0 END AS label_fwd_ret_gross_long_h5_rank FROM x",
        "experiment_registry": f"WITH {cand}, m AS (SELECT series_id, count(*) AS trades FROM t WHERE series_id <> 'view' GROUP BY 1), n AS (SELECT series_id, count(*) AS rows FROM bars GROUP BY 1) SELECT series_id, 'exp_' || series_id AS experiment_id, trades, rows, CASE WHEN series_id = 'click' THEN 'BLOCKED_DATA_QUALITY' WHEN trades IS NULL THEN 'NEEDS_BACKTEST_REVIEW' ELSE 'RESEARCH_REGISTERED' END AS status, substr(sha256('exp_' || series_id || '|' || series_id), 1, 16) AS registry_hash FROM n LEFT JOIN m USING (series_id)",
    }
    atr = o.div(o.roll("avg", "tr", 14), "close")
    out["barrier_vol"] = f"SELECT series_id, side, event, count(*) AS n, CAST(sum(holding_bars) AS BIGINT) AS bars FROM ({o.barrier_sql(labels.barrier_grid('atr', (1.0,), (1.5,), (8,)), atr)}) GROUP BY 1, 2, 3"
    return out

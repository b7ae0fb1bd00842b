"""Queries of naming, triage, summaries and extensions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import backtest, extensions, features, quality, summaries, triage
from ..sources import bars as src
from ..sources import shape, synthetic
from . import oracle as o
from . import research
from .extra import _r, _rounded

STEP = 3_600_000


def _paths(spark, d) -> DataFrame:
    """Names as files of a catalog would have them."""
    folders = F.array(*[F.lit(x) for x in (r"D:\data\raw\ohlcv\Binance_Spot\BTC\x_5min.parquet", "/data/processed/ohlcv/bybit_linear/ETH/x_4h.parquet", "/data/custom_timeframes/ohlcv/mine/x_3D.parquet", "/data/_logs/x.json", "/elsewhere/open_interest/desk/x_30s.parquet")])
    tf = F.array(*[F.lit(x) for x in ("5min", "4h", "3D", "what", "30s")])
    i = (F.col("n_nationkey") % 5).cast("int") + 1
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.element_at(folders, i).alias("path"), F.element_at(tf, i).alias("tf"))


def names_read(spark, d):
    s = names.timeframe_seconds(F.col("tf"))
    label = F.concat(F.lit("label_dir_h"), F.col("n_nationkey").cast("string"), F.lit("_thr5bps"))
    return _r(_paths(spark, d).select("n_nationkey", names.source_of(F.col("path")).alias("source"), names.location_of(F.col("path")).alias("location"), s.alias("seconds"), names.annualization(F.col("tf")).alias("bars_a_year"), names.timeframe_label(s).alias("label"), names.horizon_bars(label).alias("horizon")))


def local_times(spark, d):
    x = src.bars(spark, d).select("series_id", "timestamp_utc_ms", shape.to_local(F.col("timestamp_utc_ms")).alias("t"))
    return x.select("series_id", "timestamp_utc_ms", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("local_time"), shape.from_local(F.col("t")).alias("back_ms"))


def triaged(spark, d):
    x = triage.gate(triage.enriched(triage.records(src.bars(spark, d), STEP)).withColumn("audit_status", F.lit("PASS")))
    return x.select("series_id", "rows", "gap_count", "return_outlier_count", "status", "root_cause", "cause_family", "ml_quality_status", "ml_gate", "ml_gate_usable")


def warning_classes(spark, d):
    return triage.warnings_long(triage.records(src.bars(spark, d), STEP))


def contract(spark, d):
    return triage.input_contract(src.bars(spark, d)).withColumn("errors", F.array_join("errors", ","))


def covered(spark, d):
    parts = None
    for label, seconds in (("1h", 3600), ("4h", 14400)):
        x = src.bars(spark, d, seconds).groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp_utc_ms").alias("first_ms"), F.max("timestamp_utc_ms").alias("last_ms"))
        x = x.select(F.col("series_id").alias("asset"), F.lit(label).alias("timeframe"), "rows", "first_ms", "last_ms", summaries.batches(F.col("first_ms"), F.col("last_ms"), seconds * 1000).alias("pages"))
        parts = x if parts is None else parts.unionByName(x)
    return summaries.coverage(parts, ("asset",)).join(parts.groupBy("asset").agg(F.sum("pages").alias("pages")), "asset")


def quality_rows(spark, d):
    x = features.features(src.bars(spark, d), {"sma": (7,), "volatility": (7,)})
    cols = [c for c in x.columns if c.startswith("feat_")]
    return summaries.quality_summary(quality.validity(x, cols, 20), cols)


def balance(spark, d):
    from ..operators import labels

    return _r(summaries.label_balance(labels.directional(src.bars(spark, d), (3, 5), (25, 100)), ["label_dir_h3_thr25bps", "label_dir_h5_thr100bps"]))


def first_bars(spark, d):
    return _r(summaries.first_of_each(src.bars(spark, d), ["series_id"], "timestamp_utc_ms"))


def edges(spark, d):
    return summaries.edges_hash(src.bars(spark, d))


def bars_as_of(spark, d):
    """Hourly bars with the latest four-hour bar that closed by then, no older than six hours."""
    slow = src.bars(spark, d, 14400).select("series_id", "timestamp_utc_ms", F.col("close").alias("slow_close"))
    return _r(extensions.as_of(src.bars(spark, d), slow, ["slow_close"], most_ms=6 * STEP).select("series_id", "timestamp_utc_ms", "slow_close"))


def feat_slopes(spark, d):
    return _r(extensions.slopes(src.bars(spark, d)).select("series_id", "timestamp_utc_ms", "feat_slope_20", "feat_slope_50"))


def feat_entropy(spark, d):
    return _r(extensions.entropy(src.bars(spark, d)).select("series_id", "timestamp_utc_ms", "feat_entropy_20", "feat_entropy_50"))


def label_relative(spark, d):
    from ..operators import labels

    x = labels.forward_returns(src.bars(spark, d), (5,))
    return _r(extensions.against_benchmark(x, "label_fwd_ret_gross_long_h5", "view").select("series_id", "timestamp_utc_ms", "label_rel_fwd_ret_gross_long_h5"))


def sinusoid_bars(spark, d):
    return _r(synthetic.sinusoid(spark), 6)


def long_series(spark, d):
    return shape.long_enough(src.bars(spark, d), "1h").groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))


def aliased(spark, d):
    x = src.bars(spark, d)
    x = x.select("series_id", F.col("timestamp_utc_ms").alias("UTC_Timestamp_ms"), F.col("open").cast("string").alias("O"), F.col("high").alias("h"), F.col("low").alias("Low"), F.when(F.col("close") > 50, F.col("close").cast("string")).otherwise("n/a").alias("C"), F.col("volume").alias("Vol"))
    return _r(shape.coerced(shape.renamed(x)))


def _shares(spark, d) -> DataFrame:
    return research.all_candidates(spark, d).withColumn("portfolio_return", F.col("net_bps") / 1e4 * 0.00001)


def performances(spark, d):
    out = backtest.performance(_shares(spark, d), ["series_id"])
    return _r(out.withColumn("score", backtest.score()), 4)


def trade_groups(spark, d):
    return _r(backtest.trade_groups(_shares(spark, d), ("series_id", "side")), 4)


def executed_signals(spark, d):
    """Outcomes of signals on the bars' own volumes; folded over time, so without SQL."""
    x = research.all_candidates(spark, d)
    paths = F.col("gross_bps")
    x = x.select("series_id", "timestamp_utc_ms", "entry_ts", "exit_ts", F.when(F.col("side") == 1, 0.9).otherwise(0.1).alias("proba"), (paths * F.col("side")).alias("gross_bps"), F.greatest(paths * F.col("side"), F.lit(0.0)).alias("best_bps"), F.least(paths * F.col("side"), F.lit(0.0)).alias("worst_bps"), F.lit(22.0).alias("fixed_cost_bps"), F.lit(1.0).alias("funding_bps"), (F.col("close") * F.col("volume")).alias("quote_volume"))
    return backtest.outcomes(backtest.execute(x, ["series_id"], backtest.Rules(switch=0.0)), ["series_id"])


OWN = (performances, trade_groups, executed_signals, names_read, local_times, triaged, warning_classes, contract, covered, quality_rows, balance, first_bars, edges, bars_as_of, feat_slopes, feat_entropy, label_relative, sinusoid_bars, long_series, aliased)


def queries() -> dict:
    return {f.__name__: f for f in OWN}


def oracle_sql() -> dict[str, str]:
    b = o.bars_sql()
    d = f"timestamp_utc_ms - lag(timestamp_utc_ms) OVER {o.W}"
    prices = _rounded({c: c for c in ("open", "high", "low", "close", "volume")})
    rec = f"""{b}, x AS (SELECT *, {d} AS d, abs({o.div('close', o.lag('close'))} - 1) AS j FROM bars),
a AS (SELECT series_id, count(*) AS rows, count(*) FILTER (d > 1.5 * {STEP}) AS gap_count, count(*) FILTER (j > 0.5) AS return_outlier_count FROM x GROUP BY 1),
f AS (SELECT *, rows < 300 AS short, gap_count > 0 AS gaps, return_outlier_count > 0 AS jumps, gap_count / rows > 0.001 AS gb, return_outlier_count / rows > 0.001 AS jb FROM a)"""
    lr = "ln(close)"
    five = f"({o.div(o.lead('close', 5), 'close')} - 1)"
    dir_ = o.net_label
    bits = lambda w: " + ".join(f"CASE WHEN avg(CAST(sign(r) = {k} AS INT)) OVER {o.frame(1 - w, 0)} > 0 THEN -avg(CAST(sign(r) = {k} AS INT)) OVER {o.frame(1 - w, 0)} * log2(avg(CAST(sign(r) = {k} AS INT)) OVER {o.frame(1 - w, 0)}) ELSE 0 END" for k in (-1, 0, 1))
    i = "range * 1.0"
    taken = research.oracle_sql()["curve"].split(", e AS (")[0]
    so_far = "(PARTITION BY series_id ORDER BY exit_ts, entry_ts ROWS UNBOUNDED PRECEDING)"
    perf = {"total_return": "arg_max(eq, n) - 1", "max_drawdown": "min(dd)", "win_rate": "avg(CAST(r > 0 AS INT))", "profit_factor": "sum(CASE WHEN r > 0 THEN r ELSE 0 END) / nullif(abs(sum(CASE WHEN r < 0 THEN r END)), 0)", "avg_trade_net_bps": "avg(net_bps)", "median_trade_net_bps": "quantile_cont(net_bps, 0.5)", "best_trade": "max(r)", "worst_trade": "min(r)", "coverage_days": "(max(exit_ts) - min(entry_ts)) / 86400000"}
    return {
        "performances": f"""{taken}, s AS (SELECT series_id, entry_ts, exit_ts, net_bps, net_bps / 1e4 * 0.00001 AS r FROM t),
e AS (SELECT *, exp(sum(ln(1 + greatest(-0.99, r))) OVER {so_far}) AS eq, row_number() OVER {so_far.replace(' ROWS UNBOUNDED PRECEDING', '')} AS n, sum(CAST(r >= 0 AS INT)) OVER {so_far} AS island FROM s), q AS (SELECT *, eq / max(eq) OVER {so_far} - 1 AS dd FROM e),
k AS (SELECT series_id, max(c) AS longest_losing_streak FROM (SELECT series_id, island, count(*) AS c FROM e WHERE r < 0 GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT series_id, count(*) AS total_trades, {', '.join(f'{v} AS {c}' for c, v in perf.items())} FROM q GROUP BY 1), h AS (SELECT *, CASE WHEN coverage_days > 0 THEN pow(1 + total_return, 365.0 / coverage_days) - 1 END AS cagr FROM g),
m AS (SELECT *, cagr / nullif(abs(max_drawdown), 0) AS calmar, coalesce(cagr >= 0.3, FALSE) AS meets_target, abs(max_drawdown) <= 0.2 AS within_drawdown FROM h)
SELECT series_id, total_trades, {_rounded({c: c for c in (*perf, 'cagr', 'calmar')}, 4)}, meets_target, within_drawdown, CASE WHEN coverage_days >= 30 AND total_trades >= 30 THEN 'RESEARCH_METRICS_READY' ELSE 'RESEARCH_ONLY_INSUFFICIENT_SAMPLE' END AS status, coalesce(longest_losing_streak, 0) AS longest_losing_streak,
round(coalesce(cagr, -1) - 3.0 * greatest(0.0, abs(max_drawdown) - 0.2) + 0.10 * coalesce(profit_factor, 0) + 0.05 * win_rate + CASE WHEN meets_target AND within_drawdown THEN 0.5 ELSE 0 END - CASE WHEN total_trades < 30 THEN 0.2 ELSE 0 END, 4) + 0.0 AS score FROM m LEFT JOIN k USING (series_id)""",
        "trade_groups": f"{taken} SELECT series_id, side, count(*) AS trades, {_rounded({'avg_net_bps': 'avg(net_bps)', 'win_rate': 'avg(CAST(net_bps > 0 AS INT))', 'total_slot_return': 'sum(net_bps / 1e4 * 0.00001)'}, 4)} FROM t GROUP BY 1, 2",
        "names_read": """WITH p(i, source, location, seconds, year, label) AS (VALUES (0, 'binance_spot', 'raw', 300, 105120.0, '5min'), (1, 'bybit_linear', 'processed', 14400, 2190.0, '4h'), (2, 'mine', 'custom_timeframes', 259200, 121.666667, '3D'), (3, NULL, 'logs', NULL, 365.0, NULL), (4, 'desk', 'unknown', 30, 1051200.0, '30s'))
SELECT n_nationkey, source, location, CAST(seconds AS BIGINT) AS seconds, CAST(year AS DOUBLE) AS bars_a_year, label, CAST(n_nationkey AS INTEGER) AS horizon FROM nation JOIN p ON n_nationkey % 5 = i""",
        "local_times": f"WITH {b} SELECT series_id, timestamp_utc_ms, strftime(make_timestamp(timestamp_utc_ms * 1000 + 14400000000), '%Y-%m-%d %H:%M:%S') AS local_time, timestamp_utc_ms AS back_ms FROM bars",
        "triaged": f"""WITH {rec}, g AS (SELECT *, CASE WHEN short OR gaps OR jumps THEN 'WARNING' ELSE 'PASS' END AS status, CASE WHEN gaps THEN 'TIME_GAPS' WHEN short THEN 'SHORT_HISTORY' WHEN jumps THEN 'RETURN_OUTLIERS' ELSE 'NO_ISSUE_DETECTED' END AS root_cause,
CASE WHEN gaps THEN 'time_grid' WHEN short THEN 'data_volume' WHEN jumps THEN 'market_data_values' ELSE 'none' END AS cause_family, CASE WHEN NOT (short OR gaps OR jumps) THEN 'ML_READY' WHEN short OR gb OR jb THEN 'ML_BLOCKED' ELSE 'ML_CAUTION' END AS ml_quality_status FROM f)
SELECT series_id, rows, gap_count, return_outlier_count, status, root_cause, cause_family, ml_quality_status, CASE ml_quality_status WHEN 'ML_CAUTION' THEN 'ML_CAUTION_ACCEPTABLE' ELSE ml_quality_status END AS ml_gate, ml_quality_status <> 'ML_BLOCKED' AS ml_gate_usable FROM g""",
        "warning_classes": f"""WITH {rec} SELECT series_id, 'histórico curto' AS warning, 'SHORT_HISTORY' AS code, 'ML_BLOCKED' AS ml_status, TRUE AS blocking FROM f WHERE short
UNION ALL SELECT series_id, 'gaps temporais', CASE WHEN gb THEN 'TIME_GAPS_MATERIAL' ELSE 'TIME_GAPS_SMALL' END, CASE WHEN gb THEN 'ML_BLOCKED' ELSE 'ML_CAUTION' END, gb FROM f WHERE gaps
UNION ALL SELECT series_id, 'retornos absolutos', CASE WHEN jb THEN 'RETURN_OUTLIERS_MATERIAL' ELSE 'RETURN_OUTLIERS_SMALL' END, CASE WHEN jb THEN 'ML_BLOCKED' ELSE 'ML_CAUTION' END, jb FROM f WHERE jumps""",
        "contract": f"""WITH {b} SELECT series_id, count(*) AS rows, count(*) - count(DISTINCT timestamp_utc_ms) AS timestamp_duplicate_count, count(*) - count(timestamp_utc_ms) AS timestamp_null_count, CAST(0 AS BIGINT) AS timestamp_falling_count,
{', '.join(f'count(*) FILTER ({c} <= 0) AS {c}_non_positive_count' for c in ('open', 'high', 'low', 'close'))}, count(*) FILTER (volume < 0) AS volume_negative_count, count(*) FILTER (high < low) AS high_lt_low_count,
count(*) FILTER (close > high OR close < low) AS close_outside_count, count(*) FILTER (open > high OR open < low) AS open_outside_count, '' AS errors, 'PASS' AS status FROM bars GROUP BY 1""",
        "covered": f"""WITH {b}, {o.bars_sql(14400, 'slow').replace('ticks AS', 'ticks2 AS').replace('origin AS', 'origin2 AS').replace('FROM ticks ', 'FROM ticks2 ').replace('JOIN origin ', 'JOIN origin2 ')},
s AS (SELECT series_id AS asset, '1h' AS tf, 3600000 AS st, timestamp_utc_ms AS t FROM bars UNION ALL SELECT series_id, '4h', 14400000, timestamp_utc_ms FROM slow),
g AS (SELECT asset, tf, count(*) AS n, min(t) AS a, max(t) AS z, ceil(((max(t) - min(t)) / any_value(st) + 1) / 1000) AS p FROM s GROUP BY 1, 2)
SELECT asset, count(*) AS series, string_agg(tf, ',' ORDER BY tf) AS timeframes, CAST(sum(n) AS BIGINT) AS rows, min(a) AS first_ms, max(z) AS last_ms, CAST(sum(p) AS BIGINT) AS pages FROM g GROUP BY 1""",
        "quality_rows": f"""WITH {b}, {o.PREPARED}, k AS (SELECT series_id, timestamp_utc_ms, row_number() OVER {o.W} - 1 AS p, count(close) OVER {o.frame(-6, 0)} AS nc, count(r) OVER {o.frame(-6, 0)} AS nr FROM c)
SELECT series_id, count(*) AS rows, count(*) FILTER (p < 20) AS warmup_rows, count(*) FILTER (p >= 20) AS valid_rows, CAST(sum(CASE WHEN nc < 7 THEN 2 ELSE 0 END + CASE WHEN nr < 7 THEN 4 ELSE 0 END) AS BIGINT) AS null_values, min(timestamp_utc_ms) AS first_ms, max(timestamp_utc_ms) AS last_ms, min(timestamp_utc_ms) FILTER (p >= 20) AS first_valid_ms FROM k GROUP BY 1""",
        "balance": f"""WITH {b}, l AS (SELECT {dir_(3, 25)} AS a, {dir_(5, 100)} AS c FROM bars), u AS (SELECT 'label_dir_h3_thr25bps' AS label, a AS v FROM l UNION ALL SELECT 'label_dir_h5_thr100bps', c FROM l)
SELECT label, count(*) AS rows, CAST(0 AS BIGINT) AS missing, {_rounded({'above': 'avg(CAST(v > 0 AS INT))', 'zero': 'avg(CAST(v = 0 AS INT))', 'below': 'avg(CAST(v < 0 AS INT))'})} FROM u GROUP BY 1""",
        "first_bars": f"WITH {b} SELECT series_id, timestamp_utc_ms, {prices} FROM bars QUALIFY row_number() OVER {o.W} = 1",
        "edges": f"""WITH {b}, k AS (SELECT *, row_number() OVER {o.W} AS u, row_number() OVER (PARTITION BY series_id ORDER BY timestamp_utc_ms DESC) AS v FROM bars)
SELECT series_id, sha256(string_agg(concat_ws(',', CAST(timestamp_utc_ms AS VARCHAR), {', '.join(f'CAST(CAST(round({c} * 10000) AS BIGINT) AS VARCHAR)' for c in ('open', 'high', 'low', 'close'))}), chr(10) ORDER BY timestamp_utc_ms)) AS edges FROM k WHERE u <= 5 OR v <= 5 GROUP BY 1""",
        "bars_as_of": f"""WITH {b}, {o.bars_sql(14400, 'slow').replace('ticks AS', 'ticks2 AS').replace('origin AS', 'origin2 AS').replace('FROM ticks ', 'FROM ticks2 ').replace('JOIN origin ', 'JOIN origin2 ')}
SELECT h.series_id, h.timestamp_utc_ms, CASE WHEN h.timestamp_utc_ms - s.timestamp_utc_ms <= {6 * STEP} THEN round(s.close, 6) + 0.0 END AS slow_close FROM bars h ASOF LEFT JOIN slow s ON h.series_id = s.series_id AND h.timestamp_utc_ms >= s.timestamp_utc_ms""",
        "feat_slopes": f"""WITH {b}, x AS (SELECT series_id, timestamp_utc_ms, {lr} AS y, CAST(row_number() OVER {o.W} AS DOUBLE) AS x FROM bars)
SELECT series_id, timestamp_utc_ms, {_rounded({f'feat_slope_{w}': f'CASE WHEN count(y) OVER {o.frame(1 - w, 0)} = {w} THEN regr_slope(y, x) OVER {o.frame(1 - w, 0)} END' for w in (20, 50)})} FROM x""",
        "feat_entropy": f"""WITH {b}, x AS (SELECT series_id, timestamp_utc_ms, {lr} - {o.lag(lr)} AS r FROM bars)
SELECT series_id, timestamp_utc_ms, {_rounded({f'feat_entropy_{w}': f'CASE WHEN count(r) OVER {o.frame(1 - w, 0)} = {w} THEN {bits(w)} END' for w in (20, 50)})} FROM x""",
        "label_relative": f"""WITH {b}, x AS (SELECT series_id, timestamp_utc_ms, {five} AS g FROM bars)
SELECT a.series_id, a.timestamp_utc_ms, round(a.g - v.g, 6) + 0.0 AS label_rel_fwd_ret_gross_long_h5 FROM x a LEFT JOIN (SELECT * FROM x WHERE series_id = 'view') v USING (timestamp_utc_ms) WHERE a.series_id <> 'view'""",
        "sinusoid_bars": f"""WITH x AS (SELECT range AS i, 100.0::DOUBLE + {i} * 30 / 699 + 2 * sin({i} / 7) + 4 * sin({i} / 31) AS close, 1000 + 100 * sin({i} / 5) AS volume FROM range(700)),
y AS (SELECT *, close * (1 + 0.001 * sin(i * 1.0 / 11)) AS open FROM x)
SELECT 'sinusoid' AS series_id, 1577836800000 + i * 60000 AS timestamp_utc_ms, {_rounded({'open': 'open', 'high': 'greatest(open, close) * 1.002', 'low': 'least(open, close) * 0.998', 'close': 'close', 'volume': 'volume'})} FROM y""",
        "long_series": f"WITH {b} SELECT series_id, count(*) AS rows FROM bars GROUP BY 1 HAVING count(*) >= 300",
        "aliased": f"WITH {b} SELECT series_id, timestamp_utc_ms, {_rounded({'open': 'open', 'high': 'high', 'low': 'low', 'close': 'CASE WHEN close > 50 THEN close END', 'volume': 'volume'})} FROM bars",
    }

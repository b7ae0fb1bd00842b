"""Queries of costs, checks, further labels and windows in blocks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import in_blocks, positions
from ..operators import checks, costs, dataset, features, labels, registry
from ..sources import bars as src
from . import oracle as o
from . import research

STEP = 3_600_000
CASES = "CASE length(series_id) % 3 WHEN 0 THEN 'binance_spot' WHEN 1 THEN 'bybit_linear' ELSE 'kraken' END"


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _labels(df: DataFrame) -> DataFrame:
    return _r(dataset.by_prefix(df, ("label_",), ("series_id", "timestamp_utc_ms")))


def label_risk_reward(spark, d):
    return _labels(labels.risk_reward(src.bars(spark, d), (5, 20), (0.75, 1.5, 3.0)))


def label_tail_events(spark, d):
    return _labels(labels.tail_events(src.bars(spark, d), (5, 20), (50, 500)))


def barrier_configs(spark, d):
    rows = [(c["config_id"], c["kind"], c["window"], float(c["stop"]), float(c["take"]), c["horizon"]) for c in labels.full_grid()]
    x = spark.createDataFrame(rows, "config_id string, kind string, window int, stop double, take double, horizon int")
    return _r(x.drop("config_id"))


def label_meta(spark, d):
    g = labels.barrier_grid()
    x = labels.meta_labels(labels.triple_barrier(src.bars(spark, d), g), g)
    return x.groupBy("series_id", "config_id", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("meta_success_net").alias("paid"))


def feat_volatility_blocks(spark, d):
    x = in_blocks(src.bars(spark, d), lambda b: features.features(b, {"volatility": (7, 41)}), back=42, rows=128)
    return _r(dataset.by_prefix(x, ("feat_",), ("series_id", "timestamp_utc_ms")))


def label_tail_blocks(spark, d):
    return _labels(in_blocks(src.bars(spark, d), lambda b: labels.tail_events(b, (5, 20), (50, 500)), back=0, ahead=20, rows=128))


def row_positions(spark, d):
    return positions(src.bars(spark, d)).select("series_id", "timestamp_utc_ms", F.col("_p").alias("position"))


def execution_costs(spark, d):
    x = src.bars(spark, d).withColumn("source", F.expr(CASES))
    x = costs.with_costs(x, 0.25, 1000.0, spread=1.0)
    x = costs.position_size(x, F.lit(10_000.0))
    x = x.withColumns({"long_price": costs.entry_price(F.lit("long"), F.col("slippage_bps")), "short_limit_price": costs.entry_price(F.lit("short"), F.col("slippage_bps"), True)})
    return _r(x.select("series_id", "timestamp_utc_ms", "slippage_bps", "funding_bps", "total_cost_bps", "volume_participation", "requested_notional", "fill_ratio", "filled_notional", "long_price", "short_limit_price"), 8)


def path_exits(spark, d):
    x = labels.tail_events(labels.forward_returns(src.bars(spark, d), (5,)), (5,), ())
    e = costs.path_exit(F.col("label_fwd_ret_gross_long_h5") * 1e4, F.col("label_future_tail_up_bps_h5"), F.col("label_future_tail_down_bps_h5"), 4000.0, 9000.0)
    return _r(x.withColumn("_e", e).select("series_id", "timestamp_utc_ms", "_e.*"))


def grid_check(spark, d):
    return _r(checks.time_grid(src.bars(spark, d), STEP))


def rows_preserved(spark, d):
    b = src.bars(spark, d)
    return checks.preserved(b, features.features(b, {"returns": (1,)}), ["open", "high", "low", "close", "volume"])


def labels_audited(spark, d):
    x = labels.forward_returns(labels.directional(src.bars(spark, d), (3,), (25,)), (5,))
    return _r(checks.label_audit(x, ["label_dir_h3_thr25bps", "label_fwd_ret_gross_long_h5"]), 5)


def trades_checked(spark, d):
    from ..operators import portfolio

    t = research.all_candidates(spark, d)
    return checks.trades(t, portfolio.equity_curve(t, ["series_id"], 0.001))


def registry_checked(spark, d):
    return checks.registry(research.experiment_registry(spark, d))


def strategy(spark, d):
    x = labels.forward_returns(features.features(src.bars(spark, d), {"returns": (1,)}), (5,))
    x = x.withColumn("p", 1 / (1 + F.exp(F.col("feat_ret_log_1")))).withColumn("ret", F.col("label_fwd_ret_net_long_h5") * 0.001)
    return _r(dataset.strategy_proxy(x, "p", "ret", ["series_id"]), 5)


def latest_bars(spark, d):
    return _r(registry.latest(src.bars(spark, d), "series_id", "timestamp_utc_ms"))


OWN = (label_risk_reward, label_tail_events, barrier_configs, label_meta, feat_volatility_blocks, label_tail_blocks, row_positions, execution_costs, path_exits, grid_check, rows_preserved, labels_audited, trades_checked, registry_checked, strategy, latest_bars)


def queries() -> dict:
    return {f.__name__: f for f in OWN}


def _rounded(cols: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round({v}, {digits}) + 0.0 AS {k}" for k, v in cols.items())


def oracle_sql() -> dict[str, str]:
    b = o.bars_sql()
    up = {h: f"({o.div(f'max(high) OVER {o.frame(1, h)}', 'close')} - 1)" for h in (5, 20)}
    down = {h: f"({o.div(f'min(low) OVER {o.frame(1, h)}', 'close')} - 1)" for h in (5, 20)}
    rr, tails = {}, {}
    for h in (5, 20):
        ratio = o.div(up[h], f"abs({down[h]})")
        rr[f"label_future_rr_long_h{h}"] = ratio
        rr |= {f"label_future_rr_long_h{h}_gt_{n}": o.flag(f"{ratio} >= {t}") for n, t in (("0_75", 0.75), ("1_5", 1.5), ("3_0", 3.0))}
        tails |= {f"label_future_tail_up_bps_h{h}": f"{up[h]} * 1e4", f"label_future_tail_down_bps_h{h}": f"{down[h]} * 1e4"}
        for t in (50, 500):
            tails |= {f"label_tail_up_h{h}_gt_{t}bps": o.flag(f"{up[h]} * 1e4 >= {t}"), f"label_tail_down_h{h}_lt_{t}bps": o.flag(f"{down[h]} * 1e4 <= -{t}")}
    tail_sql = f"WITH {b} SELECT series_id, timestamp_utc_ms, {_rounded(tails)} FROM bars"
    g5 = f"({o.div(o.lead('close', 5), 'close')} - 1)"
    d = f"timestamp_utc_ms - lag(timestamp_utc_ms) OVER {o.W}"
    res = research.oracle_sql()
    curve = res["curve"].rsplit(" SELECT ", 1)[0]
    true_rows = lambda *names: " UNION ALL ".join(f"SELECT '{n}' AS name, {c} AS passed" for n, c in names)
    out = {
        "label_risk_reward": f"WITH {b} SELECT series_id, timestamp_utc_ms, {_rounded(rr)} FROM bars",
        "label_tail_events": tail_sql,
        "label_tail_blocks": tail_sql,
        "feat_volatility_blocks": o.family_sql("volatility", (7, 41), 6),
        "row_positions": f"WITH {b} SELECT series_id, timestamp_utc_ms, row_number() OVER {o.W} - 1 AS position FROM bars",
        "barrier_configs": """WITH v AS (SELECT 'vol' AS kind, w AS "window", s AS stop, t AS take, h AS horizon FROM (VALUES (20), (50), (100)) a(w), (VALUES (0.75), (1.0), (1.5)) b(s), (VALUES (1.0), (1.5), (2.0), (3.0)) c(t), (VALUES (8), (16), (32), (64), (128)) e(h)
UNION ALL SELECT 'atr', w, s, t, h FROM (VALUES (14), (21), (50)) a(w), (VALUES (0.75), (1.0), (1.5)) b(s), (VALUES (1.0), (1.5), (2.0)) c(t), (VALUES (8), (16), (32), (64)) e(h)
UNION ALL SELECT 'fixed', 0, s / 1e4, t / 1e4, h FROM (VALUES (15.0), (25.0), (50.0), (75.0), (100.0), (150.0)) b(s), (VALUES (20.0), (40.0), (75.0), (100.0), (150.0), (250.0)) c(t), (VALUES (5), (10), (20), (30), (60), (120)) e(h) WHERE t > 0.5 * s)
SELECT kind, CAST("window" AS INTEGER) AS "window", round(CAST(stop AS DOUBLE), 6) + 0.0 AS stop, round(CAST(take AS DOUBLE), 6) + 0.0 AS take, CAST(horizon AS INTEGER) AS horizon FROM v""",
        "label_meta": f"WITH tb AS ({o.barrier_sql(labels.barrier_grid())}) SELECT series_id, config_id, side, count(*) AS n, sum(CASE WHEN label = 1.0 AND gross_return - 0.0035 > 0 THEN 1.0 ELSE 0.0 END) AS paid FROM tb GROUP BY 1, 2, 3",
        "execution_costs": f"""WITH {b}, s AS (SELECT *, {CASES} AS source, CASE WHEN volume > 0 THEN close * volume ELSE 0.0 END AS qv FROM bars),
c AS (SELECT *, coalesce(1000.0 / nullif(qv, 0), 0.0) AS part, CASE source WHEN 'binance_spot' THEN 0.0 WHEN 'bybit_linear' THEN 0.5 ELSE 0.45 END AS fund, least(10000.0 * 0.005 * 1e4 / 70.0, 2000.0) AS asked FROM s),
e AS (SELECT *, 15.0 + least(part, 0.02) * 250.0 AS slip, CASE WHEN qv <= 0 THEN 0.5 ELSE least(1.0, greatest(0.1, qv * 0.02 / asked)) END AS fill FROM c)
SELECT series_id, timestamp_utc_ms, {_rounded({'slippage_bps': 'slip', 'funding_bps': 'fund', 'total_cost_bps': '22.0 + slip + fund', 'volume_participation': 'part', 'requested_notional': 'asked', 'fill_ratio': 'fill', 'filled_notional': 'asked * fill', 'long_price': 'least(greatest(open * (1 + slip / 2 / 1e4), low), high)', 'short_limit_price': 'least(greatest(close * (1 - slip / 2 * 0.35 / 1e4), low), high)'}, 8)} FROM e""",
        "path_exits": f"""WITH {b}, x AS (SELECT series_id, timestamp_utc_ms, {g5} * 1e4 AS g, {up[5]} * 1e4 AS u, {down[5]} * 1e4 AS l FROM bars),
y AS (SELECT *, CASE WHEN u IS NULL OR l IS NULL THEN 'HORIZON_NO_PATH_LABELS' WHEN abs(l) >= 4000 THEN 'STOP_LOSS_CONSERVATIVE' WHEN u >= 9000 THEN 'TAKE_PROFIT' ELSE 'HORIZON' END AS reason FROM x)
SELECT series_id, timestamp_utc_ms, round(CASE reason WHEN 'STOP_LOSS_CONSERVATIVE' THEN -4000.0 WHEN 'TAKE_PROFIT' THEN 9000.0 ELSE g END, 6) + 0.0 AS gross_bps, reason FROM y""",
        "grid_check": f"""WITH {b}, x AS (SELECT series_id, {d} AS d FROM bars), a AS (SELECT series_id, count(d) AS total_deltas, round(quantile_cont(d, 0.5), 6) + 0.0 AS median_delta_ms, min(d) AS min_delta_ms, max(d) AS max_delta_ms, count(*) FILTER (abs(d - {STEP}) > 3600) AS irregular_delta_count, count(*) FILTER (d > 3.5 * {STEP}) AS large_gap_count FROM x GROUP BY 1),
r AS (SELECT *, irregular_delta_count / total_deltas AS ir, large_gap_count / total_deltas AS lr FROM a)
SELECT * EXCLUDE (ir, lr), round(ir, 6) + 0.0 AS irregular_ratio, round(lr, 6) + 0.0 AS large_gap_ratio, CASE WHEN total_deltas < 1 OR lr > 0.01 OR ir > 0.05 THEN 'FAIL' WHEN irregular_delta_count + large_gap_count > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM r""",
        "rows_preserved": true_rows(*((n, "TRUE") for n in ("no_row_lost", "no_row_added", "same_multiplicity", "same_values"))),
        "labels_audited": f"""WITH {b}, l AS (SELECT {o.net_label(3, 25)} AS a, {g5} AS c FROM bars),
u AS (SELECT 'label_dir_h3_thr25bps' AS label, CAST(a AS DOUBLE) AS v FROM l UNION ALL SELECT 'label_fwd_ret_gross_long_h5', c FROM l),
s AS (SELECT label, count(*) AS rows, count(*) - count(v) AS null_count, count(*) FILTER (isinf(v)) AS inf_count, round(min(v), 5) + 0.0 AS low, round(max(v), 5) + 0.0 AS high FROM u GROUP BY 1)
SELECT *, round(null_count / rows, 5) + 0.0 AS null_ratio, CASE WHEN inf_count > 0 OR null_count = rows THEN 'FAIL' WHEN low = high THEN 'WARNING' ELSE 'PASS' END AS status FROM s""",
        "trades_checked": f"""{curve}, q AS (SELECT count(*) AS n, count(DISTINCT (series_id, entry_ts, side)) AS k, bool_and(entry_ts < exit_ts) AS o, bool_and(isfinite(net_bps)) AS fin, bool_and(equity > 0) AS e, bool_and(drawdown <= 1e-7) AS dd FROM f)
SELECT unnest(['has_trades', 'entry_before_exit', 'finite_returns', 'nonnegative_costs', 'no_duplicate_trade_keys', 'equity_positive', 'drawdown_nonpositive']) AS name, unnest([n > 0, o, fin, TRUE, n = k, e, dd]) AS passed FROM q""",
        "registry_checked": true_rows(*((n, "TRUE") for n in ("registry_has_rows", "registry_ids_unique", "experiment_ids_present"))),
        "strategy": f"""WITH {b}, x AS (SELECT *, 1 / (1 + exp(ln(close) - {o.lag('ln(close)')})) AS p, ({g5} - 0.0035) * 0.001 AS ret FROM bars),
y AS (SELECT *, coalesce(p >= 0.55, FALSE) AS act, CASE WHEN p >= 0.55 THEN coalesce(ret, 0.0) ELSE 0.0 END AS pnl FROM x),
z AS (SELECT *, exp(sum(ln(1 + greatest(-0.99, least(pnl, 10.0)))) OVER (PARTITION BY series_id ORDER BY timestamp_utc_ms ROWS UNBOUNDED PRECEDING)) AS eq FROM y),
v AS (SELECT *, eq / greatest(max(eq) OVER (PARTITION BY series_id ORDER BY timestamp_utc_ms ROWS UNBOUNDED PRECEDING), 1e-12) - 1 AS dd FROM z)
SELECT series_id, count(*) FILTER (act) AS trades, {_rounded({'mean_return_per_bar': 'avg(pnl)', 'mean_return_when_active': 'coalesce(avg(pnl) FILTER (act), 0.0)', 'hit_rate_when_active': 'avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) FILTER (act)', 'total_return_proxy': 'arg_max(eq, timestamp_utc_ms) - 1', 'max_drawdown_proxy': 'min(dd)'}, 5)} FROM v GROUP BY 1""",
        "latest_bars": f"WITH {b} SELECT series_id, timestamp_utc_ms, {_rounded({c: c for c in ('open', 'high', 'low', 'close', 'volume')})} FROM bars QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY timestamp_utc_ms DESC) = 1",
    }
    return out

"""Execution, admission and performance by hand."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest

COLUMNS = "run string, timestamp_utc_ms long, proba double, entry_ts long, exit_ts long, gross_bps double, best_bps double, worst_bps double, fixed_cost_bps double, funding_bps double, quote_volume double"


def test_execute(spark):
    rows = [
        ("a", 1, 0.9, 2, 5, 50.0, 60.0, -10.0, 20.0, 1.0, 0.0),  # horizon
        ("a", 2, 0.9, 3, 6, 50.0, 60.0, -10.0, 20.0, 1.0, 0.0),  # overlap
        ("a", 6, 0.5, 7, 9, 50.0, 60.0, -10.0, 20.0, 1.0, 0.0),  # between the thresholds
        ("a", 7, None, 8, 9, 50.0, 60.0, -10.0, 20.0, 1.0, 0.0),
        ("a", 8, 0.1, 9, 12, 50.0, 60.0, -300.0, 20.0, 1.0, 1e9),  # a short that gets its target
        ("a", 13, 0.9, 14, 16, 50.0, 500.0, -80.0, 20.0, 1.0, 1e9),  # the stop counts first
        ("a", 17, 0.9, None, None, None, None, None, 20.0, 1.0, 1e9),
    ]
    out = backtest.execute(spark.createDataFrame(rows, COLUMNS), ["run"], backtest.Rules(switch=0.0))
    got = {r.timestamp_utc_ms: r for r in out.collect()}
    assert [got[t].outcome for t in sorted(got)] == ["TRADE", "OVERLAP", "BELOW_THRESHOLD", "NOT_FINITE", "TRADE", "TRADE", "NO_EXECUTION"]
    assert (got[1].filled_notional, got[1].cost_bps, got[1].net_bps) == (1000.0, 36.0, 14.0)  # 20 % of 10000, half filled
    assert got[1].equity == pytest.approx(10_001.4)
    assert (got[8].side, got[8].exit_reason, got[8].gross_bps) == (-1, "TAKE_PROFIT", 100.0)
    assert (got[13].exit_reason, got[13].gross_bps) == ("STOP_LOSS_CONSERVATIVE", -70.0)
    assert {r.outcome: r.signals for r in backtest.outcomes(out, ["run"]).collect()}["TRADE"] == 3
    halted = backtest.execute(spark.createDataFrame(rows, COLUMNS), ["run"], backtest.Rules(switch=1e-9, stop_bps=5.0)).where("outcome = 'HALTED'").count()
    assert halted > 0


def test_performance(spark):
    day = 86_400_000
    rows = [("a", i * day, (i + 1) * day, r, r * 1e4) for i, r in enumerate([0.1, -0.05, -0.05, 0.0, 0.2])] + [("b", 0, 0, 0.1, 1000.0)]
    x = backtest.performance(spark.createDataFrame(rows, "run string, entry_ts long, exit_ts long, portfolio_return double, net_bps double"), ["run"])
    got = {r.run: r for r in x.collect()}
    a = got["a"]
    total = 1.1 * 0.95 * 0.95 * 1.2 - 1
    assert a.total_return == pytest.approx(total) and a.max_drawdown == pytest.approx(0.95 * 0.95 - 1)
    assert a.longest_losing_streak == 2 and a.coverage_days == 5 and a.profit_factor == pytest.approx(3.0) and a.win_rate == pytest.approx(0.4)
    assert a.cagr == pytest.approx((1 + total) ** 73 - 1) and a.status == "RESEARCH_ONLY_INSUFFICIENT_SAMPLE"
    assert got["b"].cagr is None and got["b"].profit_factor is None and got["b"].longest_losing_streak == 0
    assert [r.run for r in backtest.ranked(x, "run").orderBy("rank").collect()] == ["a", "b"]


def test_admission(spark):
    rows = [("r", "x", 1, 10, 9e9, 100.0), ("r", "x", 2, 5, 9e9, 100.0), ("r", "y", 3, 4, 500.0, -100.0), ("r", "z", 3, 9, 9e9, 0.0), ("r", "w", 20, 21, 9e9, 0.0)]
    t = spark.createDataFrame(rows, "run string, symbol string, entry_ts long, exit_ts long, filled_notional double, net_bps double")
    got = {(r.symbol, r.entry_ts): r for r in backtest.admit_capped(t, ["run"], at_once=2).collect()}
    assert {k: r.outcome for k, r in got.items()} == {("x", 1): "ADMITTED", ("x", 2): "CONFLICT", ("y", 3): "ADMITTED", ("z", 3): "CAPACITY", ("w", 20): "ADMITTED"}
    assert got["x", 1].notional == 2000.0 and got["y", 3].notional == 500.0
    assert got["y", 3].equity == pytest.approx(10_015.0) and got["x", 1].equity == pytest.approx(10_020.0)
    assert got["w", 20].notional == pytest.approx(0.2 * 10_015.0)


def test_groups(spark):
    t = spark.createDataFrame([("s", 1, 5.0, 0.1), ("s", 1, -5.0, -0.1), (None, 1, 1.0, 0.2)], "source string, side int, net_bps double, portfolio_return double")
    assert [(r.source, r.trades, r.win_rate) for r in backtest.trade_groups(t, ("source", "side")).collect()] == [("s", 2, 0.5), (None, 1, 1.0)]

"""Dataset assembly: features, labels, a benchmark series, costs, and walk-forward evaluation."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import positions

INPUTS = ("feat_", "regime_", "xasset_", "cost_")
KEYS = ["series_id", "timestamp_utc_ms"]


def by_prefix(df: DataFrame, prefixes: tuple[str, ...], extras: tuple[str, ...] = ()) -> DataFrame:
    return df.select([c for c in df.columns if c.startswith(prefixes) or c in extras])


def assemble(features: DataFrame, labels: DataFrame, benchmark: str | None = None, shared: tuple[str, ...] = ()) -> DataFrame:
    """Inner join on series and time, with the benchmark series' columns at the same time (not on itself)."""
    out = features.join(by_prefix(labels, ("label_",), tuple(KEYS)), KEYS)
    if benchmark:
        side = features.where(F.col("series_id") == benchmark).select("timestamp_utc_ms", *[F.col(c).alias(f"xasset_{benchmark}_{c}") for c in shared])
        out = out.join(side, "timestamp_utc_ms", "left")
        out = out.withColumns({f"xasset_{benchmark}_{c}": F.when(F.col("series_id") != benchmark, F.col(f"xasset_{benchmark}_{c}")) for c in shared})
    return out


def costs(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Cost columns by series, else by source ``default``."""
    fallback = table.where(F.col("series_id") == "default").select(*[F.col(c).alias(f"_{c}") for c in table.columns if c != "series_id"]).first()
    own = table.where(F.col("series_id") != "default").select("series_id", *[F.col(c).alias(f"cost_{c}") for c in table.columns if c != "series_id"])
    return rows.join(own, "series_id", "left").withColumns({f"cost_{k[1:]}": F.coalesce(F.col(f"cost_{k[1:]}"), F.lit(v)) for k, v in fallback.asDict().items()})


def trainable(rows: DataFrame, target: str, valid: str = "quality_is_valid") -> DataFrame:
    ok = F.col(target).isNotNull() & (F.col(valid) if valid in rows.columns else F.lit(True))
    return rows.withColumn("is_trainable", ok).withColumn("sample_weight", ok.cast("double"))


def _windows_of(n: Column, train: int, test: int, step: int, least: float) -> Column:
    """How many windows n rows have: the first that reaches the end is the last, unless its test is too short."""
    short = max(50, int(test * least))
    by_test, by_end = F.floor((n - train - short) / step), F.greatest(F.lit(0), F.ceil((n - train - test) / step))
    return F.when(n >= train + short, F.least(by_test, by_end) + 1).otherwise(0).cast("int")


def walk_forward_windows(rows: DataFrame, train: int = 700, test: int = 200, step: int = 200, least: float = 0.25) -> DataFrame:
    """A row per series and window, from 1: positions [train_start, train_end) and [train_end, test_end)."""
    n = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("_k", _windows_of(F.col("n"), train, test, step, least)).where("_k > 0")
    out = n.select("series_id", "n", F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("window_id")).withColumn("train_start", ((F.col("window_id") - 1) * step).cast("long"))
    return out.select("series_id", "window_id", "train_start", (F.col("train_start") + train).alias("train_end"), F.least(F.col("train_start") + train + test, F.col("n")).alias("test_end"))


def _fitted(pdf: pd.DataFrame, columns: list[str], target: str, purge_ms: int, embargo_ms: int, epochs: int, rate: float, l2: float, least_train: int):
    """The window's rows in order, which are its test, their labels, and the model (None with too few rows to train on) with its probabilities."""
    pdf = pdf.sort_values("timestamp_utc_ms", ignore_index=True)
    old = (pdf["_p"] < pdf["train_end"]).to_numpy()
    ts = pdf["timestamp_utc_ms"].to_numpy()
    y = (pdf[target].to_numpy() > 0).astype(float)
    x = pdf[columns].to_numpy(float)
    use = old & (ts < ts[~old].min() - purge_ms - embargo_ms) if (~old).any() else old
    if use.sum() < least_train:
        return pdf, ~old, y, None, None
    x = np.where(np.isfinite(x), x, np.nan)
    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        med = np.nan_to_num(np.nanmedian(x[use], axis=0))
    x = np.where(np.isfinite(x), x, med)
    m, s = x[use].mean(0), x[use].std(0)
    s = np.where(s < 1e-12, 1, s)
    x = np.clip((x - m) / s, -8, 8)
    w = pdf["_w"].to_numpy(float)[use]
    w = w / max(w.mean(), 1e-12)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    b, c = np.zeros(len(columns)), 0.0
    for _ in range(epochs):
        e = (sigmoid(x[use] @ b + c) - y[use]) * w
        b -= rate * (x[use].T @ e / len(e) + l2 * b)
        c -= rate * e.mean()
    model = {"train_rows": int(use.sum()), "intercept": float(np.float32(c)), "coef": b.astype(np.float32), "median": med, "mean": m, "std": s}
    return pdf, ~old, y, model, sigmoid(x @ model["coef"].astype(float) + model["intercept"])


def _in_windows(rows: DataFrame, columns: list[str], target: str, train: int, test: int, step: int, weight: str | None) -> DataFrame:
    """The rows with a label, once for each window that holds them, by arithmetic on their place."""
    placed = positions(rows.where(F.col(target).isNotNull()))
    n = placed.groupBy("series_id").agg(_windows_of(F.count(F.lit(1)), train, test, step, 0.25).alias("_k")).where("_k > 0")
    # the windows that end behind a row and begin at or before it
    first, last = F.greatest(F.lit(0), F.floor((F.col("_p") - train - test) / step) + 1), F.least(F.floor(F.col("_p") / step), F.col("_k") - 1)
    each = F.when(first <= last, F.sequence(first, last))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    out = placed.join(n, "series_id").select("series_id", "timestamp_utc_ms", "_p", target, w.alias("_w"), *columns, F.explode(each).alias("_i"))
    return out.withColumns({"window_id": (F.col("_i") + 1).cast("int"), "train_end": F.col("_i") * step + train}).drop("_i")


def walk_forward(rows: DataFrame, columns: list[str], target: str, train: int = 700, test: int = 200, step: int = 200, purge_ms: int = 0, embargo_ms: int = 0, epochs: int = 35, rate: float = 0.05, l2: float = 1e-4, weight: str | None = None, least_train: int = 100) -> DataFrame:
    """Out-of-sample probabilities of a weighted logistic regression refitted in each window.

    Medians, means and deviations come from the window's training rows alone;
    rows within ``purge_ms`` and ``embargo_ms`` of the test's start are left out, and
    a window with fewer than ``least_train`` others is skipped. ``weight`` names a
    column (null: 0). A (series, window) is a group of at most ``train + test`` rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, new, y, model, p = _fitted(pdf, columns, target, purge_ms, embargo_ms, epochs, rate, l2, least_train)
        out = pdf.loc[new if model else new & False, ["series_id", "window_id", "timestamp_utc_ms", target]].rename(columns={target: "actual_label"})
        p = p[new] if model else np.empty(0)
        return out.assign(actual_binary=y[new][: len(out)].astype(int), proba_long=p, pred_binary=(p >= 0.5).astype(int))

    return _in_windows(rows, columns, target, train, test, step, weight).groupBy("series_id", "window_id").applyInPandas(run, "series_id string, window_id int, timestamp_utc_ms long, actual_label double, actual_binary int, proba_long double, pred_binary int")


def walk_forward_models(rows: DataFrame, columns: list[str], target: str, train: int = 700, test: int = 200, step: int = 200, purge_ms: int = 0, embargo_ms: int = 0, epochs: int = 35, rate: float = 0.05, l2: float = 1e-4, weight: str | None = None, least_train: int = 100) -> DataFrame:
    """What ``walk_forward`` fits, a row a series and window: intercept, coefficients, medians, means and deviations in the order of ``columns``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, _, m, _ = _fitted(pdf, columns, target, purge_ms, embargo_ms, epochs, rate, l2, least_train)
        names = ["series_id", "window_id", "train_rows", "intercept", "coef", "median", "mean", "std"]
        row = [] if m is None else [(pdf["series_id"][0], pdf["window_id"][0], m["train_rows"], m["intercept"], *(m[k].astype(float).tolist() for k in names[4:]))]
        return pd.DataFrame(row, columns=names)

    return _in_windows(rows, columns, target, train, test, step, weight).groupBy("series_id", "window_id").applyInPandas(run, "series_id string, window_id int, train_rows int, intercept double, coef array<double>, median array<double>, mean array<double>, std array<double>")


def classification_metrics(pred: DataFrame, by: list[str]) -> DataFrame:
    """Counts, rates and the usual ratios; a ratio over nothing is 0."""
    n = lambda a, p: F.count(F.when((F.col("actual_binary") == a) & (F.col("pred_binary") == p), 1))
    out = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg("actual_binary").alias("positive_rate"), F.avg("pred_binary").alias("pred_positive_rate"), n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    over = lambda a, b: a / F.greatest(F.lit(1), b)
    out = out.withColumns({"accuracy": over(tp + tn, F.col("rows")), "precision_pos": over(tp, tp + fp), "recall_pos": over(tp, tp + fn), "specificity": over(tn, tn + fp)})
    return out.withColumn("balanced_accuracy", (F.col("recall_pos") + F.col("specificity")) / 2)


#: Parts of names that put a feature first.
PRIORITY = ("xasset_", "ret_log", "rv_std", "atr_", "bb_", "rsi_", "ema_", "volume_z", "dollar_volume", "efficiency", "vol_regime", "breakout", "cost_")


def choose_features(columns: list[str], most: int = 80) -> list[str]:
    """Up to ``most`` names, those with a priority part first, each kind in its own order."""
    first = lambda c: not any(p in c for p in PRIORITY)
    return sorted(columns, key=first)[: max(1, most)]


def strategy_proxy(pred: DataFrame, proba: str, ret: str, by: list[str], least: float = 0.55) -> DataFrame:
    """What trading each row with a probability of ``least`` or more would have made: hits, compounded return, drawdown."""
    w = Window.partitionBy(*by).orderBy("timestamp_utc_ms").rowsBetween(Window.unboundedPreceding, 0)
    on = F.col(proba) >= least
    x = pred.withColumn("_on", F.coalesce(on, F.lit(False))).withColumn("_pnl", F.when(F.col("_on"), F.coalesce(F.col(ret), F.lit(0.0))).otherwise(0.0))
    x = x.withColumn("_eq", F.exp(F.sum(F.log1p(F.greatest(F.lit(-0.99), F.least(F.col("_pnl"), F.lit(10.0))))).over(w)))
    x = x.withColumn("_dd", F.col("_eq") / F.greatest(F.max("_eq").over(w), F.lit(1e-12)) - 1)
    pnl = F.col("_pnl")
    return x.groupBy(*by).agg(
        F.count(F.when(F.col("_on"), 1)).alias("trades"), F.avg(pnl).alias("mean_return_per_bar"), F.coalesce(F.avg(F.when(F.col("_on"), pnl)), F.lit(0.0)).alias("mean_return_when_active"),
        F.avg(F.when(F.col("_on"), (pnl > 0).cast("int"))).alias("hit_rate_when_active"), (F.max_by("_eq", "timestamp_utc_ms") - 1).alias("total_return_proxy"), F.min("_dd").alias("max_drawdown_proxy"),
    )

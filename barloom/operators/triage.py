"""From audit records to causes, and to what a model may use.

A record has series_id, dataset_kind, status, errors and warnings (arrays of
text), rows, gap_ratio and return_outlier_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import div, lag

#: Words of messages, the cause they tell, its family; the first that occurs counts.
CAUSES = (
    (("não existe",), "MISSING_FILE", "filesystem"),
    (("falha ao ler parquet", "falha ao abrir parquet"), "PARQUET_READ_ERROR", "storage_format"),
    (("parquet vazio",), "EMPTY_FILE", "data_volume"),
    (("colunas ohlcv ausentes",), "OHLCV_SCHEMA_MISSING_COLUMNS", "schema"),
    (("timestamp_utc_ms", "datetime"), "TIME_INDEX_CONTRACT", "time_index"),
    (("gaps",), "TIME_GAPS", "time_grid"),
    (("ohlc inválido", "volume negativo", "valores nulos"), "OHLCV_VALUE_INTEGRITY", "market_data_values"),
    (("histórico curto",), "SHORT_HISTORY", "data_volume"),
    (("retornos absolutos",), "RETURN_OUTLIERS", "market_data_values"),
)
#: Least rows for a model by kind of series, and the ratio of gaps or outliers that blocks.
LEAST_ROWS = {"ohlcv": 300, "funding_rate": 100, "open_interest": 100}
BLOCKING_RATIO = 0.001
#: Status texts.
PASSING, WARNING, FAILING = ("PASS", "OK", "CHECK_OK"), ("WARNING", "WARN", "UNKNOWN", "MISSING_REPORT", "CHECK_WARNING"), ("FAIL", "ERROR", "CRITICAL", "CHECK_FAIL")


def _says(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _first(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = otherwise
    for cond, value in reversed(rules):
        out = F.when(cond, value).otherwise(out)
    return out


def normal_status(x: Column) -> Column:
    """PASS, WARNING or FAIL; UNKNOWN for null, WARNING for a text that isn't known."""
    s = F.upper(F.trim(x))
    return F.when(x.isNull(), "UNKNOWN").when(s.isin(*PASSING), "PASS").when(s.isin(*FAILING), "FAIL").otherwise("WARNING")


def root_cause(records: DataFrame) -> DataFrame:
    """Adds root_cause and cause_family, by the words of all messages."""
    text = F.lower(F.concat_ws(" | ", "errors", "warnings"))
    good = F.col("status") == "PASS"
    pick = lambda at, no, yes: _first([(_says(text, r[0]), F.lit(r[at])) for r in CAUSES], F.when(good, yes).otherwise(no))
    return records.withColumns({"root_cause": pick(1, "UNCLASSIFIED", "NO_ISSUE_DETECTED"), "cause_family": pick(2, "unknown", "none")})


def warning_class(warning: Column) -> Column:
    """code, ml_status and blocking of one warning, by the record's other columns."""
    w, kind, rows = F.lower(warning), F.coalesce("dataset_kind", F.lit("unknown")), F.coalesce("rows", F.lit(0))
    least = F.coalesce(F.create_map(*[F.lit(x) for kv in LEAST_ROWS.items() for x in kv])[kind], F.lit(300))
    gaps = F.coalesce("gap_ratio", F.lit(0.0)) > BLOCKING_RATIO
    outliers = F.coalesce("return_outlier_count", F.lit(0)) / F.greatest(rows, F.lit(1)) > BLOCKING_RATIO
    held = lambda code, status, blocking: F.struct(F.lit(code).alias("code"), F.lit(status).alias("ml_status"), F.lit(blocking).alias("blocking"))

    def either(cond, blocking, fine, otherwise="ML_CAUTION"):
        return F.when(cond, held(blocking, "ML_BLOCKED", True)).otherwise(held(fine, otherwise, False))

    rules = [
        (~kind.isin(*LEAST_ROWS), held("NON_MARKET_SERIES_NOT_APPLICABLE", "ML_NOT_APPLICABLE", False)),
        (_says(w, ("histórico curto",)), either(rows < least, "SHORT_HISTORY", "SHORT_HISTORY")),
        (_says(w, ("gaps temporais",)), either(gaps, "TIME_GAPS_MATERIAL", "TIME_GAPS_SMALL")),
        (_says(w, ("retornos absolutos",)), either(outliers, "RETURN_OUTLIERS_MATERIAL", "RETURN_OUTLIERS_SMALL")),
        (_says(w, ("datetime ausente", "timestamp_utc_ms ausente")), either(kind == "ohlcv", "TIME_COLUMNS_MISSING", "TIME_COLUMNS_MISSING", "ML_NOT_APPLICABLE")),
        (_says(w, ("nenhuma coluna temporal",)), held("NO_AUDITABLE_COLUMNS", "ML_NOT_APPLICABLE", False)),
    ]
    return _first(rules, held("WARNING_UNCLASSIFIED", "ML_CAUTION", False))


def warnings_long(records: DataFrame) -> DataFrame:
    """series_id, warning, code, ml_status, blocking: one row a warning."""
    return records.withColumn("warning", F.explode("warnings")).select("series_id", "warning", warning_class(F.col("warning")).alias("_c")).select("series_id", "warning", "_c.*")


def enriched(records: DataFrame) -> DataFrame:
    """Adds the cause and ml_quality_status, ml_usable. Arrays are folded in place, without a shuffle."""
    x = root_cause(records).withColumn("_w", F.transform("warnings", warning_class))
    status = _first(
        [
            (F.size("errors") > 0, F.lit("ML_BLOCKED")),
            (F.col("status") == "PASS", F.lit("ML_READY")),
            (F.exists("_w", lambda c: c["blocking"]), F.lit("ML_BLOCKED")),
            (F.exists("_w", lambda c: c["ml_status"] == "ML_NOT_APPLICABLE"), F.lit("ML_NOT_APPLICABLE")),
        ],
        F.lit("ML_CAUTION"),
    )
    return x.withColumn("ml_quality_status", status).withColumn("ml_usable", F.col("ml_quality_status").isin("ML_READY", "ML_CAUTION")).drop("_w")


def report(records: DataFrame) -> DataFrame:
    """What isn't passed, worst first."""
    return enriched(records).where(F.col("status") != "PASS").orderBy((F.col("status") != "FAIL").cast("int"), "root_cause", "series_id")


def gate(rows: DataFrame, ml_status: str = "ml_quality_status", usable: str = "ml_usable", quality: str = "status", audit: str = "audit_status") -> DataFrame:
    """ml_gate and ml_gate_usable: what the status says; without one, what quality and audit say."""
    known = F.nullif(F.trim(ml_status), F.lit(""))
    q, a = F.coalesce(quality, F.lit("UNKNOWN")), F.coalesce(audit, F.lit("UNKNOWN"))
    said = F.when(known.isin("ML_READY", "ML_CAUTION", "ML_BLOCKED", "ML_NOT_APPLICABLE"), known)
    derived = F.when(q.isin("PASS", "OK") & a.isin("PASS", "OK"), "ML_READY").when(q.isin("FAIL", "ERROR") | a.isin("FAIL", "ERROR"), "ML_BLOCKED").otherwise("ML_CAUTION")
    fit = F.coalesce(usable, F.lit(True))
    raw = F.coalesce(said, derived)
    out = F.when(raw == "ML_CAUTION", F.when(said.isNull() | fit, "ML_CAUTION_ACCEPTABLE").otherwise("ML_BLOCKED")).otherwise(raw)
    # a caution that is derived is usable whatever the flag says
    free = F.when(said.isNull() & (raw == "ML_CAUTION"), True).otherwise(fit)
    return rows.withColumn("ml_gate", out).withColumn("ml_gate_usable", free & out.isin("ML_READY", "ML_CAUTION_ACCEPTABLE"))


def input_contract(bars: DataFrame, arrival: str | None = None) -> DataFrame:
    """status, errors and counts a series: nulls, repeated or falling times, prices not above zero or out of their range.

    The order is that of ``arrival``; without it, rows count as ordered. One
    window at most and two aggregates.
    """
    t, n = F.col("timestamp_utc_ms"), lambda c: F.count(F.when(c, 1))
    x = bars
    if arrival:
        from pyspark.sql import Window

        x = x.withColumn("_before", F.max(t).over(Window.partitionBy("series_id").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)))
    else:
        x = x.withColumn("_before", F.lit(None).cast("long"))
    o, h, lo, c = (F.col(k) for k in ("open", "high", "low", "close"))
    counts = {
        "timestamp_null_count": n(t.isNull()), "timestamp_falling_count": n(t < F.col("_before")),
        **{f"{k}_non_positive_count": n(F.col(k) <= 0) for k in ("open", "high", "low", "close")},
        "volume_negative_count": n(F.col("volume") < 0), "high_lt_low_count": n(h < lo),
        "close_outside_count": n((c > h) | (c < lo)), "open_outside_count": n((o > h) | (o < lo)),
    }
    # repeats are counted by time first, so that a hot series is aggregated before it moves
    per_time = x.groupBy("series_id", "timestamp_utc_ms").agg(F.count(F.lit(1)).alias("_rows"), *[v.alias(k) for k, v in counts.items()])
    out = per_time.groupBy("series_id").agg(F.sum("_rows").alias("rows"), F.sum(F.when(F.col("_rows") > 1, F.col("_rows") - 1).otherwise(0)).alias("timestamp_duplicate_count"), *[F.sum(k).alias(k) for k in counts])
    wrong = F.array_compact(F.array(*(F.when(F.col(k) > 0, F.lit(k.removesuffix("_count"))) for k in ("timestamp_duplicate_count", *counts))))
    return out.withColumn("errors", wrong).withColumn("status", F.when(F.size("errors") > 0, "FAIL").otherwise("PASS"))


def records(bars: DataFrame, step_ms: int, kind: str = "ohlcv", least: int = 300, jump: float = 0.5) -> DataFrame:
    """Audit records of bars with the fixed words of the messages; jumps are simple returns beyond ``jump``."""
    x = bars.withColumn("_d", F.col("timestamp_utc_ms") - lag(F.col("timestamp_utc_ms"))).withColumn("_j", F.abs(div(F.col("close"), lag(F.col("close"))) - 1))
    n = lambda c: F.count(F.when(c, 1))
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    a = x.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), n(F.col("_d") > 1.5 * step_ms).alias("gap_count"), n(F.col("_j") > jump).alias("return_outlier_count"), n(bad).alias("_bad"), n(F.col("volume") < 0).alias("_neg"))
    texts = lambda *pairs: F.array_compact(F.array(*(F.when(cond, F.lit(text)) for cond, text in pairs)))
    a = a.withColumns({"gap_ratio": F.col("gap_count") / F.col("rows"), "dataset_kind": F.lit(kind), "errors": texts((F.col("_bad") > 0, "ohlc inválido"), (F.col("_neg") > 0, "volume negativo"))})
    a = a.withColumn("warnings", texts((F.col("rows") < least, "histórico curto"), (F.col("gap_count") > 0, "gaps temporais"), (F.col("return_outlier_count") > 0, "retornos absolutos")))
    return a.withColumn("status", F.when(F.size("errors") > 0, "FAIL").when(F.size("warnings") > 0, "WARNING").otherwise("PASS")).drop("_bad", "_neg")

"""Windows over long series in blocks of rows, so that no series is one task."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .rolling import SERIES, TIME


def positions(df: DataFrame, span_ms: int = 86_400_000) -> DataFrame:
    """Adds ``_p``, the row's place in its series from 0, without sorting a series in one task.

    Rows are numbered within spans of time; the rows before a span come from
    counts of spans, a row each.
    """
    x = df.withColumn("_span", F.expr(f"{TIME} div {span_ms}"))
    w = Window.partitionBy(SERIES).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    before = x.groupBy(SERIES, "_span").agg(F.count(F.lit(1)).alias("_k")).select(SERIES, "_span", F.coalesce(F.sum("_k").over(w), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(SERIES, "_span").orderBy(TIME)) - 1
    return x.withColumn("_w", within).join(before, [SERIES, "_span"]).withColumn("_p", F.col("_before") + F.col("_w")).drop("_span", "_w", "_before")


def in_blocks(df: DataFrame, compute: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0, rows: int = 1_000_000) -> DataFrame:
    """``compute(df)`` for windows that look at most ``back`` rows behind and ``ahead`` rows ahead.

    Each series is cut into blocks of ``rows`` rows; the rows that a neighbour's
    frames reach are copied to it and left out of its result. The result is that
    of the whole series. Times are unique within a series. Recursive operators
    reach to the start and can't be cut.
    """
    if max(back, ahead) > rows:
        raise ValueError("a frame reaches beyond the neighbouring block")
    at, block = F.col("_p") % rows, F.floor(F.col("_p") / rows)
    homes = F.array_compact(F.array(block, F.when(at >= rows - back, block + 1), F.when((at < ahead) & (block > 0), block - 1)))
    placed = positions(df).select(*df.columns, block.alias("_own"), F.explode(homes).alias("_block"))
    keyed = placed.withColumn("_home", F.col("_own") == F.col("_block")).withColumn(SERIES, F.struct(F.col(SERIES).alias("id"), F.col("_block").alias("block")))
    out = compute(keyed.drop("_own", "_block")).where("_home")
    return out.withColumn(SERIES, F.col(f"{SERIES}.id")).drop("_home")


#: Rows of a series in one task, unless a call says otherwise.
BLOCK_ROWS = 1_000_000


def blocked(reach: Callable[..., tuple[int, int]]):
    """Runs an operator over a series' rows in blocks. ``reach``: of its arguments, the rows its frames reach behind and ahead.

    ``block_rows`` is the size of a block, None the whole series in one task.
    Operators that are called within blocks already run as they are.
    """

    def wrap(f):
        @functools.wraps(f)
        def run(bars: DataFrame, *args, block_rows: int | None = BLOCK_ROWS, **options) -> DataFrame:
            if block_rows is None or isinstance(bars.schema[SERIES].dataType, StructType):
                return f(bars, *args, **options)
            back, ahead = reach(*args, **options)
            return in_blocks(bars, lambda b: f(b, *args, **options), back, ahead, max(block_rows, back, ahead))

        return run

    return wrap

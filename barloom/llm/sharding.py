"""Sharding by sampled splitters, with DataFrame functions only.

A record's key is a hash of its text, so that equal texts stand together. A
size-weighted sample of keys gives quantile boundaries of many small ranges;
records go to their range, ranges that hold too much (one text, perhaps) are
subdivided by a hash of the id. Ranges are sorted apart from each other, and
prefix sums over their totals turn places within ranges into places in the
whole order, which is cut into shards of near-equal size.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def shard(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", groups: int = 32, per_range: int = 32) -> DataFrame:
    """id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null) of every record.

    Size: UTF-8 bytes of the text (null: none) plus 16. A record whose middle lies
    in the n-th part of all bytes is in shard n: a shard's size differs from the
    mean by at most half a record at either end. ``groups`` squared is the number
    of ranges, ``per_range`` the expected number of sampled keys a range; both
    bound what the driver and a broadcast hold. A null text has the checksum of
    an empty one; null and repeated ids, repeated rows and ties take neighbouring
    slots in any order. A text larger than a shard fills one, and others may stay
    empty then, as with fewer bytes than shards. Only the id and the text are
    read, so other columns may have any name; an empty table gives an empty result.
    """
    ranges = groups * groups
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = cut(
        df.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_h"),
            F.monotonically_increasing_id().alias("_row"),  # tells records without an id apart; the cut keeps it
        )
    )
    all_bytes = base.agg(F.sum("size")).first()[0] or 1
    rate = ranges * per_range / all_bytes
    uniform = F.pmod(F.xxhash64(F.lit("shard"), F.col("_id"), F.col("_h")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = base.where(uniform < F.col("size") * F.lit(rate))
    wanted = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    found = sample.agg(F.percentile_approx("_h", wanted, 100_000).alias("q")).first()["q"] or [0]
    bounds = sorted(found) + [max(found)] * (ranges - 1 - len(found))
    # two levels of counting instead of one over all boundaries, in generated code
    outer = bounds[groups - 1 :: groups]
    inner = F.array(*(F.array(*(F.lit(b) for b in bounds[i * groups : i * groups + groups - 1])) for i in range(groups)))
    passed = lambda marks: reduce(add, ((m <= F.col("_h")).cast("int") for m in marks))
    ranged = base.withColumn("_o", passed([F.lit(b) for b in outer])).withColumn("_own", F.get(inner, F.col("_o")))
    ranged = cut(ranged.withColumn("_range", F.col("_o") * groups + passed([F.get("_own", F.lit(i)) for i in range(groups - 1)])).drop("_o", "_own"))
    # overfull ranges: as many parts as it takes to come down to twice the mean
    total = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"))
    parts = total.select("_range", F.ceil(F.col("_bytes") / F.lit(2.0 * all_bytes / ranges)).cast("int").alias("_parts"))
    split = ranged.join(F.broadcast(parts), "_range")  # at most a row a range
    split = split.withColumn("_part", F.pmod(F.when(F.col("_id").isNotNull(), F.xxhash64(F.lit("part"), F.col("_id"))).otherwise(F.xxhash64("_row")), F.col("_parts").cast("long"))).drop("_parts")
    split = split.withColumn("_place", F.col("_range") * F.lit(1 << 24).cast("long") + F.col("_part"))
    every = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    # a few thousand rows at most: ranges and their parts
    offsets = split.groupBy("_place").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")).select(
        "_place", F.coalesce(F.sum("_bytes").over(every), F.lit(0)).alias("_before"), F.coalesce(F.sum("_rows").over(every), F.lit(0)).alias("_rows_before")
    )
    own = Window.partitionBy("_place").orderBy("_h", "_id", "_row")
    placed = (
        split.withColumn("_sum", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_nth", F.row_number().over(own))
        .join(F.broadcast(offsets), "_place")
        .withColumn("_middle", 2 * (F.col("_before") + F.col("_sum")) - F.col("size"))
        .withColumn("shard", F.least(F.floor(F.col("_middle") * F.lit(shards / (2 * all_bytes))), F.lit(shards - 1)).cast("int"))
        .withColumn("_at", F.col("_rows_before") + F.col("_nth"))
    )
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

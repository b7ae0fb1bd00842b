"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where a local session has none, a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="barloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles, and the checkpoints where it may, of tables that are gone.

    It does so when the driver collects its garbage, by itself every half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the shared folder, for tables that are read again."""
    return f"{_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until the table has no column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_place(df: DataFrame) -> DataFrame:
    """The table with columns c0, c1 and so on, for functions over whole rows, which can't take names with dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def own_column(name: str):
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_fold(col: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def raw_texts(column: pa.Array) -> list:
    """The column's UTF-8 bytes, None for null, without decoding."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def slices(batches, rows: int = 512):
    """The batches in slices, so that few texts are held as Python objects; then unused memory goes back.

    Workers live on between tasks, and what their allocators keep counts against
    the executor.
    """
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0], done = 1, 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


BASE = 0x5851F42D4C957F2D
_POW = powers(BASE, 1 << 12)
_INV = powers(pow(BASE, -1, 1 << 64), 1 << 12)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if n > len(_POW):
        size = 1 << (n - 1).bit_length()
        _POW, _INV = powers(BASE, size), powers(pow(BASE, -1, 1 << 64), size)
    return _POW, _INV


def word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words of text joined by single spaces.

    One pass of prefix sums of byte * BASE**position modulo 2**64; the hash of a
    word is its slice of the sums moved back to position 0. BASE is odd, so its
    powers have inverses.
    """
    if not joined:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e
    a = np.frombuffer(joined, np.uint8)
    pw, inv = _power_tables(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * pw[: len(a)], out=sums[1:])
    gaps = np.flatnonzero(a == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(a)]))
    return mix64((sums[ends] - sums[starts]) * inv[starts]), starts, ends

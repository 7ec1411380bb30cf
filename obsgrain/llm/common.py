"""Shared folder, lineage cuts, size-checked broadcasts and Arrow batching."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsgrain.operators.cuts import cut, discard, scratch, shared_dir

__all__ = ["BROADCAST_ROWS", "bounded", "buffers", "cut", "discard", "fresh", "lean", "lookup", "rank_file", "scratch", "settings", "shared_dir", "slices", "texts", "tidy"]

#: Rows up to which a table with narrow rows may be broadcast.
BROADCAST_ROWS = 1 << 20


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, already cut, with a broadcast hint if it has at most so many rows (BROADCAST_ROWS); beyond that Spark shuffles it."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salt: str | None = None, salts: int = 16) -> DataFrame:
    """left joined with a narrow table, already cut, that has each key once.

    Up to BROADCAST_ROWS rows right is broadcast and left is not moved. Beyond that both are shuffled; a key that many rows
    of left share is spread over so many tasks by a hash of the column `salt`, right being repeated for each of them.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    if not salt:
        return left.join(right, on, how)
    spread = left.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    return spread.join(right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), [*on, "__salt"], how).drop("__salt")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from df's columns, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def tidy(spark: SparkSession) -> None:
    """Lets go of the shuffle files of steps that are cut off: Spark deletes them when the driver collects what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs and streams that are started inside, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def texts(df: DataFrame, *keep: str) -> DataFrame:
    """Only the named columns and `text`, null texts as empty ones; other columns never reach an operator."""
    return df.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives back to the system what it no longer holds when its task ends: Python workers outlive their tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)

    return task


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each value starts and the last ends."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offs - offs[0]


def slices(batch: pa.RecordBatch, most_bytes: int, most_rows: int = 4096, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text; a single text longer than that is a part of its own."""
    if not batch.num_rows:
        return
    _, offs = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offs, offs[at] + most_bytes, "right")) - 1
        to = min(max(to, at + 1), at + most_rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public vocabulary file of this machine."""
    folder = os.environ.get("OBSGRAIN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)

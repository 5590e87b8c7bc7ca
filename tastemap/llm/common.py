"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# The white space of the contracts: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage is
    cut, and the rows survive the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand the memory that this process has freed back to the system: the allocators keep
    it otherwise, and a worker that waits for its next task would hold its largest batch."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, which gives its memory back when its rows are through."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()
    return body


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, _UPPER, _UPPER.lower()))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4 (2 marks the held-out documents)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def last_start(df: DataFrame, value: Column, starts: Column, n: int, out: str) -> DataFrame:
    """Add ``out``: the last index of the array ``starts`` (of ``n`` entries, ascending)
    whose entry is at most ``value``; a halving search of one projection a step."""
    df = df.withColumn(out, F.lit(0))
    step = 1 << max(0, n - 1).bit_length()
    while step > 1:
        step //= 2
        nxt = F.col(out) + step
        df = df.withColumn(out, F.when(F.coalesce(F.get(starts, nxt) <= value, F.lit(False)), nxt)
                           .otherwise(F.col(out)))
    return df

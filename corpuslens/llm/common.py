"""What the operators of this folder share: input, batches and hashes of ids."""

from __future__ import annotations

import contextlib
import ctypes
import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import small_batches

#: Rows that one step of a Python operator holds at a time; a batch is cut into such slices.
SLICE = 256
#: Tables that this process fills and could fill again.
TABLES: weakref.WeakValueDictionary[int, dict] = weakref.WeakValueDictionary()


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal digits, modulo modulus; null ids fall in bucket 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def refilled(table: dict) -> dict:
    """The same table, which is emptied whenever a task ends; nothing but time may depend on what it holds."""
    TABLES[id(table)] = table
    return table


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of batches; when they end, tables are emptied and memory that the worker has freed goes back, as it waits for its next task beside others."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        batch = None
    released()


def released() -> None:
    for table in list(TABLES.values()):
        table.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict[str, object]], rows: int = SLICE) -> DataFrame:
    """Applies fn to slices of df; fn returns columns by name, in the order of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows):
            yield pa.RecordBatch.from_pydict(fn(batch))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, needs: list[str], keep: Callable[[pa.RecordBatch], object], rows: int = SLICE) -> DataFrame:
    """Rows of df, all columns as they are, for which keep says yes; keep sees the columns of needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows):
            yield batch.filter(pa.array(keep(batch.select(needs)), pa.bool_()))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)

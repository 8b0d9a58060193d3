"""What the operators share: places for intermediate tables, row packing, seeded hashing."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.stored import shared_folder

#: Bytes of rows handed to Python at once.
BATCH = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """The same table, in a session whose rows go to Python in batches of BATCH bytes instead of Spark's default of 64 MB.

    A batch is held several times over on its way (by the JVM, in the stream, in Python), in every
    task of an executor. A size that the session sets itself stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY).removesuffix("b") == str(64 << 20):
        conf.set(_BATCH_KEY, str(BATCH))
    return df


def give_back() -> None:
    """Hands memory that this worker has freed back to the machine: workers live on between stages and share it with the executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function of batches whose worker gives back its memory after the last one."""

    def of_batches(batches):
        yield from run(batches)
        give_back()

    return of_batches


def lean_group(run: Callable) -> Callable:
    """The same for a function of (key, table)."""

    def of_group(key, table):
        out = run(key, table)
        give_back()
        return out

    return of_group


def lean_groups(run: Callable) -> Callable:
    """The same for a function of (key, left, right)."""

    def of_groups(key, left, right):
        out = run(key, left, right)
        give_back()
        return out

    return of_groups


def text_bytes(docs: DataFrame, col: str = "text") -> tuple[int, int]:
    """Rows, and bytes of text, of a table (sizes partitions; never changes results)."""
    from pyspark.sql import functions as F

    r = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(col)).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); uint64 in, uint64 out."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def binaries(column) -> list[memoryview]:
    """The values of a binary Arrow column as buffers, without copies."""
    return [v.as_buffer() if v.is_valid else memoryview(b"") for v in column]


def one_batch(table: pa.Table) -> pa.RecordBatch:
    t = table.combine_chunks()
    return t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_pylist([], schema=t.schema)

"""Helpers the operators share: scratch tables, measured joins, chunks of bytes in tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maskloom.runtime import fits_broadcast, shared_dir

#: Most bytes of a side that is broadcast; a larger side is joined by a shuffle.
BROADCAST_BYTES = 24 * 1024 * 1024
#: ASCII white space, the only separator of words.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write once into the shared folder and read back: cuts the lineage, keeps columns apart.

    A lost executor costs nothing, as the files are on the storage all executors share.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame) -> DataFrame:
    """A saved table, with a broadcast hint only if its counted bytes are under the bound."""
    return F.broadcast(df) if fits_broadcast(df, rows=1_000_000, size=BROADCAST_BYTES) else df


def parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def text_bytes(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def words_of(column: str = "text") -> Column:
    """Number of words between ASCII white space; null counts as no word."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a fixed bijection of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``limit`` bytes: first row, last row, bytes, offsets.

    A row longer than the limit is a run of its own; rows are never cut.
    """
    array = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(array):
        last = max(int(np.searchsorted(at, at[first] + limit, "right")) - 1, first + 1)
        last = min(last, len(array))
        yield first, last, every[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last

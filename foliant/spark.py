"""Small helpers of the document operators: dealing rows out to all tasks, and Python workers that give memory back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def parts_of(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly: a file that compresses well is one task's, however many rows it holds and however much is made of each."""
    return df.repartition(parts_of(df.sparkSession))


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function on batches, with the worker's freed memory given back at the end of a task: workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trimmed()

    return run


def batched(rows: Iterator[tuple], names: list[str], kinds: tuple[pa.DataType, ...], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """The rows as record batches of at most so many rows, so that what is made of an input batch is never held whole."""
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)


def trimmed() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass

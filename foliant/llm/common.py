"""Shared plumbing of the training-data operators: table reads, written intermediates, word slices and hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession


#: Bytes of the Arrow batches that go to Python functions, at most, and of the texts that such a function takes up at once.
BATCH_BYTES, SLICE_BYTES = 16 << 20, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Arrow batches of the session are bounded by BATCH_BYTES, so that long documents don't add up."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(limit, "64m").rstrip("b").replace("m", "0" * 6)) > BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share; a local one only where that is unset and the master is
    local, as in tests. A cluster without the setting is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Writes df once as Parquet into the shared folder and reads it back: lineage ends there, and a lost executor costs a reread.

    group_bytes bounds a row group, for tables of large rows: a task that writes holds one whole, and one that reads decodes as many of its rows at
    once as a batch holds."""
    return written_at(df, name, group_bytes)[0]


def written_at(df: DataFrame, name: str, group_bytes: int | None = None) -> tuple[DataFrame, str]:
    """As written(), with the table's path."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes).option("parquet.page.size.row.check.min", 8)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def trimmed() -> None:
    """Gives freed memory back to the system: Python workers live on and would carry it into the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function on batches, with the worker's freed memory given back at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trimmed()

    return run


def row_slices(batch: pa.RecordBatch, rows: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows, and of about so many bytes if its rows are alike in size."""
    step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def slices(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Cuts a long text at ASCII white space into parts of about `size` bytes, so that no step holds all words of a huge text."""
    if len(data) <= size:
        yield data
        return
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
                end += 1
        yield data[start:end]
        start = end


def hash_shingles(words: list[bytes], n: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each n-word shingle joined by one space; fewer words: of the whole sequence; none: an empty array."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n + 1]
    digest = xxhash.xxh64_digest
    found = b"".join([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist())])
    return np.frombuffer(found, ">u8").astype(np.uint64)


def shingle_parts(text: str | None, n: int) -> Iterator[np.ndarray]:
    """Hashes of all n-word shingles of the lower-cased (A-Z) text, part by part, each shingle once for each place."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(data) <= 1 << 20:
        yield hash_shingles(data.split(), n)
        return
    carry: list[bytes] = []
    seen = 0
    for part in slices(data):
        words = part.split()
        seen += len(words)
        block = carry + words
        if len(block) < n:
            carry = block
            continue
        yield hash_shingles(block, n)
        carry = block[len(block) - n + 1 :] if n > 1 else []
    if seen < n:
        yield hash_shingles(carry, n)


def fresh(columns: list[str], name: str) -> str:
    """The name, or one made from it, that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def parts_of(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

"""A folder of packages as a stream: each new file's paragraphs and cells, stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.packages import parts, section_nodes

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def package_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """NODE rows of every package that appears in the folder; doc_id is the path's hash. Files are taken files_a_batch at a time."""
    files = spark.readStream.schema(BINARY_FILE).format("binaryFile").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return section_nodes(parts(files.select(F.xxhash64("path").alias("doc_id"), "content")))

"""Incremental raw-file manifest (S17 + S18 as a stream).

The reference appends one manifest row per landed raw file.  As a Structured Streaming job, new files
in a landing folder are picked up by the file source, hashed inside the tasks (``sha2`` of the
content) and appended to a Parquet manifest; the checkpoint (in the shared checkpoint folder) records
which files were already handled, so a restarted job appends each file exactly once.  Run it with
``trigger(availableNow=True)`` as a batch-like incremental job, or continuously.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StructField, StructType, TimestampType, StringType

BINARY_FILE_SCHEMA = StructType([
    StructField("path", StringType()), StructField("modificationTime", TimestampType()),
    StructField("length", LongType()), StructField("content", BinaryType())])


def manifest_stream(spark: SparkSession, landing_dir: str, path_glob: str | None = None) -> DataFrame:
    """Streaming (path, bytes, sha256, modified) rows for files arriving in ``landing_dir``."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", True)
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    files = reader.load(landing_dir)
    prefix = landing_dir.rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:", ""), "^" + _escape(prefix), "")
    return files.select(rel.alias("path"), F.col("length").alias("bytes"),
                        F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def append_manifest(spark: SparkSession, landing_dir: str, manifest_path: str, checkpoint: str,
                    available_now: bool = True, path_glob: str | None = None) -> StreamingQuery:
    """Start the append job (S18): new files -> new manifest rows, exactly once per file."""
    q = (manifest_stream(spark, landing_dir, path_glob).writeStream.format("parquet")
         .option("path", manifest_path).option("checkpointLocation", checkpoint).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()


def _escape(s: str) -> str:
    import re
    return re.escape(s)

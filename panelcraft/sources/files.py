"""Scans and sinks for tabular files.

Schemas are explicit (no ``inferSchema``): a wrong type in a file becomes NULL via the caller's
``try_cast`` columns, never a silent re-typing of the table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, header: bool = True,
             **options) -> DataFrame:
    """CSV with a header and an explicit schema; a quote inside a quoted field is doubled, as most writers do (Spark's own
    default is a backslash)."""
    return spark.read.schema(schema).options(**{"header": header, "escape": '"', **options}).csv(path)


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet; a column subset is pruned at the scan by Catalyst."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else list(path)))
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Overwrite a Parquet table, optionally partitioned by the time column for pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header (a folder of part files, written in parallel)."""
    df.write.mode(mode).options(header=True, escape='"').csv(path)


def write_json_meta(spark: SparkSession, meta: dict, path: str) -> None:
    """One-row metadata record (e.g. encoder name, rows, dims) written as JSON."""
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def empty_frame(spark: SparkSession, schema: StructType | str) -> DataFrame:
    """An empty table with fixed columns (optional input that is missing)."""
    return spark.createDataFrame([], schema)


def read_first_available(spark: SparkSession, candidates: Sequence[tuple[str, str]], schema: StructType | str,
                         required: bool = True) -> DataFrame:
    """The first candidate (path, format) that can be read; error listing all if ``required``,
    else an empty table with the schema."""
    errors = []
    for path, fmt in candidates:
        try:
            reader = spark.read.schema(schema)
            df = reader.options(header=True, escape='"').csv(path) if fmt == "csv" else reader.format(fmt).load(path)
            df.limit(0).collect()  # resolves the path now, so a missing input is found here
            return df
        except AnalysisException as e:
            errors.append(f"{path}: {str(e).splitlines()[0]}")
    if required:
        raise FileNotFoundError("no input available:\n" + "\n".join(errors))
    return empty_frame(spark, schema)


def require_columns(df: DataFrame, cols: Sequence[str], what: str = "input") -> None:
    """Named error listing the required columns that are absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required columns: {missing}")


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """The columns whose name starts with ``prefix`` (e.g. ``emb_``)."""
    return [c for c in df.columns if c.startswith(prefix)]

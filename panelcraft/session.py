"""Session construction and cluster-safe scratch locations.

The engine never writes to a machine-local temporary folder on a cluster: lineage is cut with
``DataFrame.checkpoint()`` into the shared folder named by ``spark.checkpoint.dir``.  That setting is
read from the session; a default is set only when it is missing (local tests).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for correctness (ANSI, UTC) and for scale (AQE, skew join, partition sizes).
DEFAULT_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "panelcraft", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the engine's defaults.

    ``master`` and ``shuffle_partitions`` are only applied when given; on a cluster the submitter
    decides them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; set a local one only when none is configured."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # a local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (e.g. on the "
                               "distributed file system); a machine-local folder does not survive executor loss")
        current = tempfile.mkdtemp(prefix="panelcraft-ckpt-")  # local mode only (tests)
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables written by a job."""
    return os.path.join(checkpoint_dir(spark).rstrip("/"), "tables", name)


class persisted:
    """``with persisted(df) as d:`` -- keep an input that several jobs of one step read (e.g. the panel of
    a regression: period scan, Gram, scores) for the duration of the step, then release it.  Lost
    blocks are recomputed from lineage, so executor loss only costs time."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __enter__(self) -> DataFrame:
        return self.df.persist()

    def __exit__(self, *exc) -> None:
        self.df.unpersist()

"""Spark session and job-environment helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "termlens", shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Session tuned for the jobs in this package.

    AQE stays on (coalescing small shuffle partitions, splitting skewed join
    partitions at run time).  On a cluster, pass nothing: master, memory and
    the checkpoint directory come from the cluster configuration.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": "6g",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # a Spark Connect session has no SparkContext
        return None


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint directory the cluster names in
    ``spark.checkpoint.dir``.  Only a local session (tests) without one gets a
    scratch directory; on a cluster an unset directory is an error, because a
    machine-local folder would not survive the loss of that machine."""
    sc = _context(spark)
    d = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not d:
        master = sc.master if sc else spark.conf.get("spark.master", "")
        if not str(master).startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="termlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint
    directory and continue from it (never ``localCheckpoint``).

    One computation (``Dataset.checkpoint`` computes an unpersisted plan
    twice), survives executor loss, and the re-read table carries real size
    statistics for AQE's join and partition decisions."""
    path = scratch_table_path(df.sparkSession, "stage")
    df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint directory for intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")

"""Spark session defaults for the library.

On a cluster the session is built by the platform; these helpers only fill in
settings that are unset, so a cluster's own values always win.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in the library relies on.  AQE re-plans joins at runtime,
# coalesces small shuffle partitions and splits skewed join partitions.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app_name: str = "wellspring",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session as it is, or create one for tests and tools."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("WELLSPRING_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder for lineage cuts.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a shared
    folder there).  Only when it is unset *and* the master is local (tests) a
    fresh scratch folder is created; on a cluster an unset setting is an error.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        # A machine-local folder is not shared by executors and is lost with them.
        raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder for checkpoints")
    local = tempfile.mkdtemp(prefix="wellspring-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return local


def materialize(df):
    """Cut lineage of an expensive intermediate that several branches reuse:
    ``checkpoint()`` writes it once to the shared checkpoint folder (never
    ``localCheckpoint``, whose blocks die with their executor)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/wellspring-{uuid.uuid4().hex}/{tag}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again: its
    lineage ends there, several readers share it, and a lost executor loses
    nothing."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

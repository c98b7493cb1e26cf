"""Spark session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Lexicon/term tables are broadcast only below this size; larger ones shuffle-join.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "velado", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # Local mode runs executors inside the driver JVM: its heap is the only memory knob.
        conf["spark.driver.memory"] = os.environ.get("VELADO_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the cluster's ``spark.checkpoint.dir`` when set; set our own only when it is unset.

    On a cluster the setting names a shared folder (HDFS/S3/...) and must be there; a machine-local
    temporary folder is used only where driver and executors are one process.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    local = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
    if not (conf_dir or fallback or local):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = conf_dir or fallback or tempfile.mkdtemp(prefix="velado-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def bounded_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Let Arrow batches hold at most ``size`` bytes, for functions whose results are many times as large as what they read.

    Spark's own bound is 10,000 rows or 64 MB, whatever a function makes of them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))

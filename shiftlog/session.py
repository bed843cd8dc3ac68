"""Spark session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "shiftlog",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests, bench and local runs.

    On a cluster the session comes from the launcher and only the SQL
    settings below matter; locally they keep shuffles sized to the cores.
    """
    master = master or os.environ.get("SHIFTLOG_MASTER")
    parts = shuffle_partitions or os.environ.get("SHIFTLOG_SHUFFLE_PARTITIONS")
    builder = SparkSession.builder.appName(app)
    if master:  # else the launcher's
        builder = builder.master(master)
    if parts:
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # HotSpot does not JIT methods over 8000 bytes of bytecode; Spark's
        # docs advise this limit so a stage whose generated method would be
        # larger (the wide typed projection of an export scan) runs its
        # operators' own compiled code instead of one interpreted method.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SHIFTLOG_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh folder under the cluster's shared checkpoint directory.

    ``spark.checkpoint.dir`` names storage every executor can reach; it is
    read from the session.  Only when it is unset (local tests) a private
    one is created and registered, so ``DataFrame.checkpoint()`` works too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no SparkContext
        pass
    if not base and sc is not None:
        base = sc.getCheckpointDir()
    if not base:
        if sc is None or not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name storage that all executors share")
        base = tempfile.mkdtemp(prefix="shiftlog-ckpt-")
        sc.setCheckpointDir(base)
    base = base.rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"

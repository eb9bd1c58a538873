"""Spark session and shared-folder helpers.

Everything that cuts lineage or writes an intermediate table goes to the shared
folder the cluster names in ``spark.checkpoint.dir``.
"""
from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "variantlake", cpus: int | str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session for local runs and tests; on a cluster the submitter's session wins."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VL_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where it is unset, a local master gets a temporary folder - driver and tasks are one
    process there - and a cluster an error: no folder of one machine is visible to all.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="variantlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path for a written intermediate table in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or shared_dir(spark)
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``variantlake`` importable in Python workers (zip in the shared folder)."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = shared_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    if "://" in base:  # remote shared folder: build locally then hand the file to Spark
        base = tempfile.mkdtemp(prefix="variantlake-pkg-")
    target = os.path.join(base, f"variantlake-pkg-{uuid.uuid4().hex}")
    archive = shutil.make_archive(target, "zip", root_dir=os.path.dirname(pkg_dir), base_dir="variantlake")
    sc.addPyFile(archive)
    _SHIPPED.add(key)

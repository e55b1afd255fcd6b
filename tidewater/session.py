"""Session settings that the engine relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "tidewater", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive plans and Arrow batches that hold a few long clips."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that the driver and all executors see: under spark.checkpoint.dir, or a temporary one of a local session."""
    key = "spark.checkpoint.dir"
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if root:
        return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {key} to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix=f"{name}-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"

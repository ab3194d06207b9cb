"""The Spark session and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: What the engine relies on; everything else is the cluster's to set.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "quarrymill", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=CONF | (conf or {}))
    return (builder.master(master) if master else builder).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, under a local folder if driver and executors are one process; else an error, as executors would not see each other's files."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quarrymill/{name}-{uuid.uuid4().hex}"


def shipped(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_quarrymill_shipped", False):
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quarrymill-code-")
    copy = Path(folder, "code", top.name)
    shutil.copytree(top, copy, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, top.name), "zip", copy.parent))
    context._quarrymill_shipped = True

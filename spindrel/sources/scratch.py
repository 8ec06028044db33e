"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spindrel-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/") if "://" in found else f"file://{found.rstrip('/')}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spindrel/{name}-{uuid.uuid4().hex[:12]}"

"""A folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; below a local one only for a local master without it."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir")
    if not top:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='rangeweave-')}"
    return f"{top.rstrip('/')}/rangeweave-log/{name}-{uuid.uuid4().hex}"

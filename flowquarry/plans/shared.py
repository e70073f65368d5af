"""Folders for what jobs write in between: the shared one that the cluster names, a local one only where none is named."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="flowquarry-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

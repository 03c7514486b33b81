"""A place for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the session names in spark.checkpoint.dir, which all executors share; below a temporary folder where it names none and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='pointwright-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

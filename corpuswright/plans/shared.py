"""Where queries that write put their tables: the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir; where that is unset (tests, local mode) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"corpuswright-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/corpuswright/{uuid.uuid4().hex}"

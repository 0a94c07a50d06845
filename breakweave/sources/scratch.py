"""The folder that driver and executors share, for tables and files between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's URI below spark.checkpoint.dir; on one machine without that setting, below a temporary folder."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="breakweave-")
        context.setCheckpointDir(root)
    root = "file://" + root if root.startswith("/") else root
    return f"{root.rstrip('/')}/breakweave/{tag}-{uuid.uuid4().hex}"


def written(frame: DataFrame, tag: str) -> DataFrame:
    """A frame written as Parquet in the shared folder and read back: what several branches read is computed once, and lineage ends."""
    path = shared_folder(frame.sparkSession, tag)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)

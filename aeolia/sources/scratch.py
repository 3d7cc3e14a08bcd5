"""A place for intermediate tables and checkpoints that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

__all__ = ["scratch_folder"]


def scratch_folder(spark: SparkSession, name: str = "aeolia") -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Where that is unset, a session in one process gets a temporary folder of its own; on a cluster
    this is an error, since each executor would write to its own disk.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="aeolia-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"

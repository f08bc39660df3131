"""Where intermediate tables go: the shared folder the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only in a local session
    where that is unset is a temporary folder chosen and set; executors of a
    cluster would not see it, so there it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None and context.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if folder is None:
        folder = tempfile.mkdtemp(prefix="salesaudit-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a not yet existing sub-folder of the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

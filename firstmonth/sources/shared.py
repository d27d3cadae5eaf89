"""The folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, also set up for ``checkpoint()``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that every executor can reach.")
        folder = tempfile.mkdtemp(prefix="firstmonth-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()

"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset on one machine, as in tests.

    On a cluster it must be set: a folder of one machine would lose tables with it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="shardloom-"))
    return context.getCheckpointDir()


def local_path(uri: str) -> str:
    """The path of a ``file:`` address, for writers that use the mounted folder itself."""
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri

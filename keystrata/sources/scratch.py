"""Folders for stores that a query makes and the driver deletes when it ends."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

from keystrata.sources.files import Files


def folder(spark: SparkSession, tag: str) -> str:
    """A new path under ``spark.checkpoint.dir``, which all executors share. A session on one machine does without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    path = f"{root.rstrip('/')}/keystrata-{tag}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        Files(spark, path).delete()

"""Paths in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; in local mode without that setting, in one that goes when the program ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, _OWN[app], True)
        root = _OWN[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

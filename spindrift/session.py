"""Making the package known to the Python workers of a session."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context: they may lack the driver's path and folder."""
    context = spark.sparkContext
    if getattr(context, "_spindrift_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="spindrift-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    here = os.path.dirname(os.path.abspath(__file__))
    context.addPyFile(shutil.make_archive(f"{folder}/spindrift_package", "zip", os.path.dirname(here), os.path.basename(here)))
    context._spindrift_shipped = True


def scratch(spark: SparkSession) -> str:
    """A new folder's path within `spark.checkpoint.dir`; within a private one where that is unset and Spark is one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="spindrift-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
    return f"{folder.rstrip('/')}/scratch-{uuid.uuid4().hex}"

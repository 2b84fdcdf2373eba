"""The library's own source on the executors, for tasks that run Python."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this library's source to the executors' Python workers, once for an application."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    _SHIPPED.add(application)
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="panelloom-")  # the driver serves the archive from here as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "panelloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for where, _, names in os.walk(os.path.join(top, "panelloom")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(where, name)
                    out.write(path, os.path.relpath(path, top))
    spark.sparkContext.addPyFile(archive)

"""The package sent to the Python workers, which don't share the driver's import path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import tabloom

#: Applications that have the package, and the folder it is sent from: executors fetch it when they start, so it stays
#: until the driver ends.
_SENT: dict[str, tempfile.TemporaryDirectory] = {}


def on_worker_path(spark: SparkSession) -> bool:
    """Workers of a local session are started with the driver's environment."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(tabloom.__file__)))
    folders = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    return spark.sparkContext.master.startswith("local[") and (root in folders or os.getcwd() == root)


def zipped(folder: str) -> str:
    """The package as ``folder/tabloom.zip``."""
    home = os.path.dirname(os.path.abspath(tabloom.__file__))
    path = os.path.join(folder, "tabloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for base, _, files in sorted(os.walk(home)):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(home)))
    return path


def ship(spark: SparkSession) -> None:
    """Sends the package once for each application; Spark's file server takes it from the driver to the workers."""
    application = spark.sparkContext.applicationId
    if application in _SENT or on_worker_path(spark):
        return
    _SENT[application] = tempfile.TemporaryDirectory(prefix="tabloom-")
    spark.sparkContext.addPyFile(zipped(_SENT[application].name))

"""Sends this package to the executors, which need not have it installed."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application.

    The driver serves the archive from its own folder; executors fetch it as they
    fetch any file of the application, so nothing shared or installed is assumed.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = os.path.join(context._temp_dir, f"{os.path.basename(_PACKAGE)}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)

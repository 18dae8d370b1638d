"""The package for Python workers, where it is not installed on the machines of a cluster."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import tallymark

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package's source to the workers once per application, as ``--py-files`` does."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(tallymark.__file__)))
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(os.path.join(root, "tallymark"), os.path.join(folder, "source", "tallymark"), ignore=shutil.ignore_patterns("__pycache__"))
        # The driver serves the file from here as long as the application runs.
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "tallymark"), "zip", os.path.join(folder, "source"))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)

"""This package's code for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give this package's modules to all executors, once for each application, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_has_tallyspark", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tallyspark-code-"), "tallyspark_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    z.write(whole, os.path.relpath(whole, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._has_tallyspark = True

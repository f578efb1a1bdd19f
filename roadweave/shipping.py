"""This package on the Python workers of a session."""

from __future__ import annotations

import importlib
import os
import shutil
import tempfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send the package once to the executors, unless ``PYTHONPATH`` has it there already.

    Stateful processors are also looked at by a worker of the driver, which gets no files: what
    they are made of is sent with them."""
    here = os.path.dirname(os.path.abspath(__file__))
    top, name = os.path.split(here)
    context = spark.sparkContext
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if top in on_path or getattr(context, "_roadweave_shipped", False):
        return
    for part in ("functions", "streaming"):
        cloudpickle.register_pickle_by_value(importlib.import_module(f"{name}.{part}"))
    context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), name), "zip", top, name))
    context._roadweave_shipped = True

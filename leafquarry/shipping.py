"""Sends the package to the executors, which may not have it installed."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark import SparkContext
from pyspark.sql import SparkSession

#: Threads plan queries side by side; one of them ships.
_ONE = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application, so that workers can import it anywhere."""
    with _ONE:
        _ship(spark.sparkContext)


def _ship(sc: SparkContext) -> None:
    if getattr(sc, "_leafquarry_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="leafquarry-"), "leafquarry.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(target)
    sc._leafquarry_shipped = True

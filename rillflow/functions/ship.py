"""Hand the package to the executors, so that Python functions find it wherever the driver was started."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once per application: add a zip of this package to the Python path of all executors."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        work = tempfile.mkdtemp(prefix="rillflow-ship-")  # the driver serves the file from here
        spark.sparkContext.addPyFile(shutil.make_archive(f"{work}/rillflow", "zip", root.parent, root.name))
        _SHIPPED.add(app)
    return spark

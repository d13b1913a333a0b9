"""Have Python workers find this package, wherever the driver imports it from."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Serve the package to the executors, once an application. Spark's file server sends it from the
    driver; nothing needs to be installed, or on a path, elsewhere."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="sparkcorr-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/sparkcorr.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(path)

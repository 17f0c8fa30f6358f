"""Ships this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Make the ``pressroom`` package importable on the executors' Python workers
    (the functions that run there live in it): zip the package once and hand it to
    Spark with ``addPyFile`` (``addArtifacts`` under Spark Connect).  A cluster job
    would ship it the same way, or as a wheel.
    """
    marker = "_pressroom_shipped"
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect
        sc = None
    owner = sc if sc is not None else spark
    if getattr(owner, marker, False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="pressroom-pkg-"), "pressroom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(os.path.join(_ROOT, "pressroom")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, _ROOT))
    if sc is not None:
        sc.addPyFile(path)
    else:
        spark.addArtifacts(path, pyfile=True)
    setattr(owner, marker, True)

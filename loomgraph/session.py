"""Session set-up: settings for large runs, and the package's way to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", partitions: int = 8, **more: str) -> SparkSession:
    """A session for tests and the benchmark; on a cluster, pass your own session to the operators."""
    b = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in {**SETTINGS, "spark.ui.enabled": "false", **more}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each application, unless their path has it already."""
    if str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    fd, path = tempfile.mkstemp(prefix=f"{_ROOT.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)

"""Session settings and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent

#: Settings that hold at any size: adaptive plans, skew handling, and partitions that fit an executor's memory.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
}

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Makes the package importable by Python workers, once an application.  Where PYTHONPATH already names the folder
    that holds it (an installed copy on every machine) nothing is sent."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp(prefix="gazetteer-code-")) / f"{ROOT.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted(ROOT.rglob("*.py")):
            out.write(f, f.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(archive))


def local_session(name: str = "gazetteer", cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for the command line, tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(name).config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship_code(spark)
    return spark

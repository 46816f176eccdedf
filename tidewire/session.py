"""Session building and the settings every query relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that the results rely on; resources and partition counts are left to the caller.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "tidewire", cpus: int | None = None, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitted session is used as it is."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions or cpus)).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of the session's application, once, so that they need no path of their own to it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already run from an archive that was sent
        return
    archive = Path(tempfile.mkdtemp(prefix="tidewire-")) / "tidewire.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))

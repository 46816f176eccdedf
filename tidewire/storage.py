"""Tables that jobs write for themselves: lineage cuts and persistent state in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary one; a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="tidewire-")
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/tidewire-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made[path] = spark
    return path


def cut(df: DataFrame, name: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: what follows survives the loss of executors without computing it anew."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope() -> Iterator[None]:
    """Remove the paths that are made within when it ends. What was computed from them must be written or collected by then; use it around a whole job in drivers that live long."""
    before = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in before]:
            delete(_made.pop(path), path)


def sweep(spark: SparkSession, hours: float) -> list[str]:
    """Remove what applications that were killed left in the shared folder: folders of other applications in which nothing has been written for so many hours. Gives their names."""
    jvm, base, gone = spark.sparkContext._jvm, shared_dir(spark), []
    where = jvm.org.apache.hadoop.fs.Path(base)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return gone
    late = time.time() * 1000 - hours * 3_600_000
    for status in files.listStatus(where):
        name = status.getPath().getName()
        if name.startswith("tidewire-") and name != f"tidewire-{spark.sparkContext.applicationId}":
            inside = [s.getModificationTime() for s in files.listStatus(status.getPath())] if status.isDirectory() else []
            if max([status.getModificationTime(), *inside]) <= late:
                files.delete(status.getPath(), True)
                gone.append(name)
    return gone


def _tidy() -> None:
    import shutil

    for path, spark in list(_made.items()):
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
            elif path.startswith("file://"):
                shutil.rmtree(path[7:], ignore_errors=True)
        except Exception:  # the session may be gone
            if path.startswith("file://"):
                shutil.rmtree(path[7:], ignore_errors=True)
    for base in _local.values():
        shutil.rmtree(base[7:], ignore_errors=True)


atexit.register(_tidy)

"""Folders that all executors share, for what a session derives and keeps until it ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def filesystem(spark: SparkSession, name: str):
    """(file system, path) of a name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def shared_root(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, removed when the driver ends; a temporary one where that is unset and all runs in one process."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            local = tempfile.mkdtemp(prefix="leafmill-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            base = f"file://{local}"
        _roots[app] = f"{base.rstrip('/')}/leafmill-{app}-{uuid.uuid4().hex[:8]}"
        system, path = filesystem(spark, _roots[app])
        system.mkdirs(path)
        system.deleteOnExit(path)
    return _roots[app]


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files below a path: another one means other data."""
    system, p = filesystem(spark, path)
    files, found = system.listFiles(p, True), []
    while files.hasNext():
        one = files.next()
        found.append(f"{one.getPath()}:{one.getLen()}:{one.getModificationTime()}")
    return "|".join(sorted(found))


class Keeper:
    """Tables below one folder of the shared root: ``keep(df, name)`` writes one and reads it again, which cuts lineage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:8]}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

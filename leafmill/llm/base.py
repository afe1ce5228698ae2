"""What the training-data operators share: a shared scratch folder, text slices, tables."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready

#: Rows and bytes of an Arrow batch: documents are long, and a worker holds a batch several times over.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of this process only where that is unset and all runs in one process.

    Elsewhere executors couldn't see each other's files, so a cluster without the setting is an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="leafmill-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


class Scratch:
    """Tables written in the shared folder: they cut lineage and survive lost executors.

    All tables of an application are under one root, which is removed when the driver ends."""

    _roots: set[str] = set()

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        for k, v in ARROW.items():
            spark.conf.set(k, v)
        home = f"{shared_folder(spark)}/leafmill-{spark.sparkContext.applicationId}"
        if home not in self._roots:
            self._roots.add(home)
            system, path = self._hadoop(home)
            system.mkdirs(path)
            system.deleteOnExit(path)
        self.root, self.tables = f"{home}/{label}-{uuid.uuid4().hex[:12]}", {}

    def _hadoop(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def keep(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_sorted(self, df: DataFrame, name: str, key: str, *by: str) -> DataFrame:
        """A table in buckets of ``key``, each one sorted file (one for each value of ``by``): joins of such tables by key need no shuffle."""
        n, table_ = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"leafmill_{uuid.uuid4().hex}"
        writer = df.repartition(n, key).sortWithinPartitions(*by, key).write.format("parquet").option("path", f"{self.root}/{name}").bucketBy(n, key).sortBy(key)
        (writer.partitionBy(*by) if by else writer).saveAsTable(table_)
        self.tables[name] = table_
        return self.spark.table(table_)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more (all of them without names)."""
        for name in names or tuple(self.tables):
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        for name in names or ("",):
            system, path = self._hadoop(f"{self.root}/{name}" if name else self.root)
            system.delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def bounded(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """A sample of about ``rows`` rows at most, chosen by a hash of ``key`` so that reruns agree."""
    there = df.count()
    if there <= rows:
        return df
    # the whole hash is compared, so a share of any smallness is met
    return df.where(F.shiftrightunsigned(F.xxhash64(*key, F.lit(17)), 1) < int(rows * (1 << 63) // there))


def _trim() -> None:
    """Gives the memory that a batch has needed back to the system: executors share it with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(batches: Iterable) -> Iterator:
    """The batches of a Python worker, with memory given back after each."""
    for batch in batches:
        yield batch
        del batch
        _trim()
    _trim()


def slices(texts: list[str | None], size: int = 256_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about ``size`` characters, each with its first position; null becomes ''."""
    start, held, n = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and n + len(text) > size:
            yield start, held
            start, held, n = i, [], 0
        held.append(text)
        n += len(text) + 1
    if held:
        yield start, held


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

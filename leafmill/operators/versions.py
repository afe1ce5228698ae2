"""Versioned tables: several tables change together, readers see one version, old versions share files.

Data lie in segments: ``data/<table>/segment=<id>/``, written once by a load and never changed.  A document's rows in all tables are in one segment, so a
version is one small table of (document_id, segment) and one JSON file that names it.  The JSON file is put in place last, by a rename that fails
where the version is there already: a load that dies leaves files that no version names, and of two loads that started from one version the second
is told (``Conflict``).  Reading a table skips the rows of documents that a later segment has replaced or that were removed.  Expiry forgets
old versions and deletes the segments that no version left names; nothing is copied.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import filesystem
from .search import small

DOCUMENT = "document_id"


class Conflict(RuntimeError):
    """Another load has published the version that this one was to be."""


class Store:
    """Tables below a root that executors share."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock

    def _names(self, folder: str) -> list[str]:
        system, path = filesystem(self.spark, f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in system.listStatus(path)) if system.exists(path) else []

    def _read(self, name: str) -> dict:
        system, path = filesystem(self.spark, f"{self.root}/{name}")
        stream = system.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, name: str, value: dict) -> None:
        """Writes a file under another name and moves it into place; fails where there is one."""
        temporary = f"{self.root}/temporary/{uuid.uuid4().hex}.json"
        system, path = filesystem(self.spark, temporary)
        stream = system.create(path, False)
        stream.write(json.dumps(value).encode())
        stream.close()
        _, target = filesystem(self.spark, f"{self.root}/{name}")
        system.mkdirs(target.getParent())
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(path, target, none)
        except Exception as e:
            system.delete(path, False)
            if system.exists(target):
                raise Conflict(f"{name} is there already") from e
            raise

    def versions(self) -> list[dict]:
        """All versions, oldest first."""
        return [self._read(f"versions/{n}") for n in self._names("versions") if n.endswith(".json") and not n.startswith(".")]

    def at(self, version: int | None = None, as_of: float | None = None) -> dict:
        """A version by number, the last one published up to a time, or the last one."""
        found = [v for v in self.versions() if (version is None or v["version"] == version) and (as_of is None or v["time"] <= as_of)]
        if not found:
            if version is None and as_of is None:
                return {"version": 0, "live": None, "segments": [], "tables": {}, "time": 0.0}
            raise LookupError(f"no version {version if version is not None else f'up to {as_of}'}")
        return found[-1]

    def live(self, version: dict) -> DataFrame:
        """(document_id, segment) of a version."""
        schema = f"{DOCUMENT} string, segment string"
        return self.spark.read.schema(schema).parquet(f"{self.root}/{version['live']}") if version["live"] else self.spark.createDataFrame([], schema)

    def commit(self, tables: dict[str, DataFrame], documents: DataFrame | None = None, removed: DataFrame | None = None, base: dict | None = None) -> int:
        """Puts documents in place of what is there of them, all tables at once, and takes others out.

        ``documents`` (document_id) are those that ``tables`` are of, also where none of them has a row; by default those of the first table.  ``base`` is the
        version that the change was made from.  Returns the new version's number."""
        base, segment = base or self.at(), uuid.uuid4().hex
        for name, df in tables.items():
            df.withColumn(DOCUMENT, F.col(DOCUMENT).cast("string")).write.parquet(f"{self.root}/data/{name}/segment={segment}")
        if documents is None:
            documents = self._segment(next(iter(tables)), segment) if tables else self.spark.createDataFrame([], f"{DOCUMENT} string")
        new = documents.select(F.col(DOCUMENT).cast("string")).where(f"{DOCUMENT} IS NOT NULL").distinct()
        gone = new if removed is None else new.unionByName(removed.select(F.col(DOCUMENT).cast("string")))
        live = self.live(base).join(gone, DOCUMENT, "left_anti").unionByName(new.withColumn("segment", F.lit(segment)))
        name = f"live/{segment}"
        live.write.parquet(f"{self.root}/{name}")
        segments = sorted(r["segment"] for r in self.spark.read.parquet(f"{self.root}/{name}").select("segment").distinct().collect())
        known = {n: df.withColumn(DOCUMENT, F.col(DOCUMENT).cast("string")).schema.json() for n, df in tables.items()}
        number = base["version"] + 1
        self._publish(f"versions/{number:012d}.json", {"version": number, "time": self.clock(), "live": name, "segments": segments, "tables": base["tables"] | known})
        return number

    def _segment(self, name: str, segment: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/data/{name}/segment={segment}")

    def read(self, name: str, version: int | None = None, as_of: float | None = None) -> DataFrame:
        """A table as it is, as a version has it, or as it was at a time."""
        from pyspark.sql.types import StructType

        at = self.at(version, as_of)
        if name not in at["tables"]:
            raise LookupError(f"version {at['version']} has no table {name}")
        schema, there = StructType.fromJson(json.loads(at["tables"][name])), set(self._names(f"data/{name}"))
        paths = [f"{self.root}/data/{name}/segment={s}" for s in at["segments"] if f"segment={s}" in there]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.option("basePath", f"{self.root}/data/{name}").schema(schema.add("segment", "string") if "segment" not in schema.names else schema).parquet(*paths)
        return rows.join(small(self.live(at), 1_000_000), [DOCUMENT, "segment"], "left_semi").select(*(c for c in schema.names if c != "segment"))

    def audit(self, version: int | None = None) -> DataFrame:
        """(name, n, documents) of each table of a version, with documents that the version doesn't know counted as strays."""
        at, out = self.at(version), None
        for name in sorted(at["tables"]):
            one = self.read(name, at["version"]).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(DOCUMENT).alias("documents")).select(F.lit(name).alias("name"), "n", "documents")
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "name string, n bigint, documents bigint")

    def pin(self, tag: str, version: int | None = None) -> None:
        """Names a version, which then doesn't expire: a backup without a copy."""
        self._publish(f"pins/{tag}.json", {"version": self.at(version)["version"]})

    def pins(self) -> dict[str, int]:
        return {n.removesuffix(".json"): self._read(f"pins/{n}")["version"] for n in self._names("pins") if n.endswith(".json") and not n.startswith(".")}

    def restore(self, version: int) -> int:
        """Publishes an old version's documents as the new version."""
        now, old = self.at(), self.at(version)
        self._publish(f"versions/{now['version'] + 1:012d}.json", old | {"version": now["version"] + 1, "time": self.clock()})
        return now["version"] + 1

    def expire(self, before: float) -> list[int]:
        """Forgets the versions published before a time, but for the last one and those pinned, and deletes what only they name."""
        every, pinned = self.versions(), set(self.pins().values())
        old = [v for v in every[:-1] if v["time"] < before and v["version"] not in pinned]
        numbers = {v["version"] for v in old}
        kept = [v for v in every if v["version"] not in numbers]
        needed, lives = {s for v in kept for s in v["segments"]}, {v["live"] for v in kept}
        # a version is forgotten before its files go, so that no reader opens it halfway
        for v in old:
            self._delete(f"versions/{v['version']:012d}.json")
        tables = sorted({t for v in every for t in v["tables"]})
        for segment in sorted({s for v in old for s in v["segments"]} - needed):
            for name in tables:
                self._delete(f"data/{name}/segment={segment}")
        for live in sorted({v["live"] for v in old} - lives):
            self._delete(live)
        return sorted(numbers)

    def _delete(self, name: str) -> None:
        system, path = filesystem(self.spark, f"{self.root}/{name}")
        system.delete(path, True)

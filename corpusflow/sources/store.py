"""A table in files whose rows are replaced by key, one version at a time."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.registry import set_payload
from ..runtime import cut


class BucketStore:
    """Rows by buckets of a hash of their key; a change rewrites only the buckets that it touches.

    Each change writes the touched buckets into a new folder, and then a version file that names the
    folder of every bucket. That file appears under its final name at once, so a change that fails
    midway leaves the version before it, and a reader of an older version isn't disturbed. A
    second writer of the same version fails. Buckets that a change doesn't touch keep their files.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str = "file_row_id", buckets: int = 256) -> None:
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._paths(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Numbers of the finished versions, in order."""
        path = self._paths(f"{self.folder}/versions")
        names = [s.getPath().getName() for s in self._store.listStatus(path)] if self._store.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def state(self, version: int | None = None) -> dict:
        """``version, buckets`` (folder by bucket) and ``batch`` (the last one taken) of a version, the newest unless given."""
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": {}, "batch": -1}
        number = known[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{number:09}.json").first()[0])

    def rows(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """All rows of a version, or those of some buckets, whose folders alone are read."""
        held = self.state(version)["buckets"]
        paths = [f"{self.folder}/{p}" for b, p in held.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, *keys: DataFrame) -> set[int]:
        """The buckets of some keys, of which there are ``buckets`` at most."""
        found: set[int] = set()
        for frame in keys:
            found |= {r[0] for r in frame.select(self.bucket(F.col(self.key))).distinct().collect()}
        return found

    def apply(self, fresh: DataFrame | None = None, gone: DataFrame | None = None, changes: DataFrame | None = None, columns: tuple[str, ...] = (), batch: int | None = None) -> int:
        """The number of the version in which rows of keys in ``fresh`` are replaced by its rows, those in ``gone`` are dropped, and ``columns`` of those in ``changes`` are set.

        A change under a ``batch`` number that was taken before does nothing, so a stream may repeat
        it. Keys that are both replaced and changed are replaced. A change that touches nothing makes
        no version.
        """
        now = self.state()
        if batch is not None and batch <= now["batch"]:
            return now["version"]
        fresh = cut(fresh.select(*self.schema.names)) if fresh is not None else self.spark.createDataFrame([], self.schema)
        given = [f for f in (fresh, gone, changes) if f is not None]
        touched = self.touched(*given)
        if not touched and batch is None:
            return now["version"]
        replaced = fresh.select(self.key) if gone is None else fresh.select(self.key).unionByName(gone.select(self.key))
        kept = self.rows(now["version"] or None, touched).join(replaced.distinct(), self.key, "left_anti").select(*self.schema.names)
        if changes is not None and columns:
            kept = set_payload(kept, changes, list(columns), self.key)
        made = kept.unionByName(fresh).withColumn("__bucket", self.bucket(F.col(self.key)))
        place = f"data/{now['version'] + 1:09}-{uuid.uuid4().hex}"
        made.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/{place}")
        return self._commit(now, touched, place, batch)

    def prune(self, keep: DataFrame) -> int:
        """The version in which only rows of the keys in ``keep`` are left."""
        return self.apply(gone=self.rows().select(self.key).distinct().join(keep.select(self.key), self.key, "left_anti"))

    def vacuum(self, keep: int = 2) -> None:
        """Deletes version files but the last ``keep``, and the bucket folders that none of those names."""
        known = self.versions()
        used = {p for v in known[-keep:] for p in self.state(v)["buckets"].values()}
        for version in known[:-keep]:
            for path in set(self.state(version)["buckets"].values()) - used:
                self._store.delete(self._paths(f"{self.folder}/{path}"), True)
        for version in known[:-keep]:
            self._store.delete(self._paths(f"{self.folder}/versions/{version:09}.json"), False)

    def _commit(self, now: dict, touched: set[int], place: str, batch: int | None) -> int:
        listed = {s.getPath().getName().removeprefix("__bucket=") for s in self._store.listStatus(self._paths(f"{self.folder}/{place}")) if s.isDirectory()}
        held = {b: p for b, p in now["buckets"].items() if int(b) not in touched} | {b: f"{place}/__bucket={b}" for b in listed}
        number = now["version"] + 1
        text = json.dumps({"version": number, "buckets": held, "batch": now["batch"] if batch is None else batch})
        draft, final = self._paths(f"{self.folder}/versions/.{uuid.uuid4().hex}"), self._paths(f"{self.folder}/versions/{number:09}.json")
        out = self._store.create(draft, True)
        out.write(text.encode())
        out.close()
        if self._store.exists(final) or not self._store.rename(draft, final):
            self._store.delete(draft, False)
            raise RuntimeError(f"another writer has made version {number}")
        return number

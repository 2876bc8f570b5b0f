"""Tables that streams are merged into, kept as files so that they outlive the query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType


class BatchTable:
    """A table that grows by batches: each is written once under its number, reading merges them.

    A batch that a restarted stream repeats overwrites its own folder, so it counts once. Every
    ``compact_every`` batches the merged rows are written as a new base, which reading starts
    from; unfinished folders are not read. ``merge`` gets all rows with their ``batch``, those of
    the base included, and returns the ones that count, with their batch.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, merge: Callable[[DataFrame], DataFrame], compact_every: int = 20) -> None:
        self.spark, self.folder, self.merge, self.compact_every = spark, folder, merge, compact_every
        self.schema = StructType([f for f in schema.fields if f.name != "batch"]).add("batch", LongType())

    def _done(self, kind: str) -> list[int]:
        """Numbers of the finished folders of a kind, in order."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
        numbers = [int(n.split("-")[1]) for n in names if n.startswith(f"{kind}-")]
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in numbers if store.exists(mark(f"{self.folder}/{kind}-{n}/_SUCCESS")))

    def _stored(self) -> tuple[DataFrame, int]:
        """All rows that have not been merged away, and the number of batches since the base."""
        bases, batches = self._done("base"), self._done("batch")
        since = [b for b in batches if not bases or b > bases[-1]]
        paths = [f"{self.folder}/base-{b}" for b in bases[-1:]] + [f"{self.folder}/batch-{b}" for b in since]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return rows, len(since)

    def rows(self) -> DataFrame:
        """The table as of the last finished batch."""
        return self.merge(self._stored()[0])

    def append(self, batch: DataFrame, number: int) -> None:
        """Adds a batch; one whose number is merged into the base already changes nothing."""
        bases = self._done("base")
        if bases and number <= bases[-1]:
            return
        names = [f.name for f in self.schema.fields if f.name != "batch"]
        batch.select(*names, F.lit(number).cast("bigint").alias("batch")).write.mode("overwrite").parquet(f"{self.folder}/batch-{number}")
        rows, since = self._stored()
        if since >= self.compact_every:
            self.merge(rows).select(*names, "batch").write.mode("overwrite").parquet(f"{self.folder}/base-{number}")

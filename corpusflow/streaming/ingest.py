"""Ingest of a stream of files: what is known of each file is kept in keyed state, what it has in stores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..runtime import cut
from ..sources.store import BucketStore

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ("card_id", "row_id")
Parser = Callable[[dict], list[str]]


class FileProcessor(StatefulProcessor):
    """Decides for each file of a batch what to do, from what the file was when it was last taken, and parses it if it must.

    Of a file that comes several times in a batch the largest ``(sha256, fingerprint)`` counts. A file
    that was indexed under the same hash is not parsed again; one that failed is.
    """

    def __init__(self, factory: Callable[[], Parser], payload: tuple[str, ...]) -> None:
        self.factory, self.payload = factory, payload

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("file", "sha256 string, fingerprint string, status string")
        self.parser = self.factory()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - names of the interface
        row = max((r.asDict() for r in rows), key=lambda r: (r["sha256"] or "", r["fingerprint"] or ""))
        held = self.known.get()
        sha, mark, status = held or (None, None, None)
        had, reason, items = status == "indexed", None, []
        if row["role"] is None:
            action, now = "skipped", "skipped"
        elif had and row["sha256"] is not None and sha == row["sha256"]:
            action, now = ("unchanged" if mark == row["fingerprint"] else "metadata_only"), "indexed"
        else:
            action, now = "parse", "indexed"
            try:
                items = [str(i) for i in self.parser(row)]
            except Exception as problem:  # noqa: BLE001 - one file must not fail the batch
                now, reason = "failed", f"{type(problem).__name__}: {problem}"
        if now == "failed" and had:  # it keeps what it had, and is parsed again when it comes again
            known = (None, mark, "indexed")
        else:
            known = (row["sha256"], row["fingerprint"], now)
        if held is None or tuple(held) != known:
            self.known.update(known)
        if action != "unchanged":
            yield Row(**dict(zip(KEY, key)), action=action, status=now, reason=reason, had=had, **{p: row[p] for p in self.payload}, items=items)

    def close(self) -> None:
        pass


def ingest_stream(files: DataFrame, chunks: BucketStore, outcomes: BucketStore, factory: Callable[[], Parser], chunk: Callable[[DataFrame], DataFrame], checkpoint: str, payload: tuple[str, ...] = ()):
    """Ingests all files ``(card_id, row_id, role, sha256, fingerprint, ..)`` that a stream has now.

    New, changed and formerly failed files are parsed by ``factory()(row)``, which gives their items;
    ``chunk`` makes rows of ``chunks`` of ``(file_row_id, n, item, .. payload, batch)``. They replace what
    the file had. Of a file whose fingerprint alone has changed the ``payload`` columns are set on its
    rows. Files without a role lose their rows. A file that can't be parsed keeps what it had and is an
    outcome ``failed`` with its reason. ``outcomes`` has the last outcome of each file,
    ``file_row_id, card_id, action, status, reason, batch``; unchanged files write nothing.

    A batch that is repeated after a failure decides as before, since the state is that of the batch
    before it, and a store takes each batch once.
    """
    spark = files.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = dict(files.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in KEY) + ", action string, status string, reason string, had boolean, " + "".join(f"{c} {kinds[c]}, " for c in payload) + "items array<string>"
    decided = files.groupBy(*KEY).transformWithState(FileProcessor(factory, payload), schema, "Update", "None")

    def take(batch: DataFrame, number: int) -> None:
        rows = cut(batch.withColumnRenamed("row_id", "file_row_id"))  # files are parsed once
        parsed = rows.where("action = 'parse' and status = 'indexed'")
        items = parsed.select("file_row_id", *payload, F.posexplode("items").alias("n", "item"), F.lit(number).alias("batch"))
        gone = rows.where("(action = 'skipped' and had) or (action = 'parse' and status = 'indexed')")
        chunks.apply(chunk(items), gone, rows.where("action = 'metadata_only'").select("file_row_id", *payload), payload, number)
        outcomes.apply(rows.select("file_row_id", "card_id", "action", "status", "reason", F.lit(number).alias("batch")), batch=number)

    return decided.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""The stored table and the ingest of streams: what changes, what stays, and what a failure leaves."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusflow.sources.store import BucketStore
from corpusflow.streaming.ingest import FileProcessor, ingest_stream

ROWS = "file_row_id string, n int, body string"


@pytest.fixture
def folder():
    return f"{tempfile.mkdtemp(prefix='spark-')}/t"


def files(folder):
    return set(glob.glob(f"{folder}/data/**/*.parquet", recursive=True))


def held(store, version=None):
    return sorted(tuple(r) for r in store.rows(version).select("file_row_id", "n", "body").collect())


def test_changes_rewrite_the_buckets_that_they_touch(spark, folder):
    rows = [(f"f{i}", n, f"{i}-{n}") for i in range(40) for n in range(3)]
    make = lambda rows: spark.createDataFrame(rows, ROWS)
    store = BucketStore(spark, folder, StructType.fromDDL(ROWS), buckets=8)
    assert held(store) == [] and store.apply() == 0
    assert store.apply(make(rows)) == 1 and held(store) == sorted(rows)
    first, before = store.state()["buckets"], files(folder)
    store.apply(make([("f3", 0, "new"), ("f99", 7, "more")]), gone=make([("f5", 0, "")]), changes=make([("f7", 0, "set"), ("f3", 0, "lost")]), columns=("body",))
    want = sorted([r for r in rows if r[0] not in ("f3", "f5", "f7")] + [("f3", 0, "new"), ("f99", 7, "more")] + [("f7", n, "set") for n in range(3)])
    assert held(store) == want and held(store, 1) == sorted(rows)  # the version before can still be read
    second = store.state()["buckets"]
    touched = {str(b) for b in store.touched(make([(k, 0, "") for k in ("f3", "f5", "f7", "f99")]))}
    assert before <= files(folder) and {b for b in first if first[b] != second[b]} <= touched < set(first)
    assert store.apply(make([("f3", 0, "new")]), batch=4) == 3 and store.apply(make([("f3", 0, "other")]), batch=4) == 3  # a batch counts once
    assert held(store) == want
    store.prune(make([("f1", 0, ""), ("f2", 0, "")]))
    assert held(store) == sorted(r for r in rows if r[0] in ("f1", "f2"))
    store.vacuum(1)
    used = {f"{folder}/{p}" for p in store.state()["buckets"].values()}
    assert store.versions() == [4] and {os.path.dirname(f) for f in files(folder)} == used and held(store) == sorted(r for r in rows if r[0] in ("f1", "f2"))


def test_a_change_that_fails_leaves_the_version_before(spark, folder):
    store = BucketStore(spark, folder, StructType.fromDDL(ROWS), buckets=4)
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], ROWS)
    store.apply(rows)
    broken = rows.withColumn("body", F.when(F.col("file_row_id") == "b", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("body")))
    with pytest.raises(Exception, match="broken"):
        store.apply(broken)
    assert store.versions() == [1] and held(store) == [("a", 1, "x"), ("b", 1, "y")]
    slow = store.state()
    os.makedirs(f"{folder}/data/none")
    store.apply(rows.withColumn("n", F.lit(2)))
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(slow, set(), "data/none", None)
    assert held(store) == [("a", 2, "x"), ("b", 2, "y")]


def test_ingest_keeps_what_fails_and_repeats_a_batch(spark, folder):
    schema = "card_id int, row_id string, role string, sha256 string, fingerprint string, label string, text string"
    chunks = BucketStore(spark, f"{folder}/chunks", StructType.fromDDL("file_row_id string, n int, item string, label string, batch int"), buckets=4)
    outcomes = BucketStore(spark, f"{folder}/outcomes", StructType.fromDDL("file_row_id string, card_id int, action string, status string, reason string, batch int"), buckets=4)

    def parser():
        def parse(row):
            if "bad" in row["text"]:
                raise OSError("cannot read")
            return row["text"].split()

        return parse

    def run(rows, fails=False):
        full = [(1, f, role, sha, mark, mark, text) for f, role, sha, mark, text in rows]
        if full:
            spark.createDataFrame(full, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")

        def chunk(items):
            if fails:
                raise RuntimeError("the sink is down")
            return items

        source = spark.readStream.schema(schema).parquet(f"{folder}/in")
        ingest_stream(source, chunks, outcomes, parser, chunk, f"{folder}/state", ("label",)).awaitTermination()
        items = sorted((r["file_row_id"], r["n"], r["item"], r["label"]) for r in chunks.rows().collect())
        return items, {r["file_row_id"]: (r["action"], r["status"], r["reason"]) for r in outcomes.rows().collect()}

    items, told = run([("a", "main", "1", "p", "x y"), ("b", "main", "1", "p", "bad"), ("c", "main", "1", "p", "z"), ("d", None, "1", "p", "q"), ("c", "main", "0", "p", "older"), ("e", "main", None, "p", "")])
    assert items == [("a", 0, "x", "p"), ("a", 1, "y", "p"), ("c", 0, "z", "p")]
    assert told == {"a": ("parse", "indexed", None), "b": ("parse", "failed", "OSError: cannot read"), "c": ("parse", "indexed", None), "d": ("skipped", "skipped", None), "e": ("parse", "indexed", None)}
    second = [("a", "main", "2", "p", "bad"), ("b", "main", "1", "q", "now fine"), ("c", "main", "1", "q", "z"), ("d", "main", "1", "p", "q")]
    with pytest.raises(Exception, match="sink is down"):
        run(second, fails=True)
    assert held_items(chunks) == items
    items, told = run([])  # the batch is done anew, with the state of the batch before it
    assert items == [("a", 0, "x", "p"), ("a", 1, "y", "p"), ("b", 0, "now", "q"), ("b", 1, "fine", "q"), ("c", 0, "z", "q"), ("d", 0, "q", "p")]
    assert told["a"] == ("parse", "failed", "OSError: cannot read") and told["c"][0] == "metadata_only" and told["b"][:2] == told["d"][:2] == ("parse", "indexed")
    items, told = run([("a", "main", "1", "p", "x y"), ("c", None, "1", "q", "z"), ("d", "main", "1", "p", "q")])  # back to a's old content: it is parsed again, as its last try failed
    assert [i for i in items if i[0] in "acd"] == [("a", 0, "x", "p"), ("a", 1, "y", "p"), ("d", 0, "q", "p")] and told["a"] == ("parse", "indexed", None) and told["c"][1] == "skipped"


def held_items(store):
    return sorted((r["file_row_id"], r["n"], r["item"], r["label"]) for r in store.rows().collect())


def test_files_are_decided_by_rows_and_states_written_only_when_they_change():
    """A file is decided without a frame made for it, and one that is as it was writes no state."""
    from pyspark.sql import Row

    class Value:
        held, written = None, 0

        def get(self):
            return self.held

        def update(self, value):
            self.held, self.written = value, self.written + 1

    known = Value()
    made = FileProcessor(lambda: lambda row: row["text"].split("\n"), ("label",))
    made.init(type("Handle", (), {"getValueState": lambda self, name, schema: known})())
    file = Row(card_id=1, row_id="a", role="main", sha256="x", fingerprint="p", label="p", text="one\ntwo")
    feed = lambda **changed: [r.asDict() for r in made.handleInputRows((1, "a"), iter([Row(**(file.asDict() | changed))]), None)]
    assert feed() == [{"card_id": 1, "row_id": "a", "action": "parse", "status": "indexed", "reason": None, "had": False, "label": "p", "items": ["one", "two"]}]
    assert feed() == [] and known.written == 1
    assert [r["action"] for r in feed(fingerprint="q", label=None)] == ["metadata_only"] and known.held == ("x", "q", "indexed") and known.written == 2
    assert [r["action"] for r in feed(role=None)] == ["skipped"] and known.held == ("x", "p", "skipped")

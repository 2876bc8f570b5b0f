"""WARC archives in seekable Zstandard bundles.

A bundle is a file of Zstandard frames, each compressed on its own and holding some records of a
WARC file, and a footer with a seek table: the sizes of all frames, in a frame that decoders skip
(the public seekable format). An index maps each record's identifier to its bundle, its frame and its
place inside the frame, so that one record costs one frame. Any Zstandard decoder reads a bundle
from front to back as one WARC file.

Bundles lie in the folder that a cluster shares. A task writes bundles under names of its own, and
only those count that the finished write's index names: what a lost or repeated task has written
besides is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import body, cut, join_facts, shared_folder, written

# The seekable format's marks, and names of WARC 1.1
SKIPPABLE, SEEKABLE, HAS_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
INDEX = "record_id string, page_id string, record_type string, bundle string, frame int, frame_at bigint, frame_bytes bigint, place bigint, record_bytes bigint"


@dataclass(frozen=True)
class WarcSettings:
    least_bytes: int = 0  # of a payload that others may revisit
    frame_bytes: int = 1 << 20  # of records that share a frame; a larger record has one of its own
    bundle_bytes: int = 1 << 28  # compressed, after which a new bundle begins
    level: int = 3
    date: str = "2024-01-01T00:00:00Z"  # of all records, so that reruns agree
    broadcast_payloads: int = 200_000  # payloads held by several pages that are sent to every task; more are met by a shuffle
    frames_per_task: int = 64


def uri_of(name: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(name.encode()).digest())}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def plain(value: str | None) -> str:
    """A field's value on one line; characters that would end it are written as escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


class BundleWriter:
    """Writes records into frames of one bundle, one frame in memory at a time."""

    def __init__(self, folder: str, name: str, settings: WarcSettings) -> None:
        self.settings, self.name = settings, name
        self.store, path = pafs.FileSystem.from_uri(folder)
        self.out = self.store.open_output_stream(f"{path}/{name}", compression=None)
        self.frames: list[tuple[int, int, int]] = []
        self.waiting: list[bytes] = []
        self.index: list[tuple] = []
        self.at = self.size = 0

    def add(self, identity: tuple, data: bytes) -> None:
        """One record, with ``record_id, page_id, record_type`` for the index."""
        if self.waiting and self.size + len(data) > self.settings.frame_bytes:
            self.end_frame()
        self.index.append((identity, len(self.frames), self.size, len(data)))
        self.waiting.append(data)
        self.size += len(data)

    def end_frame(self) -> None:
        plain_bytes = b"".join(self.waiting)
        packed = zstandard.ZstdCompressor(level=self.settings.level, write_checksum=True).compress(plain_bytes)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain_bytes), xxhash.xxh64_intdigest(plain_bytes) & 0xFFFFFFFF))
        self.at, self.waiting, self.size = self.at + len(packed), [], 0

    def close(self) -> list[tuple]:
        """Appends the seek table; the index of all records."""
        if self.waiting:
            self.end_frame()
        table = b"".join(ENTRY.pack(*f) for f in self.frames) + FOOTER.pack(len(self.frames), HAS_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        starts = [0]
        for packed, _, _ in self.frames:
            starts.append(starts[-1] + packed)
        return [(*identity, self.name, frame, starts[frame], self.frames[frame][0], place, size) for identity, frame, place, size in self.index]


def seek_table(source) -> list[tuple[int, int, int, int, int]]:
    """``frame, at, packed bytes, bytes, checksum`` of each frame of an open bundle, from its footer alone."""
    end = source.size()
    source.seek(end - FOOTER.size)
    frames, flags, mark = FOOTER.unpack(source.read(FOOTER.size))
    if mark != SEEKABLE or flags != HAS_CHECKSUMS:
        raise ValueError("no seek table at the end of the bundle")
    source.seek(end - FOOTER.size - frames * ENTRY.size)
    found, at = [], 0
    for n, (packed, size, check) in enumerate(ENTRY.iter_unpack(source.read(frames * ENTRY.size))):
        found.append((n, at, packed, size, check))
        at += packed
    return found


def unpack(source, at: int, packed: int) -> bytes:
    """One frame's records; damaged ones raise, as frames carry a checksum."""
    source.seek(at)
    return zstandard.ZstdDecompressor().decompress(source.read(packed))


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Fields and block of the record that starts at a place, and where the next one starts."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no record starts here")
    fields = dict(line.split(": ", 1) for line in lines)
    begin = stop + 4
    end = begin + int(fields["Content-Length"])
    return fields, data[begin:end], end + 4


def facts(fields: dict[str, str], block: bytes) -> tuple:
    """``page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to`` of a page's record.

    Bytes and digest of a response are those of the payload that was read; a revisit has those
    that it states.
    """
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    if kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    else:
        payload, digest = None, fields["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    page, first = (None if v is None else unquote(v) for v in map(fields.get, ("WARC-Page-ID", "WARC-Refers-To-Page-ID")))
    return page, fields["WARC-Target-URI"], kind, payload, size, digest, first


PAGE = "page_id string, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to string"


def with_first(pages: DataFrame, settings: WarcSettings) -> DataFrame:
    """``page_id, url, html, __first, __response``: of pages with equal payloads the first page_id, and which row is the response."""
    own = pages.select("page_id", "url", "html", F.sha2(body("html").cast("binary"), 256).alias("__key"), F.octet_length(body("html")).alias("__size"), F.lit(0).cast("bigint").alias("__row"))
    least = lambda last: F.min(F.struct(F.col("page_id").isNull().alias("no"), F.col("page_id").alias("id"), F.col(last).alias("last")))
    same = own.groupBy("__key", "page_id").agg(F.count(F.lit(1)).alias("n")).groupBy("__key").agg(least("n").alias("f"), F.sum("n").alias("n")).where("n > 1")
    payloads = cut(same.select("__key", F.col("f.id").alias("__first"), F.lit(0).cast("bigint").alias("__first_row"), (F.col("f.last") > 1).alias("tie"), "n"))
    shared, ties, most = payloads.agg(F.count(F.lit(1)), F.count_if("tie"), F.sum("n")).first()
    if ties:  # rows alike in page and payload are told apart by a number that is written down
        own = written(own.withColumn("__row", F.monotonically_increasing_id()))
        numbered = own.groupBy("__key").agg(least("__row").alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
        payloads = cut(numbered.select("__key", F.col("f.id").alias("__first"), F.col("f.last").alias("__first_row"), "n"))
    payloads = payloads.drop("tie").withColumn("__several", F.lit(True))
    if shared <= settings.broadcast_payloads:
        met = own.join(F.broadcast(payloads.drop("n")), "__key", "left")
    else:
        met = join_facts(own, payloads, "__key", most).unionByName(own.join(payloads, "__key", "left_anti"), allowMissingColumns=True)
    again = F.col("__several").isNotNull() & (F.col("__size") >= settings.least_bytes)
    is_first = F.col("page_id").eqNullSafe(F.col("__first")) & F.coalesce(F.col("__row") == F.col("__first_row"), F.lit(False))
    return met.select("page_id", "url", "html", "__key", "__size", "__first", (~again | is_first).alias("__response"))


def write_bundles(pages: DataFrame, folder: str, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """Writes a record per row of ``pages(page_id, url, html)`` into bundles in ``folder``; returns their index.

    Of rows with equal payloads (UTF-8; null is empty) of ``least_bytes`` or more that with the
    smallest page_id is a response and the others revisit it; smaller payloads are all responses.
    Null page_ids come last; of rows alike in page_id and payload one is the response. Null urls
    are written empty. An empty table writes no bundle. Other columns are not written.

    The index has a row per record, ``record_id, page_id (as text), record_type, bundle, frame,
    frame_at, frame_bytes, place, record_bytes``, and is written before it is returned, so that no
    later failure writes bundles anew.
    """
    limits = settings

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: BundleWriter | None = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if open_ is None:
                    open_ = BundleWriter(folder, f"{uuid.uuid4().hex}.warc.zst", limits)
                    info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", uri_of(open_.name)), ("WARC-Date", limits.date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    open_.add((uri_of(open_.name), None, "warcinfo"), info)
                    open_.end_frame()
                payload = (row.html or "").encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                of_payload = uri_of(f"{row.key}:{row.first}")
                name = of_payload if row.response and row.several else uri_of(f"{open_.name}:{len(open_.index)}")
                fields = [
                    ("WARC-Type", "response" if row.response else "revisit"), ("WARC-Record-ID", name), ("WARC-Target-URI", plain(row.url)), ("WARC-Date", limits.date),
                    ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
                ]
                if row.page_id is not None:
                    fields.append(("WARC-Page-ID", quote(row.page_id)))
                if not row.response:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", of_payload)]
                    if row.first is not None:
                        fields.append(("WARC-Refers-To-Page-ID", quote(row.first)))
                open_.add((name, row.page_id, fields[0][1]), record(fields, answer + payload if row.response else answer))
                if open_.at >= limits.bundle_bytes:
                    yield pd.DataFrame(open_.close(), columns=[c.split()[0] for c in INDEX.split(", ")])
                    open_ = None
        if open_ is not None:
            yield pd.DataFrame(open_.close(), columns=[c.split()[0] for c in INDEX.split(", ")])

    rows = with_first(pages, settings)
    several = F.col("__size") >= settings.least_bytes
    texts = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("__key").alias("key"), F.col("__first").cast("string").alias("first"), F.col("__response").alias("response"), several.alias("several"))
    return cut(texts.mapInPandas(write, INDEX))


def frames_of(bundles: DataFrame, folder: str, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """``bundle, frame, frame_at, frame_bytes`` by the seek tables of ``bundles(bundle)``."""

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["bundle"]:
                with store.open_input_file(f"{path}/{name}") as source:
                    yield pd.DataFrame([(name, n, at, packed) for n, at, packed, _, _ in seek_table(source)], columns=["bundle", "frame", "frame_at", "frame_bytes"])

    return bundles.mapInPandas(tables, "bundle string, frame int, frame_at bigint, frame_bytes bigint")


def read_frames(frames: DataFrame, folder: str, places: bool = False, carry: Callable = facts, schema: str = PAGE) -> DataFrame:
    """The pages' records of ``frames``: all of each frame, or with ``places`` those in its array of that name.

    One frame is in memory at a time. ``carry(fields, block)`` picks what a row has, by default
    everything that a record says of its page.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, part in batch.groupby("bundle", sort=False):
                with store.open_input_file(f"{path}/{name}") as source:
                    for frame in part.sort_values("frame").itertuples(index=False):
                        data, at, rows = unpack(source, frame.frame_at, frame.frame_bytes), 0, []
                        if places:
                            rows = [carry(*parse(data, place)[:2]) for place in sorted(frame.places)]
                        while not places and at < len(data):
                            fields, block, at = parse(data, at)
                            if fields["WARC-Type"] != "warcinfo":
                                rows.append(carry(fields, block))
                        if rows:
                            yield pd.DataFrame(rows, columns=columns)

    return frames.mapInPandas(read, schema)


def read_bundles(index: DataFrame, folder: str, settings: WarcSettings = WarcSettings(), carry: Callable = facts, schema: str = PAGE) -> DataFrame:
    """All pages' records of the bundles that an index names, found by their seek tables and dealt by frame."""
    frames = cut(frames_of(index.select("bundle").distinct(), folder, settings))
    tasks = max(1, frames.count() // settings.frames_per_task)
    return read_frames(frames.repartition(max(tasks, frames.sparkSession.sparkContext.defaultParallelism), "bundle", "frame"), folder, carry=carry, schema=schema)


def fetch(index: DataFrame, folder: str, wanted: DataFrame, column: str = "record_id") -> DataFrame:
    """The pages' records whose ``column`` of the index is in ``wanted(column)``: each frame with one of them is read once."""
    met = index.where("record_type <> 'warcinfo'").join(wanted.select(column).distinct(), column, "left_semi")
    frames = met.groupBy("bundle", "frame", "frame_at", "frame_bytes").agg(F.collect_list("place").alias("places"))
    return read_frames(frames, folder, places=True)


def archive(pages: DataFrame, folder: str | None = None, settings: WarcSettings = WarcSettings()) -> tuple[DataFrame, str]:
    """Writes ``pages`` into bundles in a new folder in the shared one, unless given; the index, and the folder."""
    folder = folder or new_folder(pages.sparkSession)
    return write_bundles(pages, folder, settings), folder


def new_folder(spark: SparkSession) -> str:
    """A new folder for bundles in the shared one, as a URI."""
    at = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    made = store.makeQualified(path).toUri().toString()
    return f"file://{made.removeprefix('file:')}" if made.startswith("file:/") and not made.startswith("file://") else made


def digests(fields: dict[str, str], block: bytes) -> tuple:
    """What a record says of its page, without the payload."""
    page, _, kind, _, size, digest, first = facts(fields, block)
    return page, size, digest, kind, first


def round_trip(pages: DataFrame, settings: WarcSettings = WarcSettings()) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every row of ``pages``, read from its archives."""
    index, folder = archive(pages, settings=settings)
    read = read_bundles(index, folder, settings, digests, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    kind = dict(pages.dtypes)["page_id"]
    return read.withColumns({name: F.col(name).cast(kind) for name in ("page_id", "refers_to")})

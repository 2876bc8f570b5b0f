"""Reading cards, manifests and files; writing manifests, reviews and reports."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION = "STRUCT<name: STRING, fields: MAP<STRING, STRING>, rows: ARRAY<MAP<STRING, STRING>>>"
CARD = f"id STRING, type_name STRING, type_caption STRING, created_by_name STRING, version INT, modified STRING, sections MAP<STRING, {SECTION}>, files ARRAY<STRUCT<row_id: STRING, name: STRING, category: STRING, size: BIGINT, is_virtual: BOOLEAN>>"
FILES = "ARRAY<STRUCT<row_id: STRING, name: STRING, path: STRING, sha256: STRING, downloaded: BOOLEAN>>"
DOCUMENT = f"card_id STRING, doc_kind STRING, number STRING, files {FILES}"
EDGE = "from_id STRING, to_id STRING, relation_type STRING, reverse_type STRING, source STRING"


def read_cards(spark: SparkSession, folder: str, keep_sections: tuple[str, ...] | None = None, many: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cards, one JSON file each or ``many`` in a file, one a line, with their path; and the paths of what can't be read.

    Sections that aren't wanted (their names ignore case) are dropped right after the read;
    ``omitted`` names them.
    """
    rows = spark.read.schema(CARD + ", _corrupt STRING").option("multiLine", not many).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(folder)
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    bad = F.col("_corrupt").isNotNull() | F.col("id").isNull()
    good = rows.where(~bad).drop("_corrupt")
    if keep_sections is not None:
        wanted = [s.lower() for s in keep_sections]
        good = good.withColumn("omitted", F.filter(F.map_keys("sections"), lambda k: ~F.lower(k).isin(*wanted))).withColumn("sections", F.map_filter("sections", lambda k, _: F.lower(k).isin(*wanted)))
    return good, rows.where(bad).select("path", F.lit("invalid").alias("kind"))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, files and edges of a manifest, kept as lines of JSON in ``documents`` and ``edges``.

    A manifest in one object would be read by one task, so its lists are tables of their own.
    """
    held = spark.read.schema(DOCUMENT).json(f"{path}/documents")
    files = held.select("card_id", F.posexplode("files").alias("pos", "f")).select("card_id", "pos", "f.*")
    return held.drop("files"), files, spark.read.schema(EDGE).json(f"{path}/edges")


def hash_in_pieces(files: DataFrame, piece: int = 8 << 20) -> DataFrame:
    """``files(path, size)`` with the ``sha256`` of each, read piece by piece, so a file may be larger than memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hashes = []
            for path in frame["path"]:
                # Spark shows paths as they are; a URI wants them quoted
                store, name = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", quote(path, safe=":/@")))
                digest = hashlib.sha256()
                with store.open_input_stream(name, compression=None) as source:
                    while data := source.read(piece):
                        digest.update(data)
                hashes.append(digest.hexdigest())
            yield frame.assign(sha256=hashes)

    return files.select("path", "size").mapInPandas(run, "path string, size bigint, sha256 string")


def list_files(spark: SparkSession, folder: str, whole: int = 64 << 20) -> DataFrame:
    """``path, size, sha256`` of all files below a folder, with paths relative to it.

    Files up to ``whole`` bytes are read and hashed by Spark's reader from whatever store it knows;
    of larger ones only the names are read, and their bytes are hashed in pieces, a file by a task.
    Empty files have no split for Spark's reader and are not listed.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    small = rows.where(F.col("length") <= whole).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = rows.where(F.col("length") > whole).select("path", F.col("length").alias("size"))
    inside = F.regexp_replace(F.col("path"), r"^.*?/" + re.escape(folder.rstrip("/").rsplit("/", 1)[-1]) + "/", "")
    return small.unionByName(hash_in_pieces(large)).withColumn("path", inside)


def write_review(rows: DataFrame, path: str) -> None:
    """One ``;``-separated table with a header."""
    rows.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def parse_files(files: DataFrame, cache: DataFrame, factory, version: str = "1") -> tuple[DataFrame, DataFrame]:
    """Items of files that the cache lacks, and error rows of those that can't be parsed.

    ``factory`` gives a task its parser: ``parser(path, route) -> list of item dicts``; files are
    known by hash, route and version. A parser's failure is data.
    """
    item = "file_sha256 string, route string, version string, seq int, depth int, label string, text string, header_level int, marker string, enumerated boolean, page_no int, self_ref string, error string"
    names = [p.split()[0] for p in item.split(", ")]
    todo = files.withColumn("version", F.lit(version)).dropDuplicates(["sha256", "route"]).join(cache.select(F.col("file_sha256").alias("sha256"), "route", "version").distinct(), ["sha256", "route", "version"], "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = factory()
        for frame in frames:
            out = []
            for f in frame.itertuples():
                base = {"file_sha256": f.sha256, "route": f.route, "version": version}
                try:
                    out += [base | {"seq": n} | i for n, i in enumerate(parser(f.path, f.route))]
                except Exception as problem:  # noqa: BLE001 - one file must not fail the batch
                    out.append(base | {"error": f"{type(problem).__name__}: {problem}"})
            yield pd.DataFrame(out, columns=names).astype(object).where(lambda x: x.notna(), None)

    parsed = todo.mapInPandas(run, item)
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").select("file_sha256", "route", "error")

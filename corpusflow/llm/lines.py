"""Cross-site boilerplate: lines found on many distinct sites are removed.

Each line hash gets a HyperLogLog sketch of the sites it is on; sketches merge by aggregation, so a
line on every page costs one small sketch per task. Lines whose estimate is within the sketch's
error of the threshold are counted exactly, the others are decided by the estimate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACES, body, cut, others


@dataclass(frozen=True)
class LineSettings:
    min_sites: int = 5
    log_k: int = 10  # registers of a sketch, as a power of two
    errors: float = 6.0  # standard errors beside the threshold that count as near
    broadcast_lines: int = 2_000_000  # boilerplate lines, or lines to count, up to which their hashes are sent to every task


def line_hash(line: Column) -> Column:
    """Of the trimmed line; null for a line without words."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(bare != "", F.xxhash64(bare))


def row_hash() -> Column:
    """Tells rows with the same doc_id apart by their text."""
    return F.xxhash64("doc_id", "text")


def boilerplate(lines: DataFrame, settings: LineSettings = LineSettings()) -> DataFrame:
    """``(line)`` hashes of lines on at least ``min_sites`` sites, from ``(line, site)``.

    Of the sketches that can reach the threshold, those near it are replaced by exact counts.
    """
    margin = settings.errors * 1.04 / (2 ** (settings.log_k / 2))
    low, high = settings.min_sites * (1 - margin), settings.min_sites * (1 + margin)
    sketches = lines.groupBy("line").agg(F.hll_sketch_agg("site", settings.log_k).alias("sketch"))
    spread = cut(sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low))
    near = spread.where(F.col("sites") <= high).select("line")
    few = near.count() <= settings.broadcast_lines
    exact = lines.join(F.broadcast(near) if few else near, "line", "left_semi").groupBy("line", "site").agg(F.lit(1)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return spread.where(F.col("sites") > high).select("line").unionByName(exact.where(F.col("n") >= settings.min_sites).select("line"))


def remove_boilerplate(docs: DataFrame, settings: LineSettings = LineSettings(), site: str = "source") -> DataFrame:
    """``docs`` with ``text`` cleaned, and ``n_lines`` and ``n_removed`` (lines with words).

    Lines are compared trimmed; a line is removed wherever it stands, repeats included, and lines
    without words stay. A null site is a site of its own; a null text stays null. Repeated rows
    are cleaned alike. Columns named like the added ones, in any case, are replaced. An empty table
    gives no rows.
    """
    own = others(docs, "n_lines", "n_removed")
    cut_lines = F.filter(F.transform(F.split(body(), "\n"), line_hash), lambda h: h.isNotNull())
    lines = docs.select(F.xxhash64(F.coalesce(F.concat(F.lit("+"), F.col(site)), F.lit(""))).alias("site"), F.explode(cut_lines).alias("line"))
    found = cut(boilerplate(lines, settings))
    few = found.count() <= settings.broadcast_lines
    dealt = docs.select("doc_id", row_hash().alias("__row"), F.explode(F.array_distinct(cut_lines)).alias("line"))
    hits = dealt.join(F.broadcast(found) if few else found, "line", "left_semi")
    by_row = hits.groupBy("__row", F.col("doc_id").alias("__id")).agg(F.collect_set("line").alias("__gone"))
    rows = docs.select(F.struct(*[c for c in own if c != "text"]).alias("__doc"), "doc_id", "text", row_hash().alias("__row"))
    joined = rows.join(by_row.withColumnRenamed("__row", "__r"), (F.col("__row") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    gone = F.coalesce("__gone", F.array().cast("array<bigint>"))
    keep = lambda x: F.coalesce(~F.array_contains(F.col("__g"), line_hash(x)), F.lit(True))
    parts = joined.withColumn("__g", gone).withColumn("__lines", F.split("text", "\n")).withColumn("__kept", F.filter("__lines", keep))
    spoken = lambda c: F.coalesce(F.size(F.filter(c, lambda x: line_hash(x).isNotNull())), F.lit(0)).cast("bigint")
    return parts.select(
        *[F.col(f"__doc.`{c}`").alias(c) for c in own if c != "text"],
        F.when(F.size("__g") == 0, F.col("text")).otherwise(F.array_join("__kept", "\n")).alias("text"),
        spoken("__lines").alias("n_lines"),
        F.coalesce(F.size("__lines") - F.size("__kept"), F.lit(0)).cast("bigint").alias("n_removed"),
    )

"""Mixing sources to target weights.

Every row gets a hash-random key. Rows are range-sorted by key within their source, a distributed
prefix sum of sizes over that order tells where each row lies, and a source is cut at its exact
budget. A budget above the source's size takes whole epochs first and cuts in the last one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .base import body, cut, words
from .sharding import stable_key


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[int, ...] = (3, 1, 2)  # by rank of the source, repeating
    share: float = 1.5  # of all sizes
    most: int = 2  # times its size that a source may be taken
    prefix: int = 3  # hex digits of the key that make one range: 16**prefix ranges a source


def source_key(source: Column) -> Column:
    """A non-null key that sorts by code point, the null source last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def targets(sizes: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """``(__source, source_size)`` to ``(__source, source_size, target)``.

    Weighted shares with a ceiling of ``most`` times a source's size, the excess reshared by
    weight, end where all sources below their ceiling have the same target per weight. Sources
    sorted by ceiling per weight, the capped ones come first; the level is that of the first
    split whose rest stays below its own ceilings. The table has one row per source, a list
    that a mixture's author writes down, so its two global windows are small.
    """
    rank = Window.orderBy("__source")
    weights = F.array(*[F.lit(w) for w in settings.weights])
    ranked = sizes.withColumn("__rank", F.row_number().over(rank) - 1).withColumn(
        "__weight", F.element_at(weights, (F.col("__rank") % len(settings.weights) + 1).cast("int")).cast("bigint")
    )
    by_ceiling = Window.orderBy((F.lit(settings.most) * F.col("source_size")).cast("double") / F.col("__weight"), "__rank")
    before = by_ceiling.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ceiling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * settings.most
    weight_left = F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything).cast("double") * settings.share - capped.cast("double")) / weight_left.cast("double")
    leveled = ranked.withColumn("__level", level)
    fits = F.col("__level") * F.col("__weight").cast("double") <= (F.col("source_size") * settings.most).cast("double")
    final = F.min(F.when(fits, F.struct(F.col("source_size").cast("double") / F.col("__weight"), F.col("__rank"), F.col("__level")))).over(everything)
    return leveled.withColumn("__final", final["__level"]).select(
        "__source",
        "source_size",
        F.least(
            (F.col("source_size") * settings.most).cast("double"),
            F.coalesce(F.col("__final") * F.col("__weight").cast("double"), (F.col("source_size") * settings.most).cast("double")),
        ).alias("target"),
    )


def _range(settings: MixSettings) -> Column:
    return F.substring("__key", 1, settings.prefix)


def _starts(rows: DataFrame, settings: MixSettings) -> DataFrame:
    """Where each range of each source starts, with the source's size and target."""
    ranges = rows.groupBy("__source", "__range").agg(F.sum("size").alias("__size"))
    goals = targets(ranges.groupBy("__source").agg(F.sum("__size").alias("source_size")), settings)
    along = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranges.withColumn("__start", F.sum("__size").over(along) - F.col("__size")).join(goals, "__source").drop("__size")


def _placed(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows with ``source_size, target, taken, copies``; rows are dealt by source and range, once."""
    inside = Window.partitionBy("__source", "__range").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("__ahead", F.sum("size").over(inside) - F.col("size")).join(starts, ["__source", "__range"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    left = F.least(F.greatest(budget - F.col("__epochs") * F.col("source_size") - F.col("__start") - F.col("__ahead"), F.lit(0)), F.col("size"))
    counted = placed.withColumn("__epochs", epochs).withColumn("__left", left)
    return counted.withColumn("taken", F.col("__epochs") * F.col("size") + F.col("__left")).withColumn(
        "copies", F.when(F.col("size") > 0, F.col("__epochs") + (F.col("__left") * 2 > F.col("size")).cast("bigint")).otherwise(0).cast("int")
    )


def _keyed(docs: DataFrame, settings: MixSettings, *carried: Column) -> DataFrame:
    size = F.size(words(body())).cast("bigint")
    rows = docs.select("doc_id", "source", size.alias("size"), stable_key(F.col("doc_id")).alias("__key"), *carried)
    return rows.withColumn("__source", source_key(F.col("source"))).withColumn("__range", _range(settings))


def plan_mix(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, copies``: one row per row of ``docs``.

    ``taken`` counts words, repeats included, and sums to the whole part of the target in each
    source: the row at the cut is taken in part. ``copies`` is the same cut in whole rows, where
    the row at the cut counts if most of it lies before the cut.

    Order within a source: key of doc_id, doc_id, size. Repeated rows are taken one by one; rows
    alike in all three are interchangeable. A null source is a source of its own, ranked last;
    a null text has size 0 and is never taken; a null doc_id is a key like any other. An empty
    table gives no rows.
    """
    rows = cut(_keyed(docs, settings))
    return _placed(rows, _starts(rows, settings)).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def mix(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as its ``copies`` say."""
    starts = _starts(cut(_keyed(docs, settings).select("__source", "__range", "size")), settings)
    rows = _placed(_keyed(docs, settings, F.struct("*").alias("__row")), starts).where("copies > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).select("__row.*")

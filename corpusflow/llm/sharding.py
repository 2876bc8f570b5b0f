"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key and the number of shards decide a row's shard; no ring table is kept. When one shard is
appended, rows move only into it, about ``1 / (n + 1)`` of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .base import body, others


@dataclass(frozen=True)
class ShardSettings:
    shards: int = 40
    slot_groups: int = 256  # runs of the key space inside a shard that are numbered apart; at most 4096
    overhead: int = 16  # bytes a row takes besides its text


def stable_key(column: Column) -> Column:
    """32 hex digits that depend only on the value; null is a value of its own."""
    return F.md5(F.coalesce(F.concat(F.lit("k"), column.cast("string")), F.lit("")).cast("binary"))


def jump(digest: Column, shards: int) -> Column:
    """Struct ``(shard, grown)``: the place of a key among ``shards`` and among ``shards + 1``.

    From place ``b`` a key jumps to ``floor((b + 1) / u)``, where ``u`` in (0, 1] is the next of
    its pseudo-random numbers; its shard is the last place before the jump that leaves the range.
    The generator is a counter hashed with the key's digest, so that it runs anywhere. Jumps
    only go up, about ``ln(shards)`` of them; once a key has left the range nothing is drawn.
    """
    places = lambda at, shard, grown: F.struct(*[c.cast("bigint").alias(n) for c, n in ((at, "at"), (shard, "shard"), (grown, "grown"))])

    def step(s: Column, i: Column) -> Column:
        drawn = F.conv(F.substring(F.md5(F.concat(digest, i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double")
        after = F.floor((s["at"] + F.lit(1)).cast("double") * F.lit(float(1 << 32)) / (drawn + F.lit(1.0)))
        moved = places(after, F.when(s["at"] < shards, s["at"]).otherwise(s["shard"]), s["at"])
        return F.when(s["at"] > shards, s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 2)), places(F.lit(0), F.lit(0), F.lit(0)), step)


def shard_rows(docs: DataFrame, settings: ShardSettings = ShardSettings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size, text_crc32, law, shard, slot, grown_shard``.

    ``law`` is ``key``: the key and the shard count decide. Rows with equal keys share a shard
    and take neighbouring slots in the order of checksum and size. Slots number a shard's rows
    from 0 without gaps: the key space of a shard is cut into ``slot_groups`` runs, rows are
    numbered inside a run, and a prefix sum over ``shards * slot_groups`` counts, which bounds
    what is broadcast, gives each run's first slot.

    Nulls: a null key is one key like any other; a null text has no bytes and checksum 0. An
    empty table gives no rows. Columns of ``docs`` with the names of added ones, in any case, are replaced.
    """
    own = others(docs, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    digest = stable_key(F.col(key))
    group = F.coalesce(F.shiftright(F.conv(F.substring("__digest", 1, 3), 16, 10).cast("int") * F.lit(settings.slot_groups), 12), F.lit(0))

    def placed(rows: DataFrame) -> DataFrame:
        at = rows.withColumn("__digest", digest).withColumn("__jump", jump(F.col("__digest"), settings.shards))
        return at.select("*", F.coalesce("__jump.shard", F.lit(0)).alias("__shard"), F.coalesce("__jump.grown", F.lit(0)).alias("__grown"), group.alias("__group")).drop("__jump")

    counts = placed(docs.select(key)).groupBy(F.col("__shard").alias("__s"), F.col("__group").alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy("__s").orderBy("__g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select("__s", "__g", (F.sum("__n").over(ahead) - F.col("__n")).alias("__start"))

    rows = placed(docs.select(F.struct(*own).alias("__doc"), key, text)).select(
        "*",
        (F.octet_length(body(text)).cast("bigint") + F.lit(settings.overhead)).alias("size"),
        F.crc32(body(text).cast("binary")).alias("text_crc32"),
    )
    within = Window.partitionBy("__shard", "__group").orderBy("__digest", key, "text_crc32", "size")
    numbered = rows.withColumn("__row", F.row_number().over(within).cast("bigint") - 1)
    out = numbered.join(F.broadcast(starts), (F.col("__shard") == F.col("__s")) & (F.col("__group") == F.col("__g")))
    return out.select(
        *[F.col(f"__doc.`{c}`").alias(c) for c in own],
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        (F.col("__start") + F.col("__row")).alias("slot"),
        F.col("__grown").cast("int").alias("grown_shard"),
    )


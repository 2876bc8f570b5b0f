"""Resampling documents towards a target distribution by importance weights of hashed n-grams.

A document's weight is the sum of its features' gains: how much likelier a feature's bucket is among
the target's texts than in the corpus. Documents are drawn without repeats by adding Gumbel noise
to the weights and taking the highest. N-grams of a batch are interned into an open-addressed NumPy
table (``terms.intern``), whose slots hold an n-gram's bucket and count: the bucket sums of the
corpus come from the slots, and a document's weight gathers its occurrences' gains through them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import LongType, StructType

from .base import cut
from .terms import Interned, Words, blocks, intern, runs, split_words


@dataclass(frozen=True)
class ResampleSettings:
    longest: int = 1  # words of the longest feature
    buckets: int = 10_000  # bounds what is gathered and sent to the tasks
    min_words: int = 20
    percent: int = 10  # of the documents with enough words that are drawn
    seed: int = 2024
    block_bytes: int = 1 << 21  # texts that one table interns


def slot_buckets(words: Words, start: np.ndarray, end: np.ndarray, table: Interned, buckets: int) -> np.ndarray:
    """The bucket of each slot's n-gram; 0 for empty slots, which no occurrence has."""
    raw, found = words.data.tobytes(), np.zeros(len(table.owner), np.int64)
    used = table.used()
    first = table.owner[used]
    found[used] = [zlib.crc32(raw[a:b]) % buckets for a, b in zip(start[first].tolist(), end[first].tolist())]
    return found


def bucket_counts(rows: DataFrame, settings: ResampleSettings = ResampleSettings()) -> np.ndarray:
    """How many features of all ``rows(text)`` fall into each bucket; a task sends one row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for _, texts in blocks(batch, "text", settings.block_bytes):
                words = split_words(texts)
                start, end, _ = runs(words, settings.longest)
                table = intern(words.data, start, end)
                np.add.at(total, slot_buckets(words, start, end, table, settings.buckets), table.counts())
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": met, "n": total[met]})

    sums = rows.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(settings.buckets, np.int64)
    for bucket, n in sums:  # at most one row per bucket
        found[bucket] = n
    return found


def gains(docs: DataFrame, target: DataFrame, settings: ResampleSettings = ResampleSettings()) -> np.ndarray:
    """``floor(1000 ln(((t + 1) (S + buckets)) / ((s + 1) (T + buckets))))`` of each bucket.

    ``s`` and ``t`` count the features of all documents and of all target texts in the bucket, ``S``
    and ``T`` in all of them. Without a target text or a document the buckets are all alike.
    """
    here, there = bucket_counts(docs, settings).tolist(), bucket_counts(target, settings).tolist()
    size, size_there = float(sum(here) + settings.buckets), float(sum(there) + settings.buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * size / ((s + 1) * size_there))) for s, t in zip(here, there)], np.int64)


def weigh(rows: DataFrame, gain: np.ndarray, settings: ResampleSettings = ResampleSettings()) -> DataFrame:
    """``rows`` with ``__words, __features, __weight`` in place of ``__text``: words, features and the sum of their gains."""
    kept = [f for f in rows.schema.fields if f.name != "__text"]
    names = [f.name for f in kept]
    schema = StructType(kept)
    for name in ("__words", "__features", "__weight"):
        schema = schema.add(name, LongType())

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, "__text", settings.block_bytes):
                words = split_words(texts)
                start, end, row = runs(words, settings.longest)
                table = intern(words.data, start, end)
                by_slot = gain[slot_buckets(words, start, end, table, settings.buckets)]
                weight = np.zeros(len(texts), np.int64)
                np.add.at(weight, row, by_slot[table.slot])
                counts = [np.bincount(r, minlength=len(texts)) for r in (words.row, row)]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *map(pa.array, (*counts, weight))], names=[*names, "__words", "__features", "__weight"])

    return rows.mapInArrow(weighed, schema)


def noise(doc_id: Column, settings: ResampleSettings = ResampleSettings()) -> Column:
    """Gumbel noise of a document, in thousandths, from a hash of its id; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{settings.seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def rank_documents(docs: DataFrame, target: DataFrame, settings: ResampleSettings = ResampleSettings()) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; ``rank`` is null where it isn't drawn.

    Of the rows with at least ``min_words`` words the ``percent`` with the highest scores are drawn,
    ties to the smaller doc_id. Null ids come before others in a tie, rows equal in both are drawn
    one by one. A null text has no words. Empty tables give no rows; other columns play no part.

    The order is a range sort of slim rows, whose last key is a row number, so that a doc_id held by
    many rows is divided too; ranks are a row's place in its range and the sizes of the ranges before.
    """
    slim = weigh(docs.select("doc_id", F.col("text").alias("__text")), gains(docs, target, settings), settings)
    score = F.col("__weight") + noise(F.col("doc_id"), settings)
    rows = cut(slim.withColumn("score", score).withColumn("__at", F.monotonically_increasing_id()))
    enough = F.col("__words") >= settings.min_words
    wanted = rows.where(enough).count() * settings.percent // 100
    in_order = rows.where(enough).orderBy(F.desc("score"), "doc_id", "__at")
    placed = cut(in_order.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")))
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # one row per partition of the sort
    ahead = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    ranked = placed.join(F.broadcast(sizes.select("__range", ahead.alias("__ahead"))), "__range").withColumn("rank", F.col("__ahead") + F.col("__place") + 1)
    shown = lambda part, rank: part.select("doc_id", F.col("__features").alias("n_features"), F.col("__weight").alias("weight"), "score", rank.cast("bigint").alias("rank"))
    return shown(ranked, F.when(F.col("rank") <= wanted, F.col("rank"))).unionByName(shown(rows.where(~enough), F.lit(None)))


def draw(docs: DataFrame, target: DataFrame, settings: ResampleSettings = ResampleSettings()) -> DataFrame:
    """The drawn rows of ``docs``, with their own columns.

    The score of the last drawn row bounds the others', so the texts are not sorted: rows beyond it
    stay where they are. Of the rows that equal the last one in score and doc_id as many stay as
    are still to be drawn.
    """
    gain = gains(docs, target, settings)
    whole = weigh(docs.select(F.struct("*").alias("__doc"), F.col("text").alias("__text")), gain, settings)
    scored = whole.where(F.col("__words") >= settings.min_words).withColumn("__score", F.col("__weight") + noise(F.col("__doc.doc_id"), settings))
    drawn = rank_documents(docs, target, settings).where("rank is not null")
    last = drawn.orderBy(F.desc("rank")).limit(1).select("score", "doc_id", "rank").collect()
    if not last:
        return docs.limit(0)
    score, doc_id, total = last[0]
    own, ties = F.col("__doc.doc_id"), drawn.where((F.col("score") == score) & F.col("doc_id").eqNullSafe(F.lit(doc_id))).count()
    smaller = F.lit(False) if doc_id is None else F.coalesce(own < F.lit(doc_id), F.lit(True))
    before = scored.where((F.col("__score") > score) | ((F.col("__score") == score) & smaller))
    level = scored.where((F.col("__score") == score) & own.eqNullSafe(F.lit(doc_id))).limit(ties)
    return before.unionByName(level).select("__doc.*")

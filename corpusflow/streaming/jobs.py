"""Streams: upserts out of order, latencies per question, and the memory of conversations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..settings import MemorySettings
from ..sources.store import BucketStore
from .tables import BatchTable


def merge_messages(rows: DataFrame) -> DataFrame:
    """The last write of each id of writes ``(id, seq, first_seq, .., created_s)``, with ``created_s`` of its first.

    ``first_seq`` tells of a merged row where its ``created_s`` comes from, so merging is the same
    in whatever portions writes come. A child may come before its parent.
    """
    merged = rows.groupBy("id").agg(F.max_by(F.struct("*"), F.col("seq")).alias("last"), F.min_by(F.struct("created_s", "first_seq"), F.col("first_seq")).alias("first"))
    kept = [c for c in rows.columns if c not in ("created_s", "first_seq")]
    return merged.select(*[f"last.{c}" for c in kept], "first.created_s", "first.first_seq")


def message_table(spark: SparkSession, folder: str, schema: StructType) -> BatchTable:
    """The table of ``(id, seq, .., created_s)`` that writes are merged into."""
    return BatchTable(spark, folder, schema.add("first_seq", schema["seq"].dataType), merge_messages)


def upsert_stream(source: DataFrame, table: BatchTable, checkpoint: str):
    """Merges all that a stream has now into ``table``."""

    def take(batch: DataFrame, number: int) -> None:
        table.append(batch.withColumn("first_seq", F.col("seq")), number)

    return source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signals(events: DataFrame) -> DataFrame:
    """``question_id, started, signal, token``: when each question's run, first signal and first token came, in microseconds; stateful on a stream."""
    at = lambda k: F.min(F.when(F.col("kind") == k, F.unix_micros(F.col("ts").cast("timestamp"))))
    signal = F.min(F.when(F.col("kind") != "run_started", F.unix_micros(F.col("ts").cast("timestamp"))))
    return events.groupBy("question_id").agg(at("run_started").alias("started"), signal.alias("signal"), at("answer_delta").alias("token"))


def latencies(events: DataFrame) -> DataFrame:
    """``question_id, started, first_signal_s, first_token_s`` from events."""
    seconds = lambda c: (F.col(c) - F.col("started")) / 1e6
    return signals(events).select("question_id", "started", seconds("signal").alias("first_signal_s"), seconds("token").alias("first_token_s"))


LATENCIES = "question_id bigint, started bigint, first_signal_s double, first_token_s double"


def latency_stream(events: DataFrame, table: BucketStore, checkpoint: str):
    """Keeps ``table`` (of ``LATENCIES``) at the latencies of all events that a stream has brought, in whatever order they came.

    The earliest times are kept as the stream's state, so each batch writes the questions that it
    changes; a batch that is repeated counts once.
    """

    def take(batch: DataFrame, number: int) -> None:
        table.apply(batch, batch=number)

    return latencies(events).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remember(turns: DataFrame, settings: MemorySettings = MemorySettings(), summarize: Callable[[list[str]], str] | None = None) -> DataFrame:
    """``conversation_id, kept, summary`` of a stream of ``(conversation_id, turn, text)``: the state holds the last turns.

    Turns beyond ``recent_turns`` go to ``summarize`` with the summary so far; if it returns
    nothing they stay.
    """
    keep = settings.recent_turns

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, summary = (list(state.get[0]), state.get[1]) if state.exists else ([], "")
        new = pd.concat(frames)
        held += [t or "" for t in new.sort_values("turn")["text"]]
        if len(held) > keep:
            old = held[:-keep] if keep else held
            told = summarize([summary, *old] if summary else old) if summarize else " / ".join([summary, *old] if summary else old)
            if told:
                held, summary = held[len(old) :], told
        state.update((held, summary))
        yield pd.DataFrame({"conversation_id": [key[0]], "kept": [len(held)], "summary": [summary]})

    kind = dict(turns.dtypes)["conversation_id"]
    return turns.groupBy("conversation_id").applyInPandasWithState(step, f"conversation_id {kind}, kept int, summary string", "held array<string>, summary string", "update", "NoTimeout")

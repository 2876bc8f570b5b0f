"""Chats from streams of writes that come in any order: messages with their elements and ratings, and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import cut
from ..sources.store import BucketStore

ROWS = "row_id string, what string, id string, message_id string, conversation_id string, parent_id string, body string, trace_id string, created_s bigint, value int"
VALUES = ("conversation_id", "parent_id", "body", "trace_id", "value")
PARTS = "message_id string, what string, id string, seq bigint, gone boolean, deleted bigint, first bigint, conversation_id string, parent_id string, body string, trace_id string, value int, created_s bigint"
CONVERSATIONS = "conversation_id string, updated_s bigint, held map<string,struct<seq:bigint,value:string>>"


def writes(messages: DataFrame, elements: DataFrame, feedback: DataFrame) -> DataFrame:
    """The three streams as one, keyed by the message that a write is about.

    ``messages`` are ``id, conversation_id, parent_id, body, trace_id, created_s, seq, gone``, ``elements`` are
    ``id, message_id, conversation_id, body, seq, gone`` and ``feedback`` are ``message_id, conversation_id,
    value, body, seq, gone``. A message with a parent is told to its parent too, whose rating may need
    its trace.
    """
    own = messages.withColumns({"what": F.lit("message"), "message_id": F.col("id")})
    child = messages.where("parent_id is not null").withColumns({"what": F.lit("child"), "message_id": F.col("parent_id")})
    rated = feedback.withColumns({"what": F.lit("feedback"), "id": F.col("message_id")})
    join = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return join(join(own, child), join(elements.withColumn("what", F.lit("element")), rated))


def merged_parts(parts: DataFrame) -> DataFrame:
    """``PARTS`` of the writes that are told apart by ``batch``: of each part of a message its last write and what is known of all.

    The last write by ``seq`` counts, whenever it comes, of equal ones that of the later batch.
    ``deleted`` is the last deletion, ``first`` the first write, which tells ``created_s``.
    """
    last, first = F.struct("seq", "batch", "gone", *VALUES), F.struct("first", "batch", "created_s")
    held = parts.groupBy("message_id", "what", "id").agg(F.max(last).alias("last"), F.min(first).alias("early"), F.max("deleted").alias("deleted"))
    return held.select("message_id", "what", "id", "last.seq", "last.gone", "deleted", "early.first", *[f"last.{c}" for c in VALUES], "early.created_s")


def standing(parts: DataFrame) -> DataFrame:
    """``ROWS`` with ``there``, of all parts of messages: what stands of them.

    A deleted message takes along the elements and the rating written before its deletion. Elements
    and ratings without their message wait for it. A rating has the trace of its message, else that
    of the message's latest child.
    """
    is_ = lambda what: F.col("what") == what
    own = F.max(F.when(is_("message"), F.struct(F.col("gone"), F.col("deleted"), F.col("trace_id")))).alias("own")
    told = F.max(F.when(is_("child") & ~F.col("gone") & F.col("trace_id").isNotNull(), F.struct(F.coalesce("created_s", F.lit(-1)), F.col("id"), F.col("trace_id").alias("trace_id")))).alias("told")
    met = parts.where(~is_("child")).join(parts.groupBy("message_id").agg(own, told), "message_id")
    stays = F.coalesce(~F.col("own.gone"), F.lit(False)) & ~F.col("gone") & (is_("message") | (F.col("seq") > F.col("own.deleted")))
    trace = F.when(is_("feedback") & F.col("own").isNotNull(), F.coalesce(F.nullif(F.col("own.trace_id"), F.lit("")), F.col("told.trace_id"))).otherwise(F.col("trace_id"))
    return met.select(
        F.concat_ws(":", "what", "id").alias("row_id"), "what", "id", "message_id", "conversation_id", "parent_id", "body", trace.alias("trace_id"),
        F.when(is_("message"), F.col("created_s")).alias("created_s"), "value", F.coalesce(stays, F.lit(False)).alias("there"),
    )


def chat_stream(events: DataFrame, rows: BucketStore, checkpoint: str):
    """Merges all ``writes`` that a stream has now into ``rows``: one row for each message, element and rating that stands.

    What is known of messages lies in a store of its own beside ``rows``, by message, so a conversation
    with a third of all writes is divided; of it a batch reads and rewrites the buckets of its
    messages. Merging a batch again changes nothing, and a store takes each batch once.
    """
    spark = events.sparkSession
    known = BucketStore(spark, f"{rows.folder}/parts", StructType.fromDDL(PARTS), "message_id", rows.buckets)

    def take(batch: DataFrame, number: int) -> None:
        new = cut(merged_parts(batch.select("message_id", "what", "id", "seq", F.coalesce("gone", F.lit(False)).alias("gone"), F.when(F.col("gone"), F.col("seq")).otherwise(-1).alias("deleted"), F.col("seq").alias("first"), *VALUES, "created_s", F.lit(1).alias("batch"))))
        keys = new.select("message_id").distinct()
        if known.versions():
            old = known.rows(buckets=known.touched(keys)).join(keys, "message_id", "left_semi")
            new = cut(merged_parts(new.withColumn("batch", F.lit(1)).unionByName(old.withColumn("batch", F.lit(0)))))
        known.apply(new, batch=number)
        made = cut(standing(new))
        rows.apply(made.where("there").drop("there"), made.where("not there").select("row_id"), batch=number)

    return events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def conversation_stream(events: DataFrame, table: BucketStore, checkpoint: str):
    """Merges ``(conversation_id, seq, at_s, metadata)`` of any write into ``table``: conversations exist from their first write on.

    ``updated_s`` is the latest ``at_s``. Of each metadata key the last write by ``seq`` counts, null
    removes it (``metadata_of`` shows what is left). Writes of a batch are combined before they are
    shuffled, and only the buckets of its conversations are read.
    """

    def take(batch: DataFrame, number: int) -> None:
        new = cut(batch.select("conversation_id", "seq", "at_s", "metadata"))
        at = new.groupBy("conversation_id").agg(F.max("at_s").alias("updated_s"))
        known = table.rows(buckets=table.touched(at)) if table.versions() else None
        entries = new.select("conversation_id", "seq", F.explode("metadata").alias("k", "v"))
        if known is not None:
            known = known.join(at.select("conversation_id"), "conversation_id", "left_semi")
            entries = entries.unionByName(known.select("conversation_id", F.explode("held").alias("k", "e")).select("conversation_id", F.col("e.seq").alias("seq"), "k", F.col("e.value").alias("v")))
            at = at.unionByName(known.select("conversation_id", "updated_s")).groupBy("conversation_id").agg(F.max("updated_s").alias("updated_s"))
        last = entries.groupBy("conversation_id", "k").agg(F.max(F.struct("seq", F.col("v").alias("value"))).alias("e"))
        held = last.groupBy("conversation_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "e"))).alias("held"))
        empty = F.create_map().cast("map<string,struct<seq:bigint,value:string>>")
        table.apply(at.join(held, "conversation_id", "left").select("conversation_id", "updated_s", F.coalesce("held", empty).alias("held")), batch=number)

    return events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metadata_of(held: str = "held") -> Column:
    """The metadata that stands, a map of texts."""
    return F.map_filter(F.transform_values(held, lambda _, e: e["value"]), lambda _, v: v.isNotNull())

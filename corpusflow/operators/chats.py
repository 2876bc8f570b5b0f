"""Chat history: traces, listings and what a conversation remembers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import cut_chars
from ..settings import MemorySettings


def traces(messages: DataFrame) -> DataFrame:
    """``id, trace_id``: a message's own trace, else that of its latest child that has one."""
    children = messages.where("trace_id is not null and parent_id is not null").groupBy("parent_id").agg(F.max_by("trace_id", F.struct("created_s", "id")).alias("child"))
    met = messages.select("id", "trace_id").join(children, F.col("id") == F.col("parent_id"), "left")
    return met.select("id", F.coalesce("trace_id", "child").alias("trace_id"))


def conversations(messages: DataFrame, feedback: DataFrame, search: str | None = None, value: int | None = None) -> DataFrame:
    """``conversation_id, user_id, updated_s`` of conversations with a message that contains ``search`` and feedback of ``value``."""
    rows = messages.groupBy("conversation_id").agg(F.max("user_id").alias("user_id"), F.max("created_s").alias("updated_s"))
    if search is not None:
        hits = messages.where(F.lower("output_text").contains(search.lower())).select("conversation_id").distinct()
        rows = rows.join(hits, "conversation_id", "left_semi")
    if value is not None:
        rated = feedback.where(F.col("value") == value).join(messages.select(F.col("id").alias("message_id"), "conversation_id"), "message_id").select("conversation_id").distinct()
        rows = rows.join(rated, "conversation_id", "left_semi")
    return rows


def page(rows: DataFrame, cursors: DataFrame, limit: int) -> DataFrame:
    """``user_id, conversation_id, place, has_next``: each user's page after the cursor, latest first.

    ``cursors`` has ``(user_id, cursor)``; an unknown or null cursor starts at the top.
    """
    order = Window.partitionBy("user_id").orderBy(F.desc("updated_s"), "conversation_id")
    ranked = rows.withColumn("place", F.row_number().over(order)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    at = ranked.join(cursors, "user_id", "left").withColumn("start", F.coalesce(F.max(F.when(F.col("conversation_id") == F.col("cursor"), F.col("place"))).over(Window.partitionBy("user_id")), F.lit(0)))
    return at.where((F.col("place") > F.col("start")) & (F.col("place") <= F.col("start") + limit)).select("user_id", "conversation_id", "place", (F.col("total") > F.col("start") + limit).alias("has_next"))


def turns(messages: DataFrame) -> DataFrame:
    """``conversation_id, turn, question, answer`` from alternating user and assistant messages."""
    asked = messages.where("kind = 'user_message'").select("conversation_id", "turn", F.col("output_text").alias("question"))
    told = messages.where("kind = 'assistant_message'").select("conversation_id", (F.col("turn") - 1).alias("turn"), F.col("output_text").alias("answer"))
    return asked.join(told, ["conversation_id", "turn"])


def memory(rows: DataFrame, settings: MemorySettings = MemorySettings()) -> DataFrame:
    """``rows`` with ``overflow``: turns that go to the summary.

    Beyond ``recent_turns`` all but those; else, over ``trigger_chars`` characters, all but the last.
    """
    all_ = Window.partitionBy("conversation_id")
    back = F.row_number().over(all_.orderBy(F.desc("turn")))
    chars = F.length(F.coalesce("question", F.lit(""))) + F.length(F.coalesce("answer", F.lit("")))
    sized = rows.withColumn("back", back).withColumn("n", F.count(F.lit(1)).over(all_)).withColumn("chars", F.sum(chars).over(all_))
    over = F.when(F.col("n") > settings.recent_turns, F.col("back") > settings.recent_turns).otherwise((F.col("chars") > settings.trigger_chars) & (F.col("back") > 1))
    return sized.withColumn("overflow", over).drop("back", "n", "chars")


def history(rows: DataFrame, settings: MemorySettings = MemorySettings()) -> DataFrame:
    """``conversation_id, history``: recent turns as text, answers cut."""
    kept = memory(rows, settings).where("not overflow")
    line = F.concat(F.lit("user: "), F.coalesce("question", F.lit("")), F.lit("\nassistant: "), cut_chars(F.coalesce("answer", F.lit("")), settings.answer_chars))
    listed = kept.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("text")))).alias("l"))
    return listed.select("conversation_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("history"))

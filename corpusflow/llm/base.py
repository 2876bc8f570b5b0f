"""Small column helpers shared by the training-data operators.

A *word* is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``; null texts count as empty.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"


def body(text: str | Column = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a non-null text."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def let(value: Column, use) -> Column:
    """``use(v)`` with ``v`` bound to ``value``, which is computed once per row.

    Naming a column inside a lambda would let the optimizer inline its definition there and
    evaluate it once per element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors reach.

    Where it is unset, a session on one machine gets a temporary folder; a cluster must set it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
    return folder or tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table and reread, where later steps want few of its columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def others(docs: DataFrame, *names: str) -> list[str]:
    """The columns that don't clash with ``names``, whatever their case."""
    return [c for c in docs.columns if c.lower() not in names]


def join_facts(rows: DataFrame, facts: DataFrame, key: str | list[str], total: int, share: int = 1000) -> DataFrame:
    """``rows`` joined on ``key`` with ``facts``, which has one row for each key and the number ``n`` of its rows.

    A key that holds more than one in ``share`` of all ``total`` rows would fill one task. There are
    fewer than ``share`` such keys, so their facts go to every task; only the other rows are shuffled.
    """
    keys = [key] if isinstance(key, str) else key
    hot = F.broadcast(facts.where(F.col("n") * share > total).drop("n"))
    cold = facts.where(F.col("n") * share <= total).drop("n")
    return rows.join(hot, keys).unionByName(rows.join(hot.select(keys), keys, "left_anti").join(cold, keys))


def without_rows(docs: DataFrame, gone: DataFrame, limit: int) -> DataFrame:
    """``docs`` without the rows that ``gone(__id, __key)`` names by doc_id and the text's hash, with their columns.

    ``gone`` is cut and counted: up to ``limit`` names go to every task, and no text is moved; more
    are met by a shuffle.
    """
    gone = cut(gone)
    named = F.broadcast(gone) if gone.count() <= limit else gone
    rows = docs.select(F.struct("*").alias("__doc"), "doc_id", F.xxhash64("text").alias("__own"))
    same = (F.col("__own") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return rows.join(named, same, "left_anti").select("__doc.*")

"""Incremental ingest: what to do with each file, and idempotent writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

KEY = ["card_id", "row_id"]


def classify(plan: DataFrame, registry: DataFrame, force: bool = False) -> DataFrame:
    """``card_id, row_id, action, drop_rows`` of every planned or registered file.

    A file without a role is ``skipped`` (its rows go if it was indexed); one that is indexed with
    the same hash is ``unchanged`` or, with another fingerprint, ``metadata_only``; a registered
    file that isn't planned has ``vanished``; everything else is to ``parse``.
    """
    now = plan.select(*KEY, "role", "sha256", "fingerprint", F.lit(True).alias("planned"))
    old = registry.select(*KEY, F.col("sha256").alias("old_sha"), F.col("fingerprint").alias("old_print"), "status")
    met = now.join(old, KEY, "full")
    indexed = F.coalesce(F.col("status") == "indexed", F.lit(False))
    same = indexed & F.coalesce(F.col("old_sha") == F.col("sha256"), F.lit(False)) & F.lit(not force)
    action = (
        F.when(F.col("planned").isNull(), F.lit("vanished"))
        .when(F.col("role").isNull(), F.lit("skipped"))
        .when(same & F.col("old_print").eqNullSafe(F.col("fingerprint")), F.lit("unchanged"))
        .when(same, F.lit("metadata_only"))
        .otherwise(F.lit("parse"))
    )
    return met.withColumn("action", action).select(*KEY, "action", ((F.col("action") == "vanished") | ((F.col("action") == "skipped") & indexed)).alias("drop_rows"))


def vanished(plan: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered keys that the plan lacks."""
    return registry.select(*KEY).join(plan.select(*KEY), KEY, "left_anti")


def work_plan(classified: DataFrame, routes: DataFrame) -> DataFrame:
    """One row ``files_total, to_parse, model_files, unchanged, skipped``."""
    met = classified.where("action <> 'vanished'").join(routes.select(*KEY, "route").dropDuplicates(KEY), KEY, "left")
    parse = F.col("action") == "parse"
    return met.agg(
        F.count(F.lit(1)).alias("files_total"), F.count_if(parse).alias("to_parse"), F.count_if(parse & (F.col("route") == "model")).alias("model_files"),
        F.count_if(F.col("action").isin("unchanged", "metadata_only")).alias("unchanged"), F.count_if(F.col("action") == "skipped").alias("skipped"),
    )


def run_report(outcomes: DataFrame) -> DataFrame:
    """One row of counts and the share of files that went well, 1 if none was tried."""
    n = lambda s: F.count_if(F.col("status") == s)
    counted = outcomes.agg(F.count(F.lit(1)).alias("files_total"), *[n(s).alias(s) for s in ("indexed", "unchanged", "skipped", "failed")])
    tried = F.col("indexed") + F.col("unchanged") + F.col("failed")
    return counted.withColumn("success_share", F.when(tried > 0, F.round((F.col("indexed") + F.col("unchanged")) / tried, 6)).otherwise(F.lit(1.0)))


def error_reasons(outcomes: DataFrame, limit: int = 5) -> DataFrame:
    """``reason, n`` of failures, the text before the colon; ties in order of first appearance."""
    failed = outcomes.where("status = 'failed'").select(F.substring_index(F.coalesce("reason", F.lit("")), ":", 1).alias("reason"), "pos")
    counted = failed.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(limit).select("reason", "n")


def upsert_files(table: DataFrame, fresh: DataFrame, key: str = "file_row_id") -> DataFrame:
    """``table`` with all rows of the files in ``fresh`` replaced; running it twice changes nothing."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def set_payload(table: DataFrame, changes: DataFrame, columns: list[str], key: str = "file_row_id") -> DataFrame:
    """``table`` with ``columns`` replaced on all rows of a changed file, by nulls too; other columns stay."""
    new = changes.select(F.col(key).alias("__k"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    met = table.join(new, F.col(key) == F.col("__k"), "left")
    pick = lambda c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return met.select(*[pick(c) if c in columns else F.col(c) for c in table.columns])


def prune(table: DataFrame, keep: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is kept, and the one-row count of the others."""
    wanted = keep.select(key).distinct()
    return table.join(wanted, key, "left_semi"), table.join(wanted, key, "left_anti").agg(F.count(F.lit(1)).alias("removed"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def report_rows(outcomes: DataFrame, run_id: int) -> DataFrame:
    """``what, run, file``: a run as nested rows for a JSON file: one with its counts, one per file."""
    counts = run_report(outcomes).select(F.lit("run").alias("what"), F.struct(F.lit(run_id).alias("run_id"), "*").alias("run"))
    each = outcomes.select(F.lit("file").alias("what"), F.struct("card_id", "row_id", "status", "reason").alias("file"))
    return counts.unionByName(each, allowMissingColumns=True)


def upsert_both(children: DataFrame, parents: DataFrame, new_children: DataFrame, new_parents: DataFrame, key: str = "file_row_id") -> tuple[DataFrame, DataFrame]:
    """Both tables with all rows of the files that come anew, as chunks or as parents, replaced."""
    files = new_children.select(key).unionByName(new_parents.select(key)).distinct()
    swap = lambda table, fresh: table.join(files, key, "left_anti").unionByName(fresh)
    return swap(children, new_children), swap(parents, new_parents)

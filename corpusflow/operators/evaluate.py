"""Scores of question sets and the differences of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Words that name a conflict of documents, and the status word of documents in force
CONFLICT = r"(?iuU)отмен|утрат\w+ силу|недейств|противореч|заменён|заменен"
ACTIVE = "действует"
# Metric id, target, and whether larger is better
TARGETS = (
    ("M1-simple", 0.85, True), ("M1-multi_doc", 0.70, True), ("M1-duplicated", 0.0, True), ("M2", 0.90, True), ("M3-resolve", 1.0, True), ("M3-support", 0.90, True),
    ("M4", 0.80, True), ("M5", 0.70, True), ("M6", None, False), ("M7", 4.0, True), ("M8", 0.95, True),
)


def with_verdicts(outcomes: DataFrame) -> DataFrame:
    """Outcomes with ``judged, hit, refusal_ok, conflict_ok``.

    An empty list of expected documents is found, unless any of them would do. A judge's word
    counts only if it was parsed. A conflict is handled only by an answer that found its document.
    """
    found = F.transform("sources", lambda s: s["doc_id"])
    hit = F.when(F.col("expected_any"), F.arrays_overlap("expected_doc_ids", found)).otherwise(F.size(F.array_except("expected_doc_ids", found)) == 0)
    judged = F.coalesce(F.col("judge.parsed"), F.lit(False))
    active = (F.size("sources") > 0) & F.forall("sources", lambda s: F.coalesce(s["doc_status"] == ACTIVE, F.lit(False)))
    said = F.coalesce(F.col("answer").rlike(CONFLICT), F.lit(False))
    return (
        outcomes.withColumn("judged", judged)
        .withColumn("hit", F.coalesce(hit, F.lit(False)))
        .withColumn("refusal_ok", F.col("refused") | (judged & F.col("judge.refusal")))
        .withColumn("conflict_ok", F.col("hit") & (active | said | (judged & F.col("judge.conflict"))))
    )


def nearest_rank(values: Column, share: float) -> Column:
    """Percentile of an array by nearest rank, half to even; null when empty."""
    n = F.size(values)
    index = F.least(n - 1, F.greatest(F.lit(0), F.bround(F.lit(share) * n + 0.5).cast("int") - 1))
    return F.when(n > 0, F.element_at(F.sort_array(values), F.when(n > 0, index).otherwise(F.lit(0)) + 1))


def percentile_by(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """``keys, n, value`` by nearest rank, from counts of distinct values: no group's rows are gathered or sorted."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    along = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counted.withColumn("__upto", F.sum("__c").over(along)).withColumn("n", F.sum("__c").over(Window.partitionBy(*keys)))
    wanted = F.least(F.col("n") - 1, F.greatest(F.lit(0), F.bround(F.lit(share) * F.col("n") + 0.5).cast("bigint") - 1)) + 1
    return summed.where((F.col("__upto") >= wanted) & (F.col("__upto") - F.col("__c") < wanted)).select(*keys, "n", F.col(value).alias("value"))


def metrics(outcomes: DataFrame, signal_budget: float, ingest_share: float | None = None) -> DataFrame:
    """``id, value, target, reached``: eleven rows; a null value was not measured."""
    done = with_verdicts(outcomes).where("error is null")
    share = lambda cond, base: F.when(F.count_if(base) > 0, F.count_if(cond & base) / F.count_if(base))
    kind = lambda k: F.col("category") == k
    over = lambda num, den, base: F.when(F.sum(F.when(base, F.col(den))) > 0, F.sum(F.when(base, F.col(num))) / F.sum(F.when(base, F.col(den))))
    judged, answering = F.col("judged"), F.col("judged") & ~F.col("refusal_ok")
    values = {
        "M1-simple": share(F.col("hit"), kind("simple")),
        "M1-multi_doc": share(F.col("hit"), kind("multi_doc")),
        "M1-duplicated": share(F.col("hit"), kind("duplicated")),
        "M2": over("judge.with_citation", "judge.statements", judged),
        "M3-resolve": share(F.size("unresolved") == 0, F.lit(True)),
        "M3-support": over("judge.supported", "judge.citations", answering),
        "M4": share(F.col("refusal_ok"), kind("no_answer")),
        "M5": share(F.col("conflict_ok"), kind("contradiction")),
        "M7": F.avg(F.when(judged & kind("simple"), F.col("judge.correctness"))),
        "M8": F.lit(ingest_share).cast("double"),
    }
    row = done.agg(*[v.cast("double").alias(k.replace("-", "_")) for k, v in values.items()])
    tall = F.array(*[F.struct(F.lit(k).alias("id"), F.round(F.col(k.replace("-", "_")), 6).alias("value"), F.lit(signal_budget if t is None else t).cast("double").alias("target"), F.lit(up).alias("up")) for k, t, up in TARGETS if k in values])
    out = row.select(F.explode(tall).alias("m")).select("m.*")
    slow = percentile_by(done.withColumn("__all", F.lit(1)), ["__all"], "first_signal_s", 0.95).agg(F.round(F.max("value"), 6).alias("value"))
    out = out.unionByName(slow.select(F.lit("M6").alias("id"), "value", F.lit(signal_budget).cast("double").alias("target"), F.lit(False).alias("up")))
    reached = F.when(F.col("value").isNull(), F.lit("not measured")).when(F.when(F.col("up"), F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target")), F.lit("reached"))
    return out.select("id", "value", "target", reached.otherwise(F.lit("missed")).alias("reached"))


def diff_metrics(previous: DataFrame, current: DataFrame, least: float = 0.005) -> DataFrame:
    """``id, old, new, delta`` of metrics of both runs that moved by ``least`` or more."""
    met = current.select("id", F.col("value").alias("new")).join(previous.select("id", F.col("value").alias("old")), "id")
    return met.withColumn("delta", F.round(F.col("new") - F.col("old"), 6)).where(F.abs("delta") >= least).select("id", "old", "new", "delta")


def diff_questions(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``id, change``: new and missing questions, changed hits, and scores that moved (both above 0)."""
    old = previous.select("id", F.col("hit").alias("h0"), F.col("score").alias("s0"), F.lit(True).alias("was"))
    met = current.select("id", F.col("hit").alias("h1"), F.col("score").alias("s1"), F.lit(True).alias("now")).join(old, "id", "full")
    moved = (F.col("s0") > 0) & (F.col("s1") > 0) & (F.abs(F.col("s1") - F.col("s0")) >= 1)
    both = F.col("was") & F.col("now")
    changes = F.array(
        F.when(F.col("was").isNull(), F.lit("new")), F.when(F.col("now").isNull(), F.lit("missing")),
        F.when(both & (F.col("h0") != F.col("h1")), F.when(F.col("h1"), F.lit("found")).otherwise(F.lit("lost"))),
        F.when(both & moved, F.concat(F.lit("score "), F.col("s0").cast("string"), F.lit(" to "), F.col("s1").cast("string"))),
    )
    return met.select("id", F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("change"))


def run_report(outcomes: DataFrame, scores: DataFrame) -> DataFrame:
    """``what, metric, question``: a run as nested rows for a JSON file: one per metric, one per question with its verdicts."""
    judged = with_verdicts(outcomes)
    found = F.transform("sources", lambda s: s["doc_id"])
    question = F.struct("id", "category", "hit", "judged", "refusal_ok", "conflict_ok", found.alias("found_doc_ids"), "judge", "first_signal_s", "seconds", "error")
    rows = judged.select(F.lit("question").alias("what"), question.alias("question"))
    return scores.select(F.lit("metric").alias("what"), F.struct("id", "value", "target", "reached").alias("metric")).unionByName(rows, allowMissingColumns=True)

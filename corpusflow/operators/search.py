"""Batch hybrid search: filters, dense and sparse lists, rank fusion, reranking, context."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.embed import overlap_score
from ..functions.text import fold
from ..runtime import cut
from ..settings import SearchSettings
from .scoring import FACETS, DenseScorer, FilterMasks, Lists, SparseScorer


def known_values(chunks: DataFrame, field: str, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """Sorted distinct values of a field, at most ``known_values_limit``."""
    return chunks.where(F.col(field).isNotNull()).select(F.col(field).cast("string").alias("value")).distinct().orderBy("value").limit(settings.known_values_limit)


def match_known_values(requested: DataFrame, known: DataFrame) -> DataFrame:
    """``(request, value, known)``: for each requested value the known ones it means.

    Equal values (folded) win; otherwise those that contain the request or are contained in it; an
    unknown request stands for itself with ``known`` false. Blank requests mean nothing. Both
    lists are facets, the known one capped, so it is broadcast.
    """
    asked = requested.select("request", fold(F.col("request")).alias("r")).distinct().where("r <> ''")
    facts = F.broadcast(known.select("value", fold(F.col("value")).alias("v")))
    close = F.col("v").contains(F.col("r")) | F.col("r").contains(F.col("v"))
    met = asked.join(facts, close, "left").withColumn("exact", F.coalesce(F.col("v") == F.col("r"), F.lit(False)))
    best = met.withColumn("any", F.max("exact").over(Window.partitionBy("request")))
    kept = best.where(F.col("exact") | ~F.col("any"))
    return kept.select("request", F.coalesce("value", "request").alias("value"), F.col("value").isNotNull().alias("known"))


def search_filter(
    statuses: list[str] | None = None,
    kinds: list[str] | None = None,
    departments: list[str] | None = None,
    doc_ids: list | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    settings: SearchSettings = SearchSettings(),
) -> Column:
    """The condition on chunks: statuses (active ones unless given), kinds, departments, ids, and dates up to the end of ``date_to`` (UTC)."""
    keep = F.col("doc_status").isin(*(statuses or settings.default_statuses))
    for name, values in (("doc_kind", kinds), ("department", departments), ("doc_id", doc_ids)):
        if values:
            keep = keep & F.col(name).isin(*values)
    day = lambda d: F.unix_seconds(F.to_timestamp(F.lit(f"{d} 00:00:00")))
    if date_from:
        keep = keep & (F.col("doc_date_ts") >= day(date_from))
    if date_to:
        keep = keep & (F.col("doc_date_ts") < day(date_to) + 86400)
    return keep


def filter_rows(chunks: DataFrame, filters: DataFrame, settings: SearchSettings = SearchSettings(), query: str = "query_id") -> DataFrame:
    """``(query, chunk_id)`` of the chunks that each query's own filter admits.

    ``filters`` has ``statuses, kinds, departments, doc_ids`` (arrays; null or empty ones ask for
    nothing, but for statuses, where the active ones are meant) and ``date_from, date_to`` (dates,
    the last one included). Equal filters are tested once: chunks meet the distinct filters by
    status, and a filter's chunks then meet its queries by the filter's hash.
    """
    names = ["statuses", "kinds", "departments", "doc_ids", "date_from", "date_to"]
    keyed = filters.select(query, F.xxhash64(F.to_json(F.struct(*names))).alias("__f"), *names)
    distinct = keyed.select("__f", *names).dropDuplicates(["__f"])
    asks = lambda name: F.size(F.coalesce(F.col(name), F.array().cast(dict(filters.dtypes)[name]))) > 0
    statuses = F.when(asks("statuses"), F.col("statuses")).otherwise(F.array(*map(F.lit, settings.default_statuses)))
    distinct = distinct.withColumn("__status", F.explode(F.array_distinct(statuses)))
    keep = F.col("doc_status") == F.col("__status")
    for name, column in (("kinds", "doc_kind"), ("departments", "department"), ("doc_ids", "doc_id")):
        keep = keep & (~asks(name) | F.coalesce(F.array_contains(name, F.col(column)), F.lit(False)))
    second = lambda d: F.unix_seconds(F.col(d).cast("timestamp"))
    since, until = F.col("date_from").isNull() | (F.col("doc_date_ts") >= second("date_from")), F.col("date_to").isNull() | (F.col("doc_date_ts") < second("date_to") + 86400)
    facts = chunks.select("chunk_id", "doc_status", "doc_kind", "department", "doc_id", "doc_date_ts")
    few = distinct.count() <= settings.broadcast_filters
    met = facts.join(F.broadcast(distinct) if few else distinct, keep & F.coalesce(since & until, F.lit(False)))
    return keyed.select(query, "__f").join(met.select("__f", "chunk_id"), "__f").select(query, "chunk_id")


ASKED = ("statuses", "kinds", "departments", "doc_ids")


def top_lists(
    chunks: DataFrame, queries: DataFrame, k: int, vectors: dict[str, str], settings: SearchSettings = SearchSettings(), key: str = "chunk_id", query: str = "query_id", filters: DataFrame | None = None
) -> DataFrame:
    """``list, query, key, score, rank``: the ``k`` best chunks of each query by each of its lists, in one pass over the chunks.

    ``vectors`` names the columns of ``dense`` (arrays of numbers, by cosine) and ``sparse`` (arrays of
    ``token, weight``, by products; 0 is no hit). Scores are rounded to six digits, ties go to the
    smaller key. With ``filters`` (as ``filter_rows`` takes them; a query without a row has none but
    the default statuses) only chunks that a query's filter admits are ranked for it, which is
    decided before the best are taken.

    The queries' vectors and filters go to every task, after a check of their number; more are
    searched in further passes. Of a task's chunks only the best leave it, and they meet in two
    steps, by salt and by query.
    """
    second = lambda d, days: (F.unix_seconds(F.col(d).cast("timestamp")) + days * 86400)
    rows = queries.select(query, *[F.col(c).alias(name) for name, c in vectors.items()])
    if filters is not None:
        facts = filters.select(query, F.struct(*ASKED, second("date_from", 0).alias("since"), second("date_to", 1).alias("until")).alias("filter"))
        rows = rows.join(facts, query, "left")
    rows = cut(rows)
    passes, out = max(1, -(-rows.count() // settings.broadcast_queries)), None
    kind, kinds = dict(queries.dtypes)[query], dict(chunks.dtypes)
    id_kind = to_arrow_type(queries.schema[query].dataType)
    facets = [c for _, c in FACETS] + ["doc_date_ts"] if filters is not None else []
    held = chunks.select(F.col(key).alias("key"), *[F.col(c).alias(name) for name, c in vectors.items()], *facets)
    for n in range(passes):
        asked = (rows if passes == 1 else rows.where(F.pmod(F.xxhash64(query), F.lit(passes)) == n)).collect()  # about broadcast_queries
        scorers = {name: (DenseScorer if name == "dense" else SparseScorer)([r[name] for r in asked]) for name in vectors}
        none = dict.fromkeys((*ASKED, "since", "until"))
        masks = FilterMasks([r["filter"].asDict() if r["filter"] else none for r in asked], settings.default_statuses) if filters is not None else None
        lists, ids = Lists(scorers, len(asked), k, settings.product_cells, masks), [r[query] for r in asked]

        def top(batches: Iterator[pa.RecordBatch], lists: Lists = lists, ids: list = ids) -> Iterator[pa.RecordBatch]:
            for name, rows, key_kind in lists.run(batches, "key"):
                made = [pa.array([name] * len(rows)), pa.array([ids[q] for q in rows["q"]], id_kind), pa.array(rows["key"], key_kind), pa.array(rows["score"] + 0.0, pa.float64())]
                yield pa.RecordBatch.from_arrays(made, names=["list", query, key, "score"])

        found = held.mapInArrow(top, f"list string, {query} {kind}, {key} {kinds[key]}, score double")
        out = found if out is None else out.unionByName(found)
    return ranked(out, ["list", query], key, k)


def dense_top(chunks: DataFrame, queries: DataFrame, k: int, settings: SearchSettings = SearchSettings(), key: str = "chunk_id", query: str = "query_id", vector: str = "dense", filters: DataFrame | None = None) -> DataFrame:
    """``(query, key, score, rank)``: the ``k`` nearest chunks of each query by cosine; zero vectors score 0."""
    return top_lists(chunks, queries, k, {"dense": vector}, settings, key, query, filters).drop("list")


def sparse_top(chunks: DataFrame, queries: DataFrame, k: int, settings: SearchSettings = SearchSettings(), key: str = "chunk_id", query: str = "query_id", vector: str = "sparse", filters: DataFrame | None = None) -> DataFrame:
    """``(query, key, score, rank)``: the ``k`` best chunks by the product of weights of shared tokens.

    Of a token that comes several times in a vector the largest weight counts.
    """
    return top_lists(chunks, queries, k, {"sparse": vector}, settings, key, query, filters).drop("list")


def both_top(chunks: DataFrame, queries: DataFrame, k: int, settings: SearchSettings = SearchSettings(), key: str = "chunk_id", query: str = "query_id", filters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The dense and the sparse list of ``(dense, sparse)`` vectors, of one pass over the chunks that is written down."""
    both = cut(top_lists(chunks, queries, k, {"dense": "dense", "sparse": "sparse"}, settings, key, query, filters))
    return tuple(both.where(F.col("list") == name).drop("list") for name in ("dense", "sparse"))


def ranked(scored: DataFrame, by: list[str], key: str, k: int, salts: int = 32) -> DataFrame:
    """The ``k`` best of each group with their ``rank``, first by salt, so that no task gets all candidates of a group."""
    order = [F.desc("score"), key]
    place = lambda rows, *groups: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by, *groups).orderBy(*order))).where(F.col("rank") <= k)
    some = place(scored.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(salts))), "__salt")
    return place(some.drop("rank", "__salt"))


def fuse(dense: DataFrame, sparse: DataFrame, settings: SearchSettings = SearchSettings(), key: str = "chunk_id", query: str = "query_id") -> DataFrame:
    """``(query, key, rrf, fusion_rank)``: reciprocal rank fusion, the best ``candidates``; ranks from 1, ties by key."""
    both = dense.select(query, key, "rank").unionByName(sparse.select(query, key, "rank"))
    summed = both.groupBy(query, key).agg(F.round(F.sum(1.0 / (F.lit(settings.rrf_k) + F.col("rank"))), 9).alias("rrf"))
    order = Window.partitionBy(query).orderBy(F.desc("rrf"), key)
    return summed.withColumn("fusion_rank", F.row_number().over(order)).where(F.col("fusion_rank") <= settings.candidates)


def rerank(fused: DataFrame, chunks: DataFrame, queries: DataFrame, top_k: int | None = None, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """``(query_id, chunk_id, score, fusion_rank, rank, parent_id, body)``: fused candidates by word overlap, the best ``top_k``."""
    limit = max(1, min(top_k or settings.top_k, settings.max_top_k))
    texts = chunks.select("chunk_id", "parent_id", "body")
    pairs = fused.join(texts, "chunk_id").join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    scored = pairs.withColumn("score", F.round(overlap_score(F.col("question"), F.col("body")), 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fusion_rank")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.select("query_id", "chunk_id", "score", "fusion_rank", "rank", "parent_id", "body")


def with_context(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits with the body of their parent section as ``context``; null without one."""
    return hits.join(parents.select("parent_id", F.col("body").alias("context")), "parent_id", "left")


def weak_evidence(fragments: DataFrame, floor: float = 0.3) -> DataFrame:
    """``(question_id, best, weak)``: the best score of fresh fragments and whether it is below the floor; no fresh one is weak."""
    best = fragments.groupBy("question_id").agg(F.max(F.when(~F.col("cached"), F.col("score"))).alias("best"))
    return best.withColumn("weak", F.coalesce(F.col("best") < floor, F.lit(True)))

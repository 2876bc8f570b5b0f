"""A deterministic embedder and reranker on word hashes, and hooks for real models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import words

SPARSE_PLACES = 10007


def word_code(word: Column) -> Column:
    """Sum of the code points."""
    return F.aggregate(F.split(word, ""), F.lit(0), lambda total, c: total + F.ascii(c))


def coded_words(text: Column) -> Column:
    """``array<struct<code, length>>`` of the lower-cased words."""
    return F.transform(words(F.lower(text)), lambda w: F.struct(word_code(w).alias("code"), F.length(w).alias("length")))


def dense_vector(coded: Column, dims: int) -> Column:
    """Words counted by ``code % dims``, scaled to length 1; zeros without words.

    Words, counts and length are bound by lambdas, so that each is computed once a row, whatever the
    optimizer copies; the words of a place are counted by what removing them leaves.
    """
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    counts = lambda places: F.array(*[(F.size(places) - F.size(F.array_remove(places, d))).cast("double") for d in range(dims)])
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    scaled = lambda v: once(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))
    return once(once(F.transform(coded, lambda w: w["code"] % dims), counts), scaled)


def sparse_vector(coded: Column) -> Column:
    """``array<struct<token, weight>>`` of coded words; tokens may repeat, the largest weight counts."""
    weight = lambda w: F.lit(1.0) + w["length"] / F.lit(10)
    return F.transform(coded, lambda w: F.struct((w["code"] % SPARSE_PLACES).alias("token"), weight(w).alias("weight")))


def sparse_terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, token, weight)``: of each token the largest weight of its words."""
    coded = rows.select(key, F.explode(coded_words(F.col(text))).alias("w"))
    weight = F.lit(1.0) + F.col("w.length") / F.lit(10)
    return coded.groupBy(key, (F.col("w.code") % SPARSE_PLACES).alias("token")).agg(F.max(weight).alias("weight"))


def pooled_maps(terms: DataFrame, key: str) -> DataFrame:
    """``(key, sparse)`` map of token to the largest positive weight."""
    best = terms.where("weight > 0").groupBy(key, "token").agg(F.max("weight").alias("weight"))
    return best.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "weight")))).alias("sparse"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column, squares: tuple[Column, Column] | None = None) -> Column:
    """Cosine of two vectors; where each meets many others, their ``squares`` (``dot`` with themselves) are made once, before they meet."""
    of_a, of_b = squares or (dot(a, a), dot(b, b))
    return dot(a, b) / F.sqrt(of_a * of_b)


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has; 0 for an empty query."""
    wanted = F.array_distinct(words(F.lower(query)))
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, words(F.lower(text)))) / F.size(wanted)).otherwise(F.lit(0.0))


def embed_with(rows: DataFrame, key: str, text: str, factory: Callable[[], Callable[[list[str]], list[tuple[list[float], dict[int, float]]]]], batch: int = 16) -> DataFrame:
    """``(key, dense, sparse)`` by a model that ``factory`` loads once per task."""
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            made = [v for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])]
            yield pd.DataFrame({key: frame[key], "dense": [list(d) for d, _ in made], "sparse": [list(s.items()) for _, s in made]})

    out = rows.select(key, text).mapInPandas(run, f"{key} {kind}, dense array<double>, sparse array<struct<token:int,weight:double>>")
    return out.withColumn("sparse", F.map_from_entries("sparse"))


def rerank_with(pairs: DataFrame, query: str, text: str, factory: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 32) -> DataFrame:
    """``pairs`` with ``score`` by a model that ``factory`` loads once per task."""
    fields = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes if n != "score")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = factory()
        for frame in frames:
            asked = list(zip(frame[query].fillna(""), frame[text].fillna("")))
            yield frame.assign(score=[float(s) for i in range(0, len(asked), batch) for s in score(asked[i : i + batch])])

    return pairs.drop("score").mapInPandas(run, f"{fields}, score double")

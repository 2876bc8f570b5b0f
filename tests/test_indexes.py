"""Stored indexes and filters inside the search, against brute force."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import postings, search, vectorindex
from corpusflow.settings import SearchSettings

SPARSE = "array<struct<token:int,weight:double>>"


def folder():
    return f"{tempfile.mkdtemp(prefix='spark-')}/index"


def triples(frame, query="query_id", key="chunk_id"):
    return {(r[query], r[key], r["score"], r["rank"]) for r in frame.collect()}


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 24)) * 3
    rows = [(i, (centers[i % 40] + rng.normal(size=24)).tolist()) for i in range(4000)] + [(4000, None), (4001, [0.0] * 24), (4002, [])] + [(5000 + i, centers[0].tolist()) for i in range(300)]
    return spark.createDataFrame(rows, "chunk_id bigint, dense array<double>")


def test_vector_index_finds_nine_of_ten_in_a_part(spark, clouds):
    at, q = folder(), vectorindex.VectorIndexSettings(rows_per_cell=100)
    vectorindex.build(clouds, at, q)
    assert spark.read.parquet(f"{at}/rows").count() == clouds.count()  # every row is in it
    asked = clouds.where("chunk_id % 100 = 0 and chunk_id < 4000").select(F.col("chunk_id").alias("query_id"), "dense")
    exact = triples(search.dense_top(clouds, asked, 20))
    found = triples(vectorindex.search(at, asked, 20, q))
    pairs = lambda rows: {r[:2] for r in rows}
    assert len(pairs(found) & pairs(exact)) >= 0.9 * len(exact)
    assert vectorindex.share_read(at, asked, q) < 0.5
    whole = vectorindex.VectorIndexSettings(rows_per_cell=100, probes=10_000)
    assert triples(vectorindex.search(at, asked, 20, whole, SearchSettings(broadcast_queries=7, product_cells=300))) == exact


def test_vector_index_of_little(spark, clouds):
    at = folder()
    vectorindex.build(clouds.limit(0), at)
    asked = clouds.where("chunk_id = 3").select(F.col("chunk_id").alias("query_id"), "dense")
    assert vectorindex.search(at, asked.limit(0), 5).count() == 0
    one = folder()
    vectorindex.build(clouds.where("chunk_id in (3, 4000, 4001, 4002)"), one)
    assert [r["chunk_id"] for r in vectorindex.search(one, asked, 5, vectorindex.VectorIndexSettings(probes=99)).orderBy("rank").collect()] == [3, 4000, 4001, 4002]


@pytest.mark.parametrize("k, first", [(3, 1), (10, 8)])
def test_inverted_index_gives_the_same_rows(spark, k, first):
    rng = random.Random(k)
    draw = lambda n, top: [(min(int(rng.expovariate(1 / 40)), 900), round(rng.uniform(0.2, top), 1)) for _ in range(n)]
    rows = [(f"c{i}", draw(rng.choice([1, 2, 5, 30]), 3.0)) for i in range(900)] + [("none", None), ("empty", []), ("zero", [(3, 0.0)])] + [(f"same{i}", [(1, 1.0), (2, 2.0), (1, 3.0)]) for i in range(60)]
    chunks = spark.createDataFrame(rows, f"chunk_id string, sparse {SPARSE}")
    asked = spark.createDataFrame([(i, draw(rng.choice([1, 4, 12]), 2.0)) for i in range(25)] + [(90, None), (91, [(9999, 1.0)]), (92, [(1, 1.0), (1, 2.0)])], f"query_id int, sparse {SPARSE}")
    at, q = folder(), postings.PostingSettings(range_chunks=8, first_ranges=first)
    postings.build(chunks, at, q)
    assert triples(postings.search(at, asked, k, q)) == triples(search.sparse_top(chunks, asked, k))
    assert postings.share_read(at, asked, k, q) < 0.8
    empty = folder()
    postings.build(chunks.limit(0), empty, q)
    assert postings.search(empty, asked, k, q).count() == 0


def test_filters_inside_the_search(spark):
    """Like filtering for each question alone, with nulls, unknown values and filters that nothing passes."""
    rng = random.Random(9)
    some = lambda *v: rng.choice([None, *v])
    rows = [(f"c{i:03}", [rng.random(), rng.random()], [(rng.randrange(9), 1.0)], some("active", "cancelled", "draft"), some("a", "b"), some("x", "y"), rng.choice([None, i % 7]), some(1704067200 + i * 8640)) for i in range(400)]
    chunks = spark.createDataFrame(rows, f"chunk_id string, dense array<double>, sparse {SPARSE}, doc_status string, doc_kind string, department string, doc_id bigint, doc_date_ts bigint")
    lists = lambda *v: rng.choice([None, [], rng.sample(v, rng.randint(1, len(v)))])
    day = lambda: rng.choice([None, f"2024-01-{rng.randint(1, 28):02}"])
    asked = [(i, [rng.random(), rng.random()], [(rng.randrange(9), 1.0)], lists("active", "cancelled", "odd"), lists("a", "b", "odd"), lists("x", "y"), lists(1, 2, 3, 99), day(), day()) for i in range(40)]
    schema = f"query_id int, dense array<double>, sparse {SPARSE}, statuses array<string>, kinds array<string>, departments array<string>, doc_ids array<bigint>, date_from string, date_to string"
    table = spark.createDataFrame(asked, schema)
    filters = table.where("query_id < 38").select("query_id", "statuses", "kinds", "departments", "doc_ids", F.to_date("date_from").alias("date_from"), F.to_date("date_to").alias("date_to"))
    got = search.top_lists(chunks, table, 6, {"dense": "dense", "sparse": "sparse"}, SearchSettings(product_cells=500), filters=filters).collect()
    admitted = {(r["query_id"], r["chunk_id"]) for r in search.filter_rows(chunks, filters).collect()} | {(i, r[0]) for i in (38, 39) for r in rows if r[3] == "active"}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = set()
    for q in asked:
        mine = [r for r in rows if (q[0], r[0]) in admitted]
        dense = sorted((-round(float(unit(q[1]) @ unit(r[1])), 6), r[0]) for r in mine)[:6]
        sparse = sorted((-1.0, r[0]) for r in mine if r[2][0][0] == q[2][0][0])[:6]
        want |= {("dense", q[0], c, -s, n + 1) for n, (s, c) in enumerate(dense)} | {("sparse", q[0], c, -s, n + 1) for n, (s, c) in enumerate(sparse)}
    assert {(r["list"], r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in got} == want and len(want) > 100

"""Queries on files, the registry and search, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import embed, ids, text
from ..operators import answers, evidence, files, postings, registry, search, vectorindex
from ..runtime import shared_folder
from ..settings import FileRules, SearchSettings
from ..sources import io
from ..sources.store import BucketStore
from .standins import ctes, standin

SEARCH = SearchSettings()
FILES = FileRules()


def _chunks(spark, d) -> DataFrame:
    return standin(spark, d, "chunks")


def _vectors(rows: DataFrame, key: str, body: str) -> DataFrame:
    coded = rows.select(key, embed.coded_words(F.col(body)).alias("coded"))
    return coded.select(key, embed.dense_vector(F.col("coded"), SEARCH.dims).alias("dense"), embed.sparse_vector(F.col("coded")).alias("sparse"))


def sc1_clause_numbers(spark, d):
    rows = standin(spark, d, "lines").select("doc_id", "n", F.concat(F.when(F.col("n") % 3 == 0, F.concat_ws("", (F.col("n") % 9 + 1).cast("string"), F.lit("."), (F.col("n") % 4).cast("string"), F.lit(". "))).when(F.col("n") % 3 == 1, F.concat((F.col("n") % 2100).cast("string"), F.lit(") "))).otherwise(F.lit("04.09.2026 ")), "line").alias("t"))
    return rows.select("doc_id", "n", text.clause_number(F.col("t")).alias("clause"), text.header_number(F.col("t")).alias("header"), text.bare_number(F.regexp_replace(F.col("t"), r" .*", "")).alias("bare"))


def sc22_word_counts(spark, d):
    return standin(spark, d, "lines").select("doc_id", "n", text.word_count(F.col("line")).cast("bigint").alias("tokens"))


def sc6_ids(spark, d):
    rows = _chunks(spark, d)
    return rows.select("chunk_id", ids.chunk_id(F.md5(F.col("parent_id").cast("binary")), F.col("n")).alias("id"), ids.parent_id(F.lit("x"), F.col("n")).alias("pid"))


def sc7_normalized(spark, d):
    rows = _chunks(spark, d).select("chunk_id", F.concat(F.lit(" «"), F.upper(F.substring("body", 1, 30)), F.lit("»;")).alias("term"), F.concat(F.lit("Раздел "), (F.col("n") % 9).cast("string"), F.lit(". "), F.col("body")).alias("heading"))
    return rows.select("chunk_id", text.normalize_term(F.col("term")).alias("term_key"), text.normalize_heading(F.col("heading")).alias("heading_key"))


def sc19_cuts(spark, d):
    return _chunks(spark, d).select("chunk_id", text.cut_words(F.col("body"), 5).alias("short"), text.cut_chars(F.col("body"), 40).alias("cut"))


def sc14_numbers(spark, d):
    rows = _chunks(spark, d).select("chunk_id", F.concat_ws(" ", "body", F.lit("[S1]"), (F.col("n") + 7).cast("string"), F.lit("12:45 + 45 минут = 13:30, 9.05 или 10:10 (уход) + 5 мин = 10:16")).alias("t"))
    c = F.col("t")
    return rows.select("chunk_id", F.array_join(text.numbers_in(c), "|").alias("numbers"), F.array_join(text.times_in(c), "|").alias("times"), F.array_join(text.computed_times(c), "|").alias("computed"))


def sc12_candidate_terms(spark, d):
    rows = _chunks(spark, d).select("chunk_id", F.concat(F.lit("ABC, ПВТР и "), F.upper(F.col("doc_kind")), F.lit(" "), "body", F.lit(" ТН2 ПВТР")).alias("t"))
    return rows.select("chunk_id", F.array_join(text.candidate_terms(F.col("t")), "|").alias("terms"))


def sc23_dense(spark, d):
    v = _vectors(_chunks(spark, d), "chunk_id", "body")
    return v.select("chunk_id", *[F.round(F.get("dense", i), 6).alias(f"d{i}") for i in range(SEARCH.dims)])


def ag15_sparse(spark, d):
    return embed.sparse_terms(_chunks(spark, d), "chunk_id", "body").select("chunk_id", "token", F.round("weight", 6).alias("weight"))


def _fused(spark, d):
    """Every question's fused candidates with both texts."""
    chunks, queries, dense, sparse = _lists(spark, d)
    found = search.fuse(dense, sparse).join(chunks, "chunk_id")
    return found.join(queries.withColumnRenamed("text", "question"), "query_id")


def sc24_overlap(spark, d):
    return _fused(spark, d).select("chunk_id", "query_id", F.round(embed.overlap_score(F.col("question"), F.col("body")), 6).alias("score"))


def ud2_reranked(spark, d):
    def factory():
        return lambda pairs: [len(set(q.split()) & set(t.split())) / max(1, len(set(q.split()))) for q, t in pairs]

    pairs = _fused(spark, d).select("query_id", "chunk_id", "question", "body")
    return embed.rerank_with(pairs, "question", "body", factory).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def wn13_evidence(spark, d):
    """The evidence of each question: its candidates, in their order, within a budget."""
    blocks = _fused(spark, d).select(F.col("query_id").alias("question_id"), F.col("fusion_rank").alias("n"), F.when(F.col("fusion_rank") % 3 == 0, "document").otherwise("search").alias("kind"), F.col("body").alias("text"))
    return answers.pack_evidence(blocks, 900, 60)


EVIDENCE = evidence.EvidenceSettings(max_chars=6000, context_chars=120, least=200)


def _evidence_tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, and what a run found for each: documents with and without cards, sections, hits and hits of earlier turns."""
    hits = _fused(spark, d).withColumn("n", F.col("fusion_rank"))
    parents = _chunks(spark, d).where("n % 4 < 2").groupBy("parent_id").agg(F.max_by("body", "n").alias("context"))
    name, n = F.concat(F.lit("D"), F.col("doc_id").cast("string")), F.col("n")
    fragments = hits.join(parents, "parent_id", "left").select(
        "query_id", "n", F.concat(F.lit("S"), n.cast("string")).alias("alias"), F.when(n % 6 == 5, "section").otherwise("hit").alias("kind"), (n % 4 == 0).alias("cached"), F.when(n % 6 == 5, F.col("parent_id")).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(n % 7 != 0, F.col("parent_id")).alias("parent_id"), name.alias("doc_alias"), F.col("doc_status").alias("status"), F.when(n % 3 != 0, n).cast("int").alias("page_no"), F.col("doc_kind").alias("breadcrumbs"), F.col("body").alias("text"), "context",
    ).withColumnRenamed("query_id", "question_id")
    k = F.col("doc_id") % 5
    documents = hits.select(
        F.col("query_id").alias("question_id"), "n", name.alias("alias"), F.when(k != 1, F.concat(F.lit("paper "), "doc_id")).alias("label"), F.col("doc_status").alias("status"),
        F.when(k < 2, F.concat(F.lit("head\nfirst "), "doc_kind", F.lit("\nsecond "), F.substring("body", 1, 200))).alias("card_text"), F.when(k != 2, F.lit("about")).alias("subject"), F.when(k != 3, F.col("department")).alias("department"),
        F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 11).cast("int")), lambda i: F.concat(F.lit("relation "), i.cast("string"))).alias("relations"),
    )
    return standin(spark, d, "queries").select(F.col("query_id").alias("question_id")).union(spark.sql("SELECT -1L")), documents, fragments


def wn13_rendered(spark, d):
    """The whole evidence of each question, as one text within its budget."""
    return evidence.render_evidence(*_evidence_tables(spark, d), EVIDENCE)


def sc25_cosine(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", "embedding", embed.dot(F.col("embedding"), F.col("embedding")).alias("square"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("l"), F.col("embedding").alias("q"), F.col("square").alias("q_square"))
    score = embed.cosine(F.col("q"), F.col("embedding"), (F.col("q_square"), F.col("square")))
    return e.join(q, F.col("label") == F.col("l")).select("query_id", "vec_id", F.round(score, 6).alias("score"))


def tk1_dense_top(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").alias("dense"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "dense")
    return search.dense_top(e, q, SEARCH.prefetch, key="vec_id")


def _index(spark) -> str:
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"


def _vector_index(spark, d, probes: int | None = None):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").alias("dense"))
    q, folder = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "dense"), _index(spark)
    vectorindex.build(e, folder, key="vec_id")
    return vectorindex.search(folder, q, SEARCH.prefetch, vectorindex.VectorIndexSettings(probes=probes), key="vec_id")


def tk1_index_top(spark, d):
    """The nearest vectors by a stored index of which few cells are read."""
    return _vector_index(spark, d)


def tk1_index_exact(spark, d):
    """The same with all cells, as a check that every row is in the index."""
    return _vector_index(spark, d, vectorindex.VectorIndexSettings().most_cells)


def tk2_index_top(spark, d):
    """The best chunks by a stored inverted index of which unpromising ranges are not read."""
    chunks, folder = _chunks(spark, d).where(search.search_filter()), _index(spark)
    postings.build(_vectors(chunks, "chunk_id", "body"), folder)
    return postings.search(folder, _vectors(standin(spark, d, "queries"), "query_id", "text"), SEARCH.prefetch)


def _lists(spark, d):
    chunks, queries = _chunks(spark, d).where(search.search_filter()), standin(spark, d, "queries")
    return chunks, queries, *search.both_top(_vectors(chunks, "chunk_id", "body"), _vectors(queries, "query_id", "text"), SEARCH.prefetch)


def tk2_sparse_top(spark, d):
    return _lists(spark, d)[3]


def wn7_fusion(spark, d):
    _, _, dense, sparse = _lists(spark, d)
    return search.fuse(dense, sparse)


def tk3_hybrid_search(spark, d):
    chunks, queries, dense, sparse = _lists(spark, d)
    hits = search.rerank(search.fuse(dense, sparse), chunks, queries)
    return hits.select("query_id", "chunk_id", "score", "fusion_rank", "rank", "parent_id")


def jn12_context(spark, d):
    chunks = _chunks(spark, d)
    hits = chunks.select("chunk_id", "parent_id")
    parents = chunks.groupBy("parent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "body"))), lambda r: r["body"]), "\n").alias("body")).where("parent_id not like '%3'")
    return search.with_context(hits, parents).select("chunk_id", "parent_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


def flt4_filter(spark, d):
    keep = search.search_filter(kinds=["src1", "src2", "src3"], departments=["en", "fr"], date_from="2024-02-01", date_to="2024-10-31")
    return _chunks(spark, d).where(keep).select("chunk_id", "doc_kind", "department", "doc_date_ts")


def _filters(spark, d) -> DataFrame:
    """A filter for each question."""
    q = standin(spark, d, "queries")
    some = lambda cond, *values: F.when(cond, F.array(*map(F.lit, values)))
    id_ = F.col("query_id")
    return q.select(
        "query_id", some(id_ % 4 == 1, "cancelled", "active").alias("statuses"), some(id_ % 3 == 0, "src1", "src2").alias("kinds"), some(id_ % 5 == 2, "en", "de").alias("departments"),
        F.array().cast("array<bigint>").alias("doc_ids"), F.when(id_ % 2 == 0, F.to_date(F.lit("2024-03-01"))).alias("date_from"), F.when(id_ % 7 == 0, F.to_date(F.lit("2024-06-30"))).alias("date_to"),
    )


def flt4_by_query(spark, d):
    """What each question's filter admits."""
    return search.filter_rows(_chunks(spark, d), _filters(spark, d)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last"))


def flt4_search(spark, d):
    """Each question's lists, dense and sparse, under a filter of its own."""
    chunks, queries = _chunks(spark, d), standin(spark, d, "queries")
    facets = chunks.select("chunk_id", "doc_status", "doc_kind", "department", "doc_id", "doc_date_ts", embed.coded_words(F.col("body")).alias("coded"))
    vectors = facets.select("*", embed.dense_vector(F.col("coded"), SEARCH.dims).alias("dense"), embed.sparse_vector(F.col("coded")).alias("sparse"))
    lists = {"dense": "dense", "sparse": "sparse"}
    return search.top_lists(vectors, _vectors(queries, "query_id", "text"), SEARCH.prefetch, lists, SEARCH, filters=_filters(spark, d))


def ag13_known_values(spark, d):
    return search.known_values(_chunks(spark, d), "doc_kind")


def flt5_known_values(spark, d):
    chunks = _chunks(spark, d)
    asked = chunks.select(F.concat(F.upper("doc_kind"), F.lit(" ")).alias("request")).union(spark.createDataFrame([("src",), ("nothing",), (" ",), ("rc1",)], "request string")).distinct()
    return search.match_known_values(asked, search.known_values(chunks, "doc_kind"))


def ag16_evidence(spark, d):
    e = standin(spark, d, "agent_events")
    return search.weak_evidence(e.select("question_id", ((F.col("seq") % 100) / 250.0).alias("score"), (F.col("seq") % 3 == 0).alias("cached")))


def flt2_skip_reasons(spark, d):
    return files.download_skip(standin(spark, d, "files"), ("pdf", "docx", "xlsx", "pptx")).select("card_id", "row_id", "skip_reason", "skip_detail")


def wn1_file_roles(spark, d):
    return files.file_roles(standin(spark, d, "files"), standin(spark, d, "cards"))


def _owned(spark, d):
    f, c = standin(spark, d, "files"), standin(spark, d, "cards")
    return files.content_owners(files.file_roles(f, c, whole=True), f, c)


def wn2_content_owners(spark, d):
    return _owned(spark, d)[0]


def wn2_also_in(spark, d):
    return _owned(spark, d)[1].select("card_id", "row_id", "copy_row_id", "also_in")


def wn3_duplicates(spark, d):
    return files.mark_duplicates(standin(spark, d, "files"), standin(spark, d, "cards"))


def flt7_routes(spark, d):
    return files.parse_route(standin(spark, d, "pages_text"))


def flt8_inspection(spark, d):
    return files.inspect_pages(standin(spark, d, "pages_text"), (r"\bla\b", r"^the "))


def jn1_admitted(spark, d):
    good, issues = files.admit_files(standin(spark, d, "manifest_files"), standin(spark, d, "known_cards"), standin(spark, d, "disk"))
    return good.select(F.lit("ok").alias("kind"), "card_id", "row_id", "path").unionByName(issues)


def jn2_orphans(spark, d):
    return files.orphan_files(standin(spark, d, "disk"), standin(spark, d, "manifest_files"), standin(spark, d, "known_cards"))


def jn7_actions(spark, d):
    return registry.classify(standin(spark, d, "plan"), standin(spark, d, "registry"))


def jn8_vanished(spark, d):
    return registry.vanished(standin(spark, d, "plan"), standin(spark, d, "registry"))


def ag5_work_plan(spark, d):
    plan = standin(spark, d, "plan")
    return registry.work_plan(registry.classify(plan, standin(spark, d, "registry")), plan)


def _outcomes(spark, d):
    return standin(spark, d, "files").select(F.when(F.col("supp") % 6 == 0, "skipped").when(F.col("supp") % 7 == 0, "failed").when(F.col("supp") % 2 == 0, "unchanged").otherwise("indexed").alias("status"), F.concat(F.lit("reason "), (F.col("supp") % 8).cast("string"), F.lit(": "), "name").alias("reason"), (F.col("card_id") * 10 + F.col("pos")).alias("pos"), "card_id", "row_id")


def ag6_run_report(spark, d):
    return registry.run_report(_outcomes(spark, d))


def snk6_report(spark, d):
    """The report of a run as nested JSON, written and read back."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    io.write_json(registry.report_rows(_outcomes(spark, d), 7), path)
    shape = "what string, run struct<run_id:int,files_total:bigint,indexed:bigint,failed:bigint,success_share:double>, file struct<card_id:bigint,row_id:string,status:string,reason:string>"
    back = spark.read.schema(shape).json(path)
    return back.select("what", "run.files_total", "run.indexed", "run.success_share", "file.card_id", "file.row_id", "file.status", "file.reason")


def ag6_error_reasons(spark, d):
    return registry.error_reasons(_outcomes(spark, d))


def snk1_upsert(spark, d):
    c = _chunks(spark, d).select("chunk_id", F.col("doc_id").alias("file_row_id"), F.col("doc_status").alias("v"))
    fresh = c.where("file_row_id % 4 = 1").select(F.concat("chunk_id", F.lit("n")).alias("chunk_id"), "file_row_id", F.lit("new").alias("v"))
    once = registry.upsert_files(c, fresh)
    return registry.upsert_files(once, fresh)


def snk1_parents(spark, d):
    """Parents follow their file: those of files that come anew are replaced, though no parent comes for some."""
    c = _chunks(spark, d).select("chunk_id", F.col("doc_id").alias("file_row_id"))
    p = _chunks(spark, d).select("parent_id", F.col("doc_id").alias("file_row_id")).distinct()
    fresh = c.where("file_row_id % 4 = 1")
    made = fresh.where("file_row_id % 8 = 1").select(F.concat(F.lit("new-"), F.col("file_row_id").cast("string")).alias("parent_id"), "file_row_id").distinct()
    return registry.upsert_both(c, p, fresh, made)[1]


def snk2_payload(spark, d):
    c = _chunks(spark, d).select("chunk_id", F.col("doc_id").alias("file_row_id"), "department", "doc_status", "n")
    changes = c.select("file_row_id").distinct().where("file_row_id % 3 = 0").select("file_row_id", F.lit(None).cast("string").alias("department"), F.lit("draft").alias("doc_status"))
    return registry.set_payload(c, changes, ["department", "doc_status"])


def snk3_pruned(spark, d):
    c = _chunks(spark, d)
    return registry.prune(c.select("chunk_id", "doc_id"), c.where("doc_id % 5 <> 2").select("chunk_id"), "chunk_id")[0]


def snk3_removed(spark, d):
    c = _chunks(spark, d)
    return registry.prune(c.select("chunk_id"), c.where("doc_id % 5 <> 2").select("chunk_id"), "chunk_id")[1]


def _store(spark, d) -> BucketStore:
    """The chunks as a stored table: written, then with files replaced, dropped and relabelled in three changes."""
    c = _chunks(spark, d).select("chunk_id", F.col("doc_id").alias("file_row_id"), "department", "doc_status", "n")
    table = BucketStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", c.schema, buckets=16)
    table.apply(c)
    table.apply(c.where("file_row_id % 16 = 1").withColumn("chunk_id", F.concat("chunk_id", F.lit("n"))), gone=c.where("file_row_id % 16 = 2").select("file_row_id").distinct())
    labels = c.where("file_row_id % 16 in (2, 3)").select("file_row_id").distinct().select("file_row_id", F.lit(None).cast("string").alias("department"), F.lit("draft").alias("doc_status"))
    table.apply(changes=labels, columns=("department", "doc_status"))
    table.prune(c.where("file_row_id % 9 <> 4").select("file_row_id").distinct())
    table.vacuum()
    return table


def snk1_stored(spark, d):
    """The stored table's rows after all changes."""
    return _store(spark, d).rows().select("chunk_id", "file_row_id", "department", "doc_status", "n")


QUERIES = {k: f for k, f in globals().items() if callable(f) and k[0].islower() and k[:2] in ("sc", "tk", "wn", "jn", "fl", "ag", "sn", "ud") and "_" in k and not k.startswith("shared")}

W = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
CODES = r"list_transform(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: w <> ''), lambda w: {{'c': list_sum(list_transform(string_split(w, ''), lambda x: unicode(x)))::BIGINT, 'l': length(w)}})"
NUM = r"regexp_extract({0}, '^\s*(?:(\d+(?:\.\d+)+)\.?|(\d+)[.)])(?:\s+\S)', {1})"
NO = r"regexp_matches({0}, '\d{{4,}}|(?:^|\.)0\d')"


def _num(t: str) -> str:
    n = f"concat({NUM.format(t, 1)}, {NUM.format(t, 2)})"
    return f"CASE WHEN {n} <> '' AND NOT {NO.format(n)} THEN {n} END"


def _uuid(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return f"concat_ws('-', substr({h},1,8), substr({h},9,4), concat('5', substr({h},14,3)), concat(translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab'), substr({h},18,3)), substr({h},21,12))"


VEC = """
{n}w AS (SELECT {k}, unnest({codes}) AS w FROM {t}),
{n}c AS (SELECT {k}, (w.c % 8)::INT AS b, count(*)::DOUBLE AS x FROM {n}w GROUP BY ALL),
{n}n AS (SELECT {k}, sqrt(sum(x * x)) AS norm FROM {n}c GROUP BY {k}),
{n}d AS (SELECT c.{k}, c.b, c.x / n.norm AS x FROM {n}c c JOIN {n}n n USING ({k})),
{n}s AS (SELECT {k}, (w.c % 10007)::INT AS token, max(1.0::DOUBLE + w.l / 10.0::DOUBLE) AS weight FROM {n}w GROUP BY ALL)"""
ACTIVE = "act AS (SELECT * FROM chunks WHERE doc_status = 'active')"
HYBRID = ctes("chunks", "queries") + ",\n" + ACTIVE + "," + VEC.format(n="c", k="chunk_id", t="act", codes=CODES.format("body")) + "," + VEC.format(n="q", k="query_id", t="queries", codes=CODES.format("text")) + """,
dall AS (SELECT q.query_id, c.chunk_id, round(sum(q.x * c.x), 6) AS score FROM qd q JOIN cd c USING (b) GROUP BY ALL),
dzero AS (SELECT query_id, chunk_id, score FROM dall UNION ALL SELECT q.query_id, a.chunk_id, 0.0 FROM (SELECT DISTINCT query_id FROM qd) q CROSS JOIN act a ANTI JOIN dall x ON x.query_id = q.query_id AND x.chunk_id = a.chunk_id),
dtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dzero) WHERE rank <= 40),
sall AS (SELECT q.query_id, c.chunk_id, round(sum(q.weight * c.weight), 6) AS score FROM qs q JOIN cs c USING (token) GROUP BY ALL),
stop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sall) WHERE rank <= 40),
fus AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM (SELECT query_id, chunk_id, rank FROM dtop UNION ALL SELECT query_id, chunk_id, rank FROM stop) GROUP BY ALL),
ftop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id)::INT AS fusion_rank FROM fus) WHERE fusion_rank <= 20)
"""
ADMITTED = """SELECT query_id, chunk_id FROM queries JOIN chunks ON list_contains(CASE WHEN query_id % 4 = 1 THEN ['cancelled', 'active'] ELSE ['active'] END, doc_status) AND (query_id % 3 <> 0 OR doc_kind IN ('src1', 'src2'))
  AND (query_id % 5 <> 2 OR department IN ('en', 'de')) AND (query_id % 2 <> 0 OR doc_date_ts >= epoch(DATE '2024-03-01')) AND (query_id % 7 <> 0 OR doc_date_ts < epoch(DATE '2024-07-01'))"""
OVER = "CASE WHEN len(list_distinct(" + W.format("lower({q})") + ")) > 0 THEN len(list_intersect(list_distinct(" + W.format("lower({q})") + "), list_distinct(" + W.format("lower({t})") + ")))::DOUBLE / len(list_distinct(" + W.format("lower({q})") + ")) ELSE 0.0 END"
ROLES = """,
j AS (SELECT f.*, c.type_name, CASE WHEN extension NOT IN ('pdf','docx','xlsx','pptx','png','jpg','jpeg','tif','tiff','bmp','gif') THEN 'format' WHEN starts_with(lower(name), 'для печати') THEN 'print copy' WHEN category IN ('Подписи ЭП','Получено из Диадока') THEN 'category' END AS skip FROM files f LEFT JOIN cards c USING (card_id)),
k AS (SELECT *, CASE WHEN skip IS NULL THEN CASE WHEN extension='docx' AND category='Документ' THEN 0 WHEN extension='docx' AND category='Файлы для отправки по ЭДО' THEN 1 WHEN extension='pdf' AND category IN ('Подписанные документы','Документ') THEN 2 WHEN extension='docx' THEN 3 WHEN extension='pdf' THEN 4 END END AS cand FROM j),
m AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY cand NULLS LAST, pos, row_id) = 1 AND cand IS NOT NULL AS is_main FROM k),
e AS (SELECT *, max(CASE WHEN is_main THEN extension END) OVER (PARTITION BY card_id) AS me FROM m),
roles AS (SELECT card_id, row_id, pos, sha256, name, CASE WHEN skip IS NOT NULL THEN skip WHEN is_main THEN NULL
  WHEN coalesce(category IN ('Документ','Подписанные документы','Файлы для отправки по ЭДО'), false) AND extension='pdf' AND coalesce(me='docx', false) THEN 'pdf copy'
  WHEN coalesce(category='Дополнительные сведения', false) AND NOT coalesce(type_name='Order', false) THEN 'supplement of another type' END AS skip_reason,
  CASE WHEN is_main THEN 'main' WHEN coalesce(category='Дополнительные сведения', false) THEN 'supplement' ELSE 'appendix' END AS r FROM e)
"""
OWNERS = ctes("files", "cards") + ROLES + ", p AS (SELECT x.card_id, x.row_id, x.sha256, count(*) OVER (PARTITION BY sha256) AS m, row_number() OVER (PARTITION BY sha256 ORDER BY list_position(['main','appendix','supplement'], r), c.pos, x.pos, row_id) AS n FROM roles x JOIN cards c USING (card_id) WHERE skip_reason IS NULL) "
ACT = ctes("plan", "registry") + """,
m AS (SELECT coalesce(p.card_id, r.card_id) AS card_id, coalesce(p.row_id, r.row_id) AS row_id, p.row_id IS NOT NULL AS planned, p.role, p.route, p.fingerprint AS fp, p.sha256 AS sha, r.fingerprint AS ofp, r.sha256 AS osha, r.status FROM plan p FULL JOIN registry r ON p.card_id = r.card_id AND p.row_id = r.row_id),
acts AS (SELECT card_id, row_id, route, coalesce(status = 'indexed', false) AS ind, CASE WHEN NOT planned THEN 'vanished' WHEN role IS NULL THEN 'skipped' WHEN coalesce(status='indexed', false) AND coalesce(sha = osha, false) THEN CASE WHEN fp IS NOT DISTINCT FROM ofp THEN 'unchanged' ELSE 'metadata_only' END ELSE 'parse' END AS action FROM m)
"""
OUT = ctes("files") + """,
o AS (SELECT CASE WHEN supp % 6 = 0 THEN 'skipped' WHEN supp % 7 = 0 THEN 'failed' WHEN supp % 2 = 0 THEN 'unchanged' ELSE 'indexed' END AS status, 'reason ' || (supp % 8) AS reason, card_id * 10 + pos AS pos FROM files)
"""
NL = "chr(10)"
DENSE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings e CROSS JOIN embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 40"
ORACLES = {
    "sc1_clause_numbers": ctes("lines") + ", t AS (SELECT doc_id, n, concat(CASE n % 3 WHEN 0 THEN concat(n % 9 + 1, '.', n % 4, '. ') WHEN 1 THEN concat(n % 2100, ') ') ELSE '04.09.2026 ' END, line) AS t FROM lines) SELECT doc_id, n, " + _num("t") + " AS clause, CASE WHEN regexp_extract(t, '^\\s*(\\d+(?:\\.\\d+)*)[.)]?(?:\\s+\\S)', 1) <> '' AND NOT regexp_matches(regexp_extract(t, '^\\s*(\\d+(?:\\.\\d+)*)[.)]?(?:\\s+\\S)', 1), '\\d{4,}|(?:^|\\.)0\\d') THEN regexp_extract(t, '^\\s*(\\d+(?:\\.\\d+)*)[.)]?(?:\\s+\\S)', 1) END AS header, " + _num("concat(regexp_replace(t, ' .*', '', 's'), ' x')") + " AS bare FROM t",
    "sc22_word_counts": ctes("lines") + " SELECT doc_id, n, len(" + W.format("line") + ") AS tokens FROM lines",
    "sc6_ids": ctes("chunks") + f" SELECT chunk_id, {_uuid("concat(md5(parent_id), ':', n)")} AS id, {_uuid("concat('x:parent:', n)")} AS pid FROM chunks",
    "sc7_normalized": ctes("chunks") + ", t AS (SELECT chunk_id, concat(' «', upper(substr(body, 1, 30)), '»;') AS a, concat('Раздел ', n % 9, '. ', body) AS h FROM chunks), e AS (SELECT chunk_id, translate(replace(lower(a), 'ß', 'ss'), 'ё', 'е') AS a, translate(replace(lower(regexp_replace(h, '^Раздел \\d+\\.\\s*', '')), 'ß', 'ss'), 'ё', 'е') AS h FROM t) SELECT chunk_id, trim(regexp_replace(regexp_replace(a, '^[\\s«»\"''*_#.,;:()]+|[\\s«»\"''*_#.,;:()]+$', '', 'g'), '\\s+', ' ', 'g')) AS term_key, trim(regexp_replace(regexp_replace(h, '^[\\s«»\"''*_#.,;:()]+|[\\s«»\"''*_#.,;:()]+$', '', 'g'), '\\s+', ' ', 'g')) AS heading_key FROM e",
    "flt7_routes": ctes("pages_text") + ", w AS (SELECT file_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: regexp_matches(x, '\\p{L}')) AS ws FROM pages_text), c AS (SELECT file_id, length(regexp_replace(t, '\\s+', '', 'g')) >= 50 AND len(list_filter(ws, lambda x: regexp_matches(x, '\\p{Cyrillic}') AND regexp_matches(x, '\\p{Latin}'))) <= len(ws) * 0.1 AS good FROM w) SELECT file_id, count(*) AS n_pages, count(*) FILTER (good) AS text_pages, CASE WHEN count(*) FILTER (good) >= count(*) * 0.5 THEN 'native' ELSE 'model' END AS route FROM c GROUP BY file_id",
    "sc19_cuts": ctes("chunks") + ", w AS (SELECT chunk_id, body, " + W.format("body") + " AS w FROM chunks) SELECT chunk_id, CASE WHEN len(w) > 5 THEN array_to_string(w[1:5], ' ') || '…' ELSE array_to_string(w, ' ') END AS short, CASE WHEN length(body) > 40 THEN regexp_replace(substr(body, 1, 39), '\\s+$', '') || '…' ELSE body END AS cut FROM w",
    "sc23_dense": ctes("chunks") + "," + VEC.format(n="c", k="chunk_id", t="chunks", codes=CODES.format("body")) + " SELECT c.chunk_id, " + ", ".join(f"round(coalesce(max(CASE WHEN b = {i} THEN x END), 0), 6) AS d{i}" for i in range(8)) + " FROM chunks c LEFT JOIN cd USING (chunk_id) GROUP BY c.chunk_id",
    "ag15_sparse": ctes("chunks") + "," + VEC.format(n="c", k="chunk_id", t="chunks", codes=CODES.format("body")) + " SELECT chunk_id, token, round(weight, 6) AS weight FROM cs",
    "sc24_overlap": HYBRID + "SELECT f.chunk_id, f.query_id, round(" + OVER.format(q="q.text", t="a.body") + ", 6) AS score FROM ftop f JOIN act a USING (chunk_id) JOIN queries q USING (query_id)",
    "ud2_reranked": HYBRID + "SELECT f.query_id, f.chunk_id, round(" + OVER.replace("lower({q})", "{q}").replace("lower({t})", "{t}").format(q="q.text", t="a.body") + ", 6) AS score FROM ftop f JOIN act a USING (chunk_id) JOIN queries q USING (query_id)",
    "wn13_evidence": HYBRID + """, bl AS (SELECT query_id AS question_id, fusion_rank AS n, fusion_rank % 3 = 0 AS doc, body, length(body) AS size, sum(length(body)) OVER (PARTITION BY query_id, fusion_rank % 3 = 0 ORDER BY fusion_rank) - length(body) AS ahead FROM ftop JOIN act USING (chunk_id)),
dt AS (SELECT *, CASE WHEN doc AND 450 - ahead > 0 THEN CASE WHEN size <= 450 - ahead THEN body WHEN 450 - ahead >= 60 THEN regexp_replace(substr(body, 1, (449 - ahead)::INT), '\\s+$', '') || '…' END END AS t FROM bl),
us AS (SELECT *, 900 - coalesce(sum(length(t)) OVER (PARTITION BY question_id), 0) - ahead AS room FROM dt),
ot AS (SELECT question_id, n, CASE WHEN doc THEN t WHEN room > 0 THEN CASE WHEN size <= room THEN body WHEN room >= 60 THEN regexp_replace(substr(body, 1, (room - 1)::INT), '\\s+$', '') || '…' END END AS text FROM us)
SELECT * FROM ot WHERE text IS NOT NULL""",
    "flt4_search": HYBRID.replace(ACTIVE, "act AS (SELECT * FROM chunks)").replace("dtop AS (", f"adm AS ({ADMITTED}),\ndtop AS (").replace("FROM dzero)", "FROM dzero SEMI JOIN adm USING (query_id, chunk_id))").replace("FROM sall)", "FROM sall SEMI JOIN adm USING (query_id, chunk_id))")
    + "SELECT 'dense' AS list, query_id, chunk_id, score, rank::INT AS rank FROM dtop UNION ALL SELECT 'sparse', query_id, chunk_id, score, rank::INT FROM stop",
    "flt4_by_query": ctes("chunks", "queries") + f" SELECT query_id, count(*) AS n, min(chunk_id) AS first, max(chunk_id) AS last FROM ({ADMITTED}) GROUP BY query_id",
    "snk6_report": OUT.replace("AS pos FROM files", "AS pos, card_id, row_id, concat('reason ', supp % 8, ': ', name) AS full_reason FROM files") + "SELECT 'run' AS what, count(*) AS files_total, count(*) FILTER (status='indexed') AS indexed, round(count(*) FILTER (status IN ('indexed','unchanged'))::DOUBLE / count(*) FILTER (status IN ('indexed','unchanged','failed')), 6) AS success_share, NULL::BIGINT AS card_id, NULL AS row_id, NULL AS status, NULL AS reason FROM o UNION ALL SELECT 'file', NULL, NULL, NULL, card_id, row_id, status, full_reason FROM o",
    "snk1_parents": ctes("chunks") + " SELECT DISTINCT CASE WHEN doc_id % 8 = 1 THEN 'new-' || doc_id ELSE parent_id END AS parent_id, doc_id AS file_row_id FROM chunks WHERE doc_id % 4 <> 1 OR doc_id % 8 = 1",
    "sc25_cosine": "SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings e JOIN embeddings q ON e.label = q.label AND q.vec_id % 50 = 0",
    "tk1_dense_top": DENSE,
    "tk1_index_exact": DENSE,
    "tk2_index_top": HYBRID + "SELECT query_id, chunk_id, score, rank::INT AS rank FROM stop",
    "tk2_sparse_top": HYBRID + "SELECT query_id, chunk_id, score, rank::INT AS rank FROM stop",
    "wn7_fusion": HYBRID + "SELECT * FROM ftop",
    "tk3_hybrid_search": HYBRID + ", sc AS (SELECT f.query_id, f.chunk_id, round(" + OVER.format(q="q.text", t="a.body") + ", 4) AS score, fusion_rank, a.parent_id FROM ftop f JOIN act a USING (chunk_id) JOIN queries q USING (query_id)) SELECT query_id, chunk_id, score, fusion_rank, rank, parent_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fusion_rank)::INT AS rank FROM sc) WHERE rank <= 5",
    "jn12_context": ctes("chunks") + f", p AS (SELECT parent_id, string_agg(body, {NL} ORDER BY n) AS body FROM chunks GROUP BY parent_id HAVING parent_id NOT LIKE '%3') SELECT chunk_id, c.parent_id, md5(p.body) AS context_md5 FROM chunks c LEFT JOIN p USING (parent_id)",
    "flt4_filter": ctes("chunks") + " SELECT chunk_id, doc_kind, department, doc_date_ts FROM chunks WHERE doc_status = 'active' AND doc_kind IN ('src1','src2','src3') AND department IN ('en','fr') AND doc_date_ts >= epoch(DATE '2024-02-01') AND doc_date_ts < epoch(DATE '2024-11-01')",
    "ag13_known_values": ctes("chunks") + " SELECT DISTINCT doc_kind AS value FROM chunks WHERE doc_kind IS NOT NULL ORDER BY 1 LIMIT 500",
    "flt5_known_values": ctes("chunks") + ", a AS (SELECT DISTINCT upper(doc_kind) || ' ' AS request FROM chunks UNION SELECT unnest(['src', 'nothing', ' ', 'rc1'])), r AS (SELECT request, lower(trim(request)) AS r FROM a WHERE trim(request) <> ''), k AS (SELECT DISTINCT doc_kind AS value, lower(doc_kind) AS v FROM chunks), m AS (SELECT request, value, coalesce(v = r, false) AS exact FROM r LEFT JOIN k ON contains(v, r) OR contains(r, v)), b AS (SELECT *, bool_or(exact) OVER (PARTITION BY request) AS anyx FROM m) SELECT request, coalesce(value, request) AS value, value IS NOT NULL AS known FROM b WHERE exact OR NOT anyx",
    "ag16_evidence": ctes("agent_events") + " SELECT question_id, max(CASE WHEN seq % 3 <> 0 THEN (seq % 100) / 250.0::DOUBLE END) AS best, coalesce(max(CASE WHEN seq % 3 <> 0 THEN (seq % 100) / 250.0::DOUBLE END) < 0.3, true) AS weak FROM agent_events GROUP BY question_id",
    "flt2_skip_reasons": ctes("files") + " SELECT card_id, row_id, CASE WHEN is_virtual THEN 'virtual' WHEN extension NOT IN ('pdf','docx','xlsx','pptx') THEN 'format' END AS skip_reason, CASE WHEN NOT is_virtual AND extension NOT IN ('pdf','docx','xlsx','pptx') THEN extension END AS skip_detail FROM files",
    "wn1_file_roles": ctes("files", "cards") + ROLES + "SELECT card_id, row_id, CASE WHEN skip_reason IS NULL THEN r END AS role, skip_reason FROM roles",
    "wn2_content_owners": OWNERS + "SELECT x.card_id, x.row_id, CASE WHEN x.skip_reason IS NULL AND p.n = 1 THEN r END AS role, CASE WHEN p.n > 1 THEN 'copy' ELSE skip_reason END AS skip_reason, CASE WHEN p.n = 1 THEN p.m - 1 ELSE 0 END AS copies FROM roles x LEFT JOIN p USING (card_id, row_id)",
    "wn2_also_in": OWNERS + "SELECT o.card_id, o.row_id, p.row_id AS copy_row_id, p.card_id AS also_in FROM p JOIN p o ON o.sha256 = p.sha256 AND o.n = 1 AND p.n > 1",
    "wn3_duplicates": ctes("files", "cards") + " SELECT card_id, row_id, CASE WHEN row_number() OVER w > 1 THEN first_value(card_id || '/' || row_id) OVER w END AS duplicate_of FROM (SELECT f.card_id, f.row_id, f.sha256, c.pos AS cp, f.pos FROM files f JOIN cards c USING (card_id)) WINDOW w AS (PARTITION BY sha256 ORDER BY cp, pos, row_id)",
    "flt8_inspection": ctes("pages_text") + " SELECT file_id, count(*) AS n_pages, coalesce(bool_or(page_no < 30 AND regexp_matches(text, '\\S')), false) AS has_text, bool_or(length(text) <= 120 AND regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}_])la(?:$|[^\\p{L}\\p{N}_])|^the ')) AS has_terms FROM pages_text GROUP BY file_id",
    "jn1_admitted": ctes("manifest_files", "known_cards", "disk") + " SELECT CASE WHEN c.card_id IS NULL THEN 'card_missing' WHEN d.sha256 IS NULL THEN 'file_missing' WHEN d.sha256 <> m.sha256 THEN 'hash_changed' ELSE 'ok' END AS kind, m.card_id, m.row_id, m.path FROM manifest_files m LEFT JOIN known_cards c USING (card_id) LEFT JOIN disk d USING (path) WHERE m.downloaded",
    "jn2_orphans": ctes("manifest_files", "known_cards", "disk") + " SELECT d.path, CASE WHEN c.card_id IS NULL THEN 'no_card' ELSE 'not_in_manifest' END AS kind FROM disk d ANTI JOIN manifest_files m USING (path) LEFT JOIN known_cards c ON split_part(d.path, '/', 1) = c.card_id::VARCHAR",
    "jn7_actions": ACT + "SELECT card_id, row_id, action, action = 'vanished' OR (action = 'skipped' AND ind) AS drop_rows FROM acts",
    "jn8_vanished": ACT + "SELECT card_id, row_id FROM acts WHERE action = 'vanished'",
    "ag5_work_plan": ACT + "SELECT count(*) AS files_total, count(*) FILTER (action = 'parse') AS to_parse, count(*) FILTER (action = 'parse' AND route = 'model') AS model_files, count(*) FILTER (action IN ('unchanged','metadata_only')) AS unchanged, count(*) FILTER (action = 'skipped') AS skipped FROM acts WHERE action <> 'vanished'",
    "ag6_run_report": OUT + "SELECT count(*) AS files_total, count(*) FILTER (status='indexed') AS indexed, count(*) FILTER (status='unchanged') AS unchanged, count(*) FILTER (status='skipped') AS skipped, count(*) FILTER (status='failed') AS failed, round(count(*) FILTER (status IN ('indexed','unchanged'))::DOUBLE / count(*) FILTER (status IN ('indexed','unchanged','failed')), 6) AS success_share FROM o",
    "ag6_error_reasons": OUT + "SELECT reason, count(*) AS n FROM o WHERE status = 'failed' GROUP BY reason ORDER BY n DESC, min(pos) LIMIT 5",
    "snk1_upsert": ctes("chunks") + " SELECT CASE WHEN doc_id % 4 = 1 THEN chunk_id || 'n' ELSE chunk_id END AS chunk_id, doc_id AS file_row_id, CASE WHEN doc_id % 4 = 1 THEN 'new' ELSE doc_status END AS v FROM chunks",
    "snk1_stored": ctes("chunks") + " SELECT CASE WHEN doc_id % 16 = 1 THEN chunk_id || 'n' ELSE chunk_id END AS chunk_id, doc_id AS file_row_id, CASE WHEN doc_id % 16 <> 3 THEN department END AS department, CASE WHEN doc_id % 16 = 3 THEN 'draft' ELSE doc_status END AS doc_status, n FROM chunks WHERE doc_id % 16 <> 2 AND doc_id % 9 <> 4",
    "snk2_payload": ctes("chunks") + " SELECT chunk_id, doc_id AS file_row_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE department END AS department, CASE WHEN doc_id % 3 = 0 THEN 'draft' ELSE doc_status END AS doc_status, n FROM chunks",
    "snk3_pruned": ctes("chunks") + " SELECT chunk_id, doc_id FROM chunks WHERE doc_id % 5 <> 2",
    "snk3_removed": ctes("chunks") + " SELECT count(*) AS removed FROM chunks WHERE doc_id % 5 = 2",
    "sc12_candidate_terms": ctes("chunks") + ", t AS (SELECT chunk_id, 'ABC, ПВТР и ' || upper(doc_kind) || ' ' || body || ' ТН2 ПВТР' AS t FROM chunks), x AS (SELECT chunk_id, unnest(regexp_extract_all(t, '[\\p{L}\\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(t, '[\\p{L}\\p{N}]+'), 1) AS i FROM t) SELECT chunk_id, string_agg(w, '|' ORDER BY i) AS terms FROM (SELECT chunk_id, w, min(i) AS i FROM x WHERE regexp_full_match(w, '\\p{Lu}{2,}[\\p{Lu}\\p{N}]*') GROUP BY ALL) GROUP BY chunk_id",
}

"""What only larger or odd tables show, on made ones."""

import glob
import os
import time
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import corpusflow.plans as plans
from corpusflow.functions import embed
from corpusflow.operators import chunking, files, glossary, manifest, postings, privacy, scoring, termjoin
from corpusflow.plans import texts
from corpusflow.plans.standins import nested_cards, standin
from corpusflow.runtime import cut
from corpusflow.sources.store import BucketStore
from corpusflow.streaming import conversations

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables on this machine")


def made(folder, **tables):
    """A folder of tables, each from a query on the given ones."""
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def same_rows(spark, folder, name):
    """Rows of a query, after a comparison with its SQL in one thread."""
    frame, con = plans.QUERIES[name](spark, folder), duckdb.connect()
    con.execute("SET TimeZone='UTC'; SET threads=1")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    found = con.execute(plans.ORACLES[name])
    names = [d[0] for d in found.description]
    got = frame.select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, found.fetchall()))
    return got


def test_edges_of_large_keys(spark, tmp_path):
    """An incoming link's place is ten thousand times its source's key, beyond an int, where its SQL's own cast fails too."""
    folder = made(tmp_path, orders="SELECT * REPLACE (o_orderkey + 300000 AS o_orderkey) FROM orders", lineitem="SELECT * REPLACE (l_orderkey + 300000 AS l_orderkey) FROM lineitem")
    cards, best = {r["card_id"] for r in standin(spark, folder, "cards").where("card_id % 3 <> 0").collect()}, {}
    for r in standin(spark, folder, "links").collect():
        a, b = r["from_id"], r["to_id"]
        into = ((True, b, 1, a * 10000 + r["pos"]), (None, None))
        for way in ([((r["ref_type"] is None, a, 0, r["pos"]), (r["ref_type"], r["reverse_type"]))] if a in cards else []) + ([into] if b in cards else []):
            best[a, b] = min(best.get((a, b), way), way, key=lambda w: w[0])
    want = {(a, b, *w[1], a not in cards or b not in cards) for (a, b), w in best.items()}
    assert {tuple(r) for r in plans.QUERIES["jn4_edges"](spark, folder).collect()} == want


def test_pages_of_equal_cursors(spark, tmp_path):
    """Of a user's conversations whose last seconds are alike modulo 1000 the smallest is the cursor."""
    talks = "SELECT (5 * t.i)::BIGINT AS conv_id, n.i::BIGINT AS turn, 'user' AS role, 'x' AS text FROM range(400) t(i), range(2) n(i) ORDER BY ALL"
    assert same_rows(spark, made(tmp_path, conversations=talks), "wn12_pages")


def shuffled(spark, work, what="shuffleWriteRecords"):
    """Records (or bytes) that ``work`` writes to shuffles."""
    store, call = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    stages = lambda: {s.stageId(): getattr(s, what)() for s in call(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    before = max(stages(), default=-1)
    work()
    return sum(n for stage, n in stages().items() if stage > before)


def test_index_moves_chunks_not_postings(spark, tmp_path):
    """Chunks are shuffled twice, and neither postings nor pairs of question and range are."""
    chunks = spark.range(4000).selectExpr("cast(id as string) chunk_id", "transform(sequence(1, 20), i -> struct(cast((id * i) % 97 as int) token, 1.5D + i % 3 weight)) sparse")
    asked = spark.range(40).selectExpr("id query_id", "transform(sequence(1, 20), i -> struct(cast((id + i * i) % 97 as int) token, 1.0D weight)) sparse")

    def work():
        postings.build(chunks, f"{tmp_path}/index")
        postings.search(f"{tmp_path}/index", asked, 5).count()

    assert shuffled(spark, work) < 30_000  # 8,000 chunks, 40 questions and the best of each task; 349,000 before


def test_owners_move_a_file_twice(spark):
    """A file is shuffled for its card and for its content, and not to be looked up again."""
    rows = spark.range(6000).selectExpr("id div 6 card_id", "cast(id as string) row_id", "cast(id % 6 as int) pos", "'docx' extension", "cast(null as string) category", "'f' name", "concat('h', id % 500) sha256")
    cards = rows.select("card_id", F.col("card_id").alias("pos"), F.lit("Order").alias("type_name")).distinct()
    rows, cards = cut(rows), cut(cards)
    got = []
    moved = shuffled(spark, lambda: got.extend(files.content_owners(files.file_roles(rows, cards, whole=True), rows, cards)[0].collect()))
    assert len(got) == 6000 and sum(r["copies"] for r in got) == sum(r["skip_reason"] == "copy" for r in got) == 5500
    assert moved < 16_000  # 12,000 and 2,000 candidates for owners


@pytest.mark.parametrize("name", ["src1_cards", "src2_manifest"])
def test_json_is_written_compressed(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(texts, "_folder", lambda spark, what: f"{tmp_path}/{what}")
    assert plans.QUERIES[name](spark, SF).count()
    parts = [f for f in glob.glob(f"{tmp_path}/*/**/part-*", recursive=True) if ".txt" not in f]
    assert parts and all(f.endswith(".json.gz") for f in parts)


def test_files_are_numbered_before_their_texts_are_made(spark):
    """A line is shuffled as the numbers that it is, not with the hash and the names made of it."""
    rows = standin(spark, SF, "files").select("card_id", "row_id", "pos", "sha256", "name")
    moved = shuffled(spark, lambda: rows.write.format("noop").mode("overwrite").save(), "shuffleWriteBytes")
    assert moved < 40 * rows.count()  # 77 before


def test_chats_are_merged_without_a_call_for_each_message(spark, tmp_path):
    """Messages are merged by Spark and not by Python key by key, and what stands doesn't depend on the batches that writes come in."""
    made = lambda rows, *more: rows.selectExpr("cast(id as string) id", "'c' conversation_id", "cast(null as string) trace_id", "id created_s", *more)
    m = made(spark.range(300), "cast(id + 1 as string) parent_id", "'first' body", "1L seq", "false gone")
    m = m.unionByName(made(spark.range(0, 300, 3), "cast(null as string) parent_id", "'last' body", "5L seq", "id % 2 = 0 gone"))
    e = spark.range(300).selectExpr("concat('e', id) id", "cast(id as string) message_id", "'c' conversation_id", "'x' body", "4L seq", "false gone")
    f = spark.range(300).selectExpr("cast(id as string) message_id", "'c' conversation_id", "1 value", "'note' body", "6L seq", "false gone")
    events, found = conversations.writes(m, e, f), []
    for rounds in ([F.lit(True)], [F.col("seq") > 4, F.col("seq") <= 4]):
        place = f"{tmp_path}/{len(rounds)}"
        held = BucketStore(spark, f"{place}/chats", StructType.fromDDL(conversations.ROWS), "row_id", 4)
        for when in rounds:
            events.where(when).write.mode("append").parquet(f"{place}/in")
            conversations.chat_stream(spark.readStream.schema(events.schema).parquet(f"{place}/in"), held, f"{place}/state").awaitTermination()
        assert not os.path.isdir(f"{place}/state/state")  # of each message, before
        found.append(sorted(map(str, held.rows().collect())))
    assert found[0] == found[1] and len(found[0]) == 250 * 3  # of the fifty that were deleted after their elements only the ratings came later, without a message


def test_words_are_coded_once_for_all_places_of_a_vector(spark):
    """No lambda of a vector's places goes over the words again, and counts are those of the codes."""
    frame = plans.QUERIES["sc23_dense"](spark, SF)
    assert "filter(" not in frame._jdf.queryExecution().optimizedPlan().toString()
    coded = spark.createDataFrame([([(5, 1), (13, 2), (8, 1), (0, 1)],), ([],)], "coded array<struct<code:int,length:int>>")
    got = [r[0] for r in coded.select(embed.dense_vector(F.col("coded"), 8)).collect()]
    assert got[1] == [0.0] * 8 and got[0] == [x / 8**0.5 for x in (2.0, 0, 0, 0, 0, 2.0, 0, 0)]


def test_names_are_found_once(spark):
    """Names of all rows are found once, however often they are used, and each row gets those of its scope."""
    asked = spark.sparkContext.accumulator(0)

    def name(n):
        asked.add(1)
        return f"Petrov{'x' * (n % 3)} A.A."

    rows = spark.range(60).selectExpr("id", "id % 2 scope", "concat('ask Petrov', repeat('x', cast(id % 3 as int)), ' A.A.') body")
    names = rows.select("scope", F.udf(name).asNondeterministic()("id").alias("name")).withColumn("surname", F.lower(privacy.surname_of(F.col("name"))))
    got = {r["id"]: r["body"] for r in privacy.replace_names(rows, "scope", ["body"], names).collect()}
    assert got == {n: f"ask Person {n % 3 + 1}" for n in range(60)} and asked.value == 60


def test_sets_of_letters_are_made_by_many_tasks(spark):
    """Few lists of tokens become many sets, by more than one task, and each set once."""
    keys = spark.range(400).select(F.concat(F.lit("en "), F.substring(F.md5(F.col("id").cast("string")), 1, 12)).alias("key"))
    sets = cut(termjoin.letter_keys(termjoin.token_lists(keys), 0.75))
    assert sets.select(F.spark_partition_id()).distinct().count() > 1
    assert sets.count() == sets.select("key", "meet").distinct().count()


def test_pairs_that_share_too_few_letters_are_dropped_where_they_meet(spark):
    """Of keys that meet none that reaches the ratio is lost by their marks, and most others are dropped."""
    keys = spark.range(300).select(F.concat(F.lit("en "), F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 8), "0123456789", "ghijklmnop")).alias("key"))
    sets = cut(termjoin.letter_keys(termjoin.token_lists(keys), 0.75))
    met = {tuple(r) for r in sets.select("key", "meet").join(sets.select(F.col("key").alias("other"), "meet"), "meet").select("key", "other").distinct().collect()}
    left = {tuple(r) for r in termjoin.close_letters(sets, keys, keys, 0.75 - 1e-9).distinct().collect()}
    shared = lambda a, b: sum(min(a.count(c), b.count(c)) for c in set(a))
    assert {(a, b) for a, b in met if 2 * shared(a, b) >= 0.75 * (len(a) + len(b))} <= left <= met
    assert len(left) < len(met) / 2


def test_common_letters_are_the_longest_common_subsequence():
    texts = ["", "a", "abcab", "b\0ca", "\0", "ab" * 32, "ba" * 31 + "c", "жab ж", "x" * 65, "ab" * 40]

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    pairs = [(a, b) for a in texts for b in texts]
    got = termjoin.common_letters(*(pd.Series(side) for side in zip(*pairs)))
    assert [int(n) for n in got] == [longest(a, b) if max(len(a), len(b)) <= 64 else min(len(a), len(b)) for a, b in pairs]


def test_records_of_one_key_are_cut_before_they_meet_terms(spark):
    """Of a key with a thousand records its first ones are moved, for each of the terms that find it."""
    held = spark.range(1000).select(F.format_string("r%04d", F.col("id")).alias("record_id"), F.lit("EN Word").alias("term"), F.lit("en word").alias("term_key"), F.concat(F.lit("meaning "), "id").alias("definition"), F.lit("active").alias("doc_status"), F.lit("doc").alias("doc_label"))
    assert sorted(r["record_id"] for r in glossary.first_records(held).collect()) == [f"r{n:04d}" for n in range(5)]
    terms = spark.createDataFrame([("en word",), ("en words",)], "term string")
    assert sorted((r["term"], r["record_id"]) for r in glossary.lookup(terms, held).collect()) == [(t, f"r{n:04d}") for t in ("en word", "en words") for n in range(5)]


def test_long_sentences_are_cut_in_one_pass(spark):
    """A sentence of sixty thousand words is split once, not for each of its parts."""
    rows = spark.range(1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("text"), F.lit(60).alias("limit"))
    rows, started = cut(rows), time.perf_counter()
    got = chunking.with_windows(rows, "text", "limit", 0).select("windows").first()[0]
    assert time.perf_counter() - started < 15
    assert len(got) == 1000 and " ".join(got) == rows.first()["text"] and got[0].count(" ") == 59


def test_texts_are_moved_twice_to_be_chunked_and_not_stored(spark, monkeypatch):
    """Items without tables are shuffled once by file and once as chunks, parents not at all, and nothing is written to the checkpoint folder."""
    monkeypatch.delattr(chunking, "cut")
    word = F.concat_ws(" ", *[F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{n}"))), 1, 12) for n in range(40)])
    items = spark.range(4000).select(
        F.concat(F.lit("f"), (F.col("id") % 40).cast("string")).alias("file_sha256"), F.floor(F.col("id") / 40).cast("int").alias("seq"), F.lit(1).alias("depth"), F.when(F.col("id") % 9 == 0, "section_header").otherwise("text").alias("label"), word.alias("text"),
        F.lit(1).alias("header_level"), F.lit(None).cast("string").alias("marker"), F.lit(False).alias("enumerated"), F.lit(1).alias("page_no"), F.lit("#").alias("self_ref"),
    )
    got = []
    moved = shuffled(spark, lambda: got.extend(chunking.chunk_items(items, texts.SHORT)[1].select("file_sha256", "ordinal", "tokens", F.size("item_refs").alias("n")).collect()), "shuffleWriteBytes")
    assert len({r["file_sha256"] for r in got}) == 40 and sum(r["n"] for r in got) > 3000
    assert moved < 3 * 4000 * 40 * 13  # of letters and blanks; 7.8 times as much before


def test_refs_of_a_long_text_are_carried_once(spark):
    """However many chunks a text without structure becomes, its items' refs are moved with the first one, and all have them."""
    items = spark.range(3000).select(
        F.lit("f").alias("file_sha256"), F.col("id").cast("int").alias("seq"), F.lit(1).alias("depth"), F.lit("text").alias("label"), F.array_join(F.array_repeat(F.lit("word"), 12), " ").alias("text"),
        F.lit(1).alias("header_level"), F.lit(None).cast("string").alias("marker"), F.lit(False).alias("enumerated"), F.lit(1).alias("page_no"), F.md5(F.col("id").cast("string")).alias("self_ref"),
    )
    got = []
    moved = shuffled(spark, lambda: got.extend(chunking.chunk_items(items, texts.SHORT)[0].select("ordinal", F.size("item_refs").alias("n")).collect()), "shuffleWriteBytes")
    assert len(got) >= 600 and {r["n"] for r in got} == {3000}
    assert moved < 2_000_000  # of 3,000 refs of 32 letters, and not for each of 600 chunks


def test_packs_are_windows_without_overlap(spark):
    """Parents are packed by Spark as by the helper on arrays, with sizes of nothing and beyond the room."""
    rng = np.random.default_rng(5)
    rows = [(rng.integers(0, 9, n).tolist(), room) for n in (1, 2, 7, 60) for room in (-1, 0, 3, 8, 40, 500)]
    table = spark.createDataFrame(rows, "sizes array<int>, room int")
    for r in table.select("sizes", chunking.pack_starts(F.col("sizes"), F.col("room")).alias("starts"), chunking.spans(F.col("sizes"), F.col("room")).alias("spans")).collect():
        assert r["starts"] == [at for at, _ in r["spans"]] and sum(n for _, n in r["spans"]) == len(r["sizes"])


def test_chunks_and_parents_are_those_of_a_held_table(spark):
    """Chunks and parents are the same whether what both are made of is held or not, and it is given to be held once."""
    given = []
    hold = lambda frame: given.append(cut(frame)) or given[0]
    one, two = ([sorted(map(str, f.collect())) for f in chunking.chunk_items(texts._items(spark, SF), texts.SHORT, hold=h)] for h in (None, hold))
    assert one == two and len(given) == 1 and given[0].count() == len(one[1])


def test_sections_are_made_once_for_all_fields_of_a_card(spark):
    """However many fields are read out of a card's sections, these are put together once."""
    plan = manifest.document_fields(nested_cards(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map(Common") == 1


def test_a_view_of_cards_does_not_join_cards_to_themselves(spark):
    """The fields of a card's summary are read beside its sections, with the rows that a join would give."""
    cards = nested_cards(spark, SF)
    one, two = (manifest.card_view(cards, ["common", "APPROVERS"], *given) for given in ([], [manifest.document_fields(cards)]))
    scans = [v._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") for v in (one, two)]
    assert scans == [1, 2]
    shown = lambda v: sorted(str(r) for r in v.select("doc_id", "included", "omitted", "files", "summary", F.map_keys("sections").alias("k")).collect())
    assert shown(one) == shown(two)


def test_relations_of_a_card_are_not_held_together(spark):
    """A card's relations are hashed as they pass, in more than one batch, in the order that lists of them have."""
    line = F.concat_ws(":", "direction", "doc_id", F.coalesce("relation", F.lit("-")))
    rows = spark.range(32_000).selectExpr("if(id % 16 < 13, 0, id % 7) card_id", "if(id % 3 = 0, 'incoming', 'outgoing') direction", "(id * 7919) % 32000 pos", "id doc_id", "if(id % 5 > 0, concat('ж', id % 5), null) relation", "cast(null as string) doc_type")
    cards = spark.range(9).selectExpr("cast(id as string) id", "'T' type_name", "'c' type_caption", "'x' created_by_name", "1 version", "'' modified", "map('Common', struct(map('a', 'b') as fields, array(map('a', 'b')) as rows)) sections")
    told = F.array_join(F.transform("relations", lambda r: F.concat_ws(":", r["direction"], r["doc_id"], F.coalesce(r["relation"], F.lit("-")))), ",")
    want = {r["doc_id"]: r["m"] for r in manifest.document_fields(cards, rows).where(F.size("relations") > 0).select("doc_id", F.md5(told.cast("binary")).alias("m")).collect()}
    got = [(str(r["card_id"]), r["relations_md5"]) for r in manifest.relations_md5(rows, line).collect()]
    assert len(got) == 7 and dict(got) == want
    assert "collect_list" not in plans.QUERIES["prj1_document"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_squares_of_vectors_are_made_before_they_meet(spark):
    """A pair of vectors costs one product, not three."""
    plan = plans.QUERIES["sc25_cosine"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Join")[0].count("zip_with(") == 1 and plan.count("zip_with(") == 3


def most_held(work):
    """MB that Python held at most, and what came of it."""
    tracemalloc.start()
    try:
        found = work()
        return tracemalloc.get_traced_memory()[1] / 1e6, found
    finally:
        tracemalloc.stop()


def test_products_of_long_chunks_are_made_a_few_at_a_time():
    """What a block's products take doesn't grow with the length of its chunks, and the scores are those of all products."""
    rng = np.random.default_rng(3)
    draw = lambda rows, n: [list(zip(rng.integers(0, 600, n).tolist(), rng.integers(10, 30, n).tolist())) for _ in range(rows)]
    asked, chunks = draw(200, 40), [*draw(600, 900), [], *draw(3, 2), None]
    scorer = scoring.SparseScorer([[{"token": t, "weight": w / 10} for t, w in v] for v in asked])
    column = pa.array([v and [{"token": t, "weight": w / 10} for t, w in v] for v in chunks], pa.list_(pa.struct({"token": pa.int32(), "weight": pa.float64()})))
    mb, got = most_held(lambda: scorer.scores(column))
    sides = []
    for rows in (asked, chunks):
        sides.append(np.zeros((len(rows), 600)))
        for n, v in enumerate(rows):
            for t, w in v or []:
                sides[-1][n, t] = max(sides[-1][n, t], w / 10)
    assert np.allclose(got, sides[1] @ sides[0].T, atol=1e-5) and mb < 100


def test_equal_scores_are_held_a_few_at_a_time():
    """Of forty thousand equal chunks the smallest keys are the best, whatever their order, and few are held with their keys."""
    keys = [f"{i * 7919 % 40_000:05d}" for i in range(40_000)]
    best = scoring.Best(50, 5, -np.inf)
    mb, _ = most_held(lambda: best.add(pa.array(keys), np.ones((40_000, 50))))
    assert {(r.q, r.key) for r in best.rows().itertuples()} == {(q, f"{n:05d}") for q in range(50) for n in range(5)} and mb < 100

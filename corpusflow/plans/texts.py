"""Queries on chunks, sections, the glossary, names, sources and streams, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..functions import embed, text
from ..functions.ids import fingerprint
from ..operators import chunking, files, glossary, manifest, privacy, termjoin
from ..runtime import shared_folder
from ..settings import ChunkSettings, MemorySettings
from ..sources import io
from ..sources.store import BucketStore
from ..streaming import conversations, ingest, jobs
from .ingest import _uuid
from .standins import ctes, nested_cards, standin

SHORT = ChunkSettings(max_tokens=60, overlap_tokens=8, parent_max_tokens=200)


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _items(spark, d) -> DataFrame:
    """Lines of documents with headings, clauses and list marks put in by place."""
    rows = standin(spark, d, "lines").where("line <> ''")
    head = (F.col("n") % 7 == 3) & (F.col("n") > 0)
    clause = F.concat((F.col("n") % 5 + 1).cast("string"), F.lit("."), (F.col("n") % 4 + 1).cast("string"), F.lit(". "))
    return rows.select(
        F.col("doc_id").cast("string").alias("file_sha256"), F.col("n").cast("int").alias("seq"), F.lit(1).alias("depth"), F.when(head, "section_header").otherwise("text").alias("label"),
        F.when(head, F.concat((F.col("n") % 9 + 1).cast("string"), F.lit(". "), text.cut_words(F.col("line"), 3))).when(F.col("n") % 3 == 1, F.concat(clause, "line")).otherwise(F.col("line")).alias("text"),
        F.lit(1).alias("header_level"), F.lit(None).cast("string").alias("marker"), F.lit(False).alias("enumerated"), (F.col("n") / 10).cast("int").alias("page_no"), F.col("n").cast("string").alias("self_ref"),
    )


def sc5_chunks(spark, d):
    made, _ = chunking.chunk_items(_items(spark, d), SHORT)
    return made.select("file_sha256", "chunk_id", "ordinal", "kind", "strategy", F.array_join("breadcrumbs", " / ").alias("crumbs"), "clause", "tokens", "parent_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def wn5_parents(spark, d):
    _, made = chunking.chunk_items(_items(spark, d), SHORT)
    return made.select("file_sha256", "chunk_id", "ordinal", "section_key", "tokens", "part", "parts", F.size("item_refs").alias("children"))


def sc2_sentences(spark, d):
    return standin(spark, d, "chunks").select("chunk_id", F.posexplode(text.sentences(F.col("body"))).alias("i", "sentence"))


def sc3_windows(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(40).alias("limit"))
    return chunking.with_windows(rows, "text", "limit", 8).select("doc_id", F.posexplode("windows").alias("i", "window"))


def sc4_tables(spark, d):
    """Every document's lines as the rows of a table."""
    cells = F.concat(F.lit("| "), F.col("n").cast("string"), F.lit(" | "), F.replace("line", F.lit("|"), F.lit("/")), F.lit(" |"))
    rows = standin(spark, d, "lines").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", cells.alias("c")))), lambda r: r["c"]), "\n").alias("rows"))
    tables = rows.select("doc_id", F.concat(F.lit("| no | text |\n|---|---|\n"), "rows").alias("body"), F.lit(40).alias("limit"))
    return chunking.table_windows(tables, ["doc_id"], "body", "limit", 0).select("doc_id", F.get("place", 0).alias("i"), F.get("place", 1).alias("j"), "part")


def _runs(spark, d) -> DataFrame:
    rows = standin(spark, d, "chunks").select(F.col("doc_id").alias("file_id"), "n", F.when(F.col("n") % 5 < 3, F.lit("a")).when(F.col("n") % 5 == 3, F.lit("b")).alias("section"), "body")
    return chunking.section_runs(rows)


def wn4_runs(spark, d):
    return _runs(spark, d).select("file_id", "n", "section", "run")


def wn5_parts(spark, d):
    groups = _runs(spark, d).groupBy("file_id", "section", "run").agg(F.count(F.lit(1)).alias("n_chunks"))
    return chunking.numbered_parts(groups).select("file_id", "section", "run", "part", "parts")


def _parents(spark, d) -> DataFrame:
    return standin(spark, d, "chunks").select(
        "doc_id", F.col("chunk_id").alias("section_id"), "n", (F.length("body") * 10).cast("int").alias("tokens"),
        F.element_at(F.array(F.lit("main"), F.lit("appendix"), F.lit("supplement"), F.lit("other")), (F.col("n") % 4 + 1).cast("int")).alias("file_role"), F.concat(F.lit("f"), (F.col("n") % 3).cast("string")).alias("file_name"),
    )


def wn6_reading(spark, d):
    parents = _parents(spark, d)
    asked = parents.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 7 - 1).alias("offset"))
    return chunking.read_document(parents, asked)


def jn13_sections(spark, d):
    c = standin(spark, d, "chunks")
    parents = c.where("n % 4 = 1").select(F.col("parent_id").alias("section_id"), "doc_id")
    asked = c.select(F.when(F.col("n") % 2 == 0, F.col("chunk_id")).otherwise(F.col("parent_id")).alias("wanted"), (F.col("doc_id") - F.when(F.col("n") % 3 == 0, 1).otherwise(0)).alias("doc_id")).distinct()
    return chunking.find_sections(asked, parents, c)


def prj6_fingerprints(spark, d):
    return standin(spark, d, "cards").select("card_id", fingerprint("doc_type_title", "full_number", "state_id", "department").alias("fingerprint"))


def _terms(spark, d) -> DataFrame:
    word = F.regexp_replace(text.cut_words(F.col("body"), 1), "…", "")
    mark = F.element_at(F.array(F.lit(" — "), F.lit(": "), F.lit(" - ")), (F.col("n") % 3 + 1).cast("int"))
    line = F.when(F.col("n") % 4 == 1, F.concat(F.concat_ws(" ", F.lit("1)"), F.upper(F.substring("department", 1, 2)), word), mark, "body")).otherwise(F.col("body"))
    c = standin(spark, d, "chunks")
    return c.select("chunk_id", "n", "doc_id", F.col("parent_id").alias("section_id"), line.alias("body"), F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("Раздел "), (F.col("n") % 3).cast("string"), F.lit(". Термины и определения"))).otherwise(F.lit("Прочее")).alias("heading"), F.array(F.lit("x")).alias("section_path"))


def _verdicts(rows: DataFrame) -> DataFrame:
    key = F.ascii(F.substring("section_id", -1, 1))
    return rows.select("section_id").distinct().select("section_id", (key % 3 != 0).alias("glossary"), (key % 5 != 1).alias("parsed"), F.array(F.lit(2)).alias("reject"))


def sc8_sections(spark, d):
    return glossary.glossary_sections(_terms(spark, d)).select("chunk_id", "section_id")


def sc9_candidates(spark, d):
    return glossary.candidates(_terms(spark, d)).select("chunk_id", "pos", "term_key", "definition")


def sc10_records(spark, d):
    rows = _terms(spark, d)
    return glossary.records(glossary.numbered(glossary.candidates(rows), rows), _verdicts(rows)).select("record_id", "term_key", "section_id", "chunk_id")


def ag14_report(spark, d):
    rows = _terms(spark, d)
    listed = glossary.numbered(glossary.candidates(rows), rows)
    return glossary.report(listed, _verdicts(rows), glossary.records(listed, _verdicts(rows)), rows)


def _glossary(spark, d) -> DataFrame:
    rows = _terms(spark, d)
    found = glossary.records(glossary.numbered(glossary.candidates(rows), rows), _verdicts(rows)).join(rows.select("chunk_id", "doc_id"), "chunk_id")
    return found.select("record_id", "term", "term_key", "definition", F.when(F.col("doc_id") % 4 == 0, "cancelled").otherwise("active").alias("doc_status"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("doc_label"))


def wn11_ordered(spark, d):
    rows = _glossary(spark, d).withColumn("g", F.substring("term_key", 1, 2))
    return glossary.ordered(rows, "g").select("g", "record_id", "place")


def _asked(spark, d) -> DataFrame:
    """What the questions' words would be called in the glossary, as they stand and with another ending."""
    word = F.explode(text.words(F.col("text"))).alias("w")
    terms = standin(spark, d, "queries").select(word).distinct()
    return terms.select(F.explode(F.array(F.concat(F.lit(" «EN "), "w", F.lit("» ")), F.concat(F.lit("en "), "w", F.lit("s")))).alias("term"))


def tk4_lookup(spark, d):
    return glossary.lookup(_asked(spark, d), _glossary(spark, d)).select("term", "record_id", "place")


def tk4_exact(spark, d):
    return glossary.lookup_exact(_asked(spark, d), _glossary(spark, d))[0].select("term", "term_key", "place")


def sc11_similar(spark, d):
    """All pairs of a key that is asked for and one of the glossary that mean the same."""
    return termjoin.similar_keys(glossary.asked_terms(_asked(spark, d)), _glossary(spark, d)).select("key", "term_key", F.round("ratio", 6).alias("ratio"))


def sc12_expanded(spark, d):
    """Sections' names with a term and the short form of a definition that is a chunk's body."""
    rows = standin(spark, d, "chunks")
    e = F.when(F.col("n") % 5 != 0, F.array(F.struct(F.upper("doc_kind").alias("term"), F.concat("body", F.when(F.col("n") % 3 == 0, F.lit(" и для,")).otherwise(F.lit(". Далее"))).alias("definition")), F.struct(F.col("department").alias("term"), F.lit("язык, или.").alias("definition"))))
    return rows.select("chunk_id", glossary.expand_query(F.col("parent_id"), e, 40).alias("expanded"))


def sc12_restored(spark, d):
    """A question's abbreviations put back into a query that lost them."""
    kind = F.upper("doc_kind")
    rows = standin(spark, d, "chunks").select("chunk_id", F.concat(F.lit("что такое ПВТР и "), kind).alias("q"), F.concat(F.lit("пвтр "), F.translate("body", "АПВТРапвтр", "")).alias("r"))
    return rows.select("chunk_id", F.md5(glossary.keep_abbreviations(F.col("q"), F.col("r")).cast("binary")).alias("restored_md5"))


NAME_FIELDS = ("AuthorName", "SignedByName", "UserName")
PERSONS = ("Арбузова А.А.", "Бородина Мария Ивановна", "Кит Л.Л.", "Van-Dam Peter", "Бород И.И.", "System", "Орлов-Дальний С.С.", "Peter Oak", "Петр П.П.", "Григорьев Ян")


def _named_cards(spark, d) -> DataFrame:
    """Cards of teams that name persons in fields, rows and texts."""
    c = standin(spark, d, "cards").select("card_id", (F.col("card_id") % 40).alias("team"), "subject", F.col("pos"))
    person = lambda step: F.element_at(F.array(*map(F.lit, PERSONS)), (F.pmod(F.col("team") + F.floor(F.col("card_id") / 40) % 2 + step, F.lit(len(PERSONS))) + 1).cast("int"))
    word = lambda step: F.element_at(F.split(person(step), r"[ .]+"), 1)
    fields = F.create_map(F.lit("AuthorName"), person(0), F.lit("SignedByName::a"), F.concat(person(1), F.lit(" , "), person(2)), F.lit("Subject"), F.concat_ws(" ", "subject", word(0), F.lit("и"), word(3)))
    rows = F.array(F.create_map(F.lit("UserName"), person(3), F.lit("Note"), F.concat(F.lit("ok: "), person(0))))
    section = F.struct(F.lit("Common").alias("name"), fields.alias("fields"), rows.alias("rows"))
    body = F.concat(F.lit("За "), person(0), F.lit(" и Сидоров Т.Т. согласовано, "), word(1), F.lit("у сообщено; Л.Л. Кит, "), person(4))
    return c.select("card_id", "team", F.create_map(F.lit("Common"), section).alias("sections"), fields.alias("fields"), F.array(body, F.lit(None), word(2)).alias("notes"), F.when(F.col("card_id") % 9 != 0, body).alias("body"))


def sc26_cards(spark, d):
    """Cards whose teams' names, of fields and of texts, are replaced in texts, lists and fields."""
    cards = _named_cards(spark, d)
    names = privacy.field_names(cards, "team", NAME_FIELDS, ("System",)).unionByName(privacy.spellings(cards, "team", "body"))
    made = privacy.replace_names(cards, "team", ["body", "notes", "fields"], names)
    return made.select("card_id", "body", F.array_join("notes", "|", "-").alias("notes"), F.col("fields")["AuthorName"].alias("author"), F.col("fields")["SignedByName::a"].alias("signed"), F.col("fields")["Subject"].alias("subject"))


def _texts_with_names(spark, d) -> DataFrame:
    return standin(spark, d, "chunks").select("chunk_id", "doc_id", F.concat("body", F.lit(" "), F.initcap(F.substring("body", 1, 6)), F.lit("а И.О. и А.Б. Петров")).alias("body"))


def sc26_anonymized(spark, d):
    return privacy.anonymize(_texts_with_names(spark, d), "doc_id", "body").select("chunk_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def sc26_leftovers(spark, d):
    c = standin(spark, d, "chunks").select("chunk_id", "doc_id", F.concat("body", F.lit(" А.Б. Петров и Петров А.Б.")).alias("body"))
    found = privacy.spellings(c, "doc_id", "body")
    return privacy.leftovers(privacy.anonymize(c, "doc_id", "body"), "doc_id", "body", found.where("surname = 'петров'")).select("chunk_id")


def ud1_embeddings(spark, d):
    def factory():
        return lambda texts: [([float(len(t)), 1.0], {len(t) % 7: 1.0}) for t in texts]

    made = embed.embed_with(standin(spark, d, "chunks"), "chunk_id", "body", factory)
    return made.select("chunk_id", F.get("dense", 0).alias("d0"), F.map_keys("sparse")[0].alias("token"))


def ud3_parsed(spark, d):
    def factory():
        def parse(path, route):
            if path.endswith("7"):
                raise ValueError("broken")
            return [{"depth": 1, "label": "text", "text": f"{route} {path}", "header_level": 1, "marker": None, "enumerated": False, "page_no": 1, "self_ref": "0"}]

        return parse

    f = standin(spark, d, "files").select("sha256", F.when(F.col("extension") == "pdf", "model").otherwise("native").alias("route"), F.col("name").alias("path"))
    cache = f.where("path like '%1'").select(F.col("sha256").alias("file_sha256"), "route", F.lit("1").alias("version"))
    items, errors = io.parse_files(f, cache, factory)
    return items.select("file_sha256", "route", F.lit("item").alias("what")).unionByName(errors.select("file_sha256", "route", F.lit("error").alias("what")))


def src1_cards(spark, d):
    """Cards written as JSON beside one that is broken, read with the wanted sections and flattened; the broken one is an issue."""
    path = _folder(spark, "cards")
    nested_cards(spark, d).write.json(path, compression="gzip")
    spark.createDataFrame([('{"id": [broken',)], "value string").coalesce(1).write.text(f"{path}/broken")
    good, bad = io.read_cards(spark, path, ("COMMON",), many=True)
    omitted = F.array_join(F.sort_array("omitted"), "|").alias("omitted")
    flat = manifest.from_sections(good, keep=("omitted",)).select("card_id", "type_name", "doc_type_title", "full_number", "state_id", F.col("doc_date").cast("string").alias("doc_date"), omitted)
    issues = bad.select(F.lit("issue").alias("card_id"), F.col("kind").alias("type_name"))
    return flat.unionByName(issues, allowMissingColumns=True)


def src2_manifest(spark, d):
    """A manifest of all cards with their files and links, written as one JSON object and read back as three tables."""
    path = _folder(spark, "manifest")
    f = standin(spark, d, "files").groupBy("card_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "row_id", "name", "sha256"))), lambda x: F.struct(x["row_id"].alias("row_id"), x["name"].alias("name"), x["sha256"].alias("sha256"), F.lit(True).alias("downloaded"))).alias("files"))
    docs = standin(spark, d, "cards").join(f, "card_id", "left").select(F.col("card_id").cast("string").alias("card_id"), F.col("doc_type_title").alias("doc_kind"), F.col("full_number").alias("number"), F.coalesce("files", F.array().cast(dict(f.dtypes)["files"])).alias("files"))
    edges = standin(spark, d, "links").select(F.col("from_id").cast("string").alias("from_id"), F.col("to_id").cast("string").alias("to_id"), F.col("ref_type").alias("relation_type"), "reverse_type", F.lit("outgoing").alias("source"))
    docs.write.json(f"{path}/documents", compression="gzip")
    edges.write.json(f"{path}/edges", compression="gzip")
    documents, held, links = io.read_manifest(spark, path)
    return documents.select(F.lit("document").alias("what"), "card_id", F.col("number").alias("name")).unionByName(held.select(F.lit("file").alias("what"), "card_id", F.concat_ws("/", "row_id", "sha256").alias("name"))).unionByName(links.select(F.lit("edge").alias("what"), F.col("from_id").alias("card_id"), F.concat_ws("/", "to_id", "relation_type").alias("name")))


def src3_listing(spark, d):
    """The documents' texts as files, a hundred in each, listed with their sizes and hashes."""
    path = _folder(spark, "listing")
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.floor(F.col("doc_id") / 100).cast("int").alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition("part").sortWithinPartitions("part", "doc_id", "text").select("part", "text").write.partitionBy("part").text(path)
    listed = io.list_files(spark, path, whole=300_000).where("path like '%.txt'")
    return listed.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("int").alias("part"), "size", "sha256")


def snk5_written(spark, d):
    """The review table as a file with a header, read back."""
    path = _folder(spark, "review")
    io.write_review(manifest.card_metadata(standin(spark, d, "cards")).select("card_id", "doc_kind", "doc_number", "subject"), path)
    back = spark.read.option("sep", ";").option("header", True).csv(path)
    return back.select(F.col("card_id").cast("bigint").alias("card_id"), "doc_kind", "doc_number", "subject")


def snk4_manifest(spark, d):
    """Files written as JSON and read back."""
    path = _folder(spark, "manifest")
    io.write_json(standin(spark, d, "files").select("card_id", "row_id", "category", "size"), path)
    return spark.read.schema("card_id bigint, row_id string, category string, size bigint").json(path)


def st1_messages(spark, d):
    """The final table of a finite stream of writes that come out of order, in two runs with a restart between."""
    m = standin(spark, d, "messages").select("id", "parent_id", "output_text", "created_s", "turn")
    writes = m.select("id", "parent_id", F.lit("draft").alias("body"), "created_s", (F.col("turn") * 10).alias("seq")).unionByName(m.select("id", "parent_id", F.col("output_text").alias("body"), (F.col("created_s") + 5).alias("created_s"), (F.col("turn") * 10 + 1).alias("seq")))
    path, held, state = _folder(spark, "writes"), _folder(spark, "messages"), _folder(spark, "stream")
    for late in (F.col("seq") % 10 == 1, F.col("seq") % 10 == 0):  # the second write of a message comes first
        writes.where(late).repartition(3, "seq").write.mode("append").parquet(path)
        stream = spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 2).parquet(path)
        table = jobs.message_table(spark, held, StructType(list(writes.schema.fields)))  # a new object each time: the state is in its folder
        jobs.upsert_stream(stream, table, state).awaitTermination()
    return table.rows().select("id", "parent_id", F.md5(F.col("body").cast("binary")).alias("body_md5"), "created_s", "seq")


CHUNK_ROWS = "file_row_id string, n int, line_md5 string, label string, batch int"
OUTCOMES = "file_row_id string, card_id int, action string, status string, reason string, batch int"


def _line_parser():
    """Lines of a text; texts marked as broken can't be parsed."""

    def parse(row: dict) -> list[str]:
        if row["text"].startswith("BROKEN"):
            raise ValueError("broken file")
        return row["text"].split("\n")

    return parse


def _arriving(spark, rows: DataFrame, rounds, name: str):
    """Streams over a folder that grows by the rows of each round."""
    path = _folder(spark, name)
    for when in rounds:
        rows.where(when).repartition(2).write.mode("append").parquet(path)
        yield spark.readStream.schema(rows.schema).parquet(path)


def _chat_events(spark, d) -> DataFrame:
    """Writes of messages, elements and ratings: drafts, last words, deletions and what came back after one."""
    m = standin(spark, d, "messages").select("id", F.col("conversation_id").cast("string").alias("conversation_id"), "parent_id", F.col("output_text").alias("body"), "trace_id", "created_s", "turn")
    k = F.col("created_s") / 60 % 7
    seq = lambda n: (F.col("turn") * 10 + n).cast("bigint").alias("seq")
    write = lambda n, body, gone=False, created=0: m.select("id", "conversation_id", "parent_id", body.alias("body"), "trace_id", (F.col("created_s") + created).alias("created_s"), seq(n), F.lit(gone).alias("gone"), k.alias("k"))
    messages = write(1, F.lit("draft")).unionByName(write(4, F.col("body"), created=5)).unionByName(write(6, F.lit(None).cast("string"), True).where("k = 3")).unionByName(write(8, F.lit("again")).where("k = 3 and turn % 2 = 0"))
    part = lambda n, name, gone=False: m.select(F.concat(F.lit(name), F.lit("-"), "id").alias("id"), F.col("id").alias("message_id"), "conversation_id", F.concat(F.lit(f"{n} "), "id").alias("body"), seq(n), F.lit(gone).alias("gone"), k.alias("k"))
    elements = part(0, "a").unionByName(part(5, "a").where("k = 1")).unionByName(part(7, "b").where("k = 3")).unionByName(part(9, "a", True).where("k = 2"))
    rate = lambda n, value: m.select(F.col("id").alias("message_id"), "conversation_id", F.lit(value).alias("value"), F.lit(f"note {n}").alias("body"), seq(n), F.lit(False).alias("gone"), k.alias("k"))
    feedback = rate(2, 1).where("k < 4").unionByName(rate(3, -1).where("k = 0")).unionByName(rate(9, 5).where("k = 3"))
    return conversations.writes(messages.drop("k"), elements.drop("k"), feedback.drop("k"))


def _rounds(*columns: str) -> list:
    """Each row comes in one of two rounds, whatever its place in time."""
    late = F.pmod(F.xxhash64(*columns), F.lit(2))
    return [late == 1, late == 0]


def st1_chats(spark, d):
    """What three streams of writes leave, which come in any order and in two runs: every message, element and rating that stands."""
    held = BucketStore(spark, _folder(spark, "chats"), StructType.fromDDL(conversations.ROWS), "row_id", 16)
    state = _folder(spark, "stream")
    for stream in _arriving(spark, _chat_events(spark, d), _rounds("what", "id", "seq"), "writes"):
        conversations.chat_stream(stream, held, state).awaitTermination()
    return held.rows().drop("row_id")


def st1_conversations(spark, d):
    """Conversations that their writes bring into being, with the metadata that is left of updates that come in any order."""
    m = standin(spark, d, "messages")
    entry = F.create_map(F.lit("last"), F.col("turn").cast("string"), F.concat(F.lit("k"), (F.col("turn") % 3).cast("string")), F.when(F.col("turn") % 4 != 3, F.col("id")))
    rows = m.select(F.col("conversation_id").cast("string").alias("conversation_id"), F.col("turn").cast("bigint").alias("seq"), F.col("created_s").alias("at_s"), F.when(F.col("turn") % 5 != 4, entry).alias("metadata"))
    held = BucketStore(spark, _folder(spark, "conversations"), StructType.fromDDL(conversations.CONVERSATIONS), "conversation_id", 16)
    state = _folder(spark, "stream")
    for stream in _arriving(spark, rows, _rounds("conversation_id", "seq"), "updates"):
        conversations.conversation_stream(stream, held, state).awaitTermination()
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(conversations.metadata_of()), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return held.rows().select("conversation_id", "updated_s", shown.alias("metadata"))


def st3_stream(spark, d):
    """The same latencies from a stream whose events come in two runs, out of order."""
    rows = standin(spark, d, "agent_events").select("question_id", "seq", "kind", F.col("ts").cast("timestamp").alias("ts"))
    held = BucketStore(spark, _folder(spark, "latencies"), StructType.fromDDL(jobs.LATENCIES), "question_id", 16)
    state = _folder(spark, "stream")
    for stream in _arriving(spark, rows, _rounds("seq"), "events"):
        jobs.latency_stream(stream, held, state).awaitTermination()
    return held.rows().select("question_id", F.round("first_signal_s", 6).alias("first_signal_s"), F.round("first_token_s", 6).alias("first_token_s"))


def st2_ingest(spark, d):
    """Every document as a file, first as drafts, some of them broken, and then as it is: what didn't change stays, what did is chunked anew, changed metadata reaches the chunks, what failed is tried again, what is skipped goes."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.lit(1).alias("card_id"), F.col("doc_id").cast("string").alias("row_id"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("body"))
    id_ = F.col("doc_id")
    draft = F.when(id_ % 11 == 5, F.lit("BROKEN")).when(id_ % 3 == 0, F.concat(F.lit("draft\n"), "body")).otherwise(F.col("body"))
    final, kept, label = F.when(id_ % 22 == 5, F.lit("BROKEN")).otherwise(F.col("body")), F.when(id_ % 10 != 7, F.lit("main")), F.when(id_ % 4 == 1, "q").otherwise("p")
    path, held, state = _folder(spark, "files"), _folder(spark, "ingest"), _folder(spark, "stream")
    chunks, outcomes = (BucketStore(spark, f"{held}/{name}", StructType.fromDDL(rows), buckets=16) for name, rows in (("chunks", CHUNK_ROWS), ("outcomes", OUTCOMES)))
    chunk = lambda items: items.select("file_row_id", "n", F.md5(F.col("item").cast("binary")).alias("line_md5"), "label", "batch")
    for content, role, mark in ((draft, F.lit("main"), F.lit("p")), (final, kept, label)):
        rows = docs.select("card_id", "row_id", role.alias("role"), F.md5(content.cast("binary")).alias("sha256"), mark.alias("fingerprint"), mark.alias("label"), content.alias("text"))
        rows.write.mode("append").parquet(path)
        source = spark.readStream.schema(rows.schema).parquet(path)
        ingest.ingest_stream(source, chunks, outcomes, _line_parser, chunk, state, ("label",)).awaitTermination()
    made = chunks.rows().select(F.lit("chunk").alias("what"), "file_row_id", "n", "line_md5", "label", "batch")
    return made.unionByName(outcomes.rows().select(F.lit("outcome").alias("what"), "file_row_id", "action", "status", "reason", "batch"), allowMissingColumns=True)


def st4_memory(spark, d):
    """What a stream of turns leaves of each conversation: the last turns, and how many went into its summary."""
    m = standin(spark, d, "messages").select("conversation_id", "turn", F.col("output_text").alias("text"))
    path, state, out = _folder(spark, "turns"), _folder(spark, "stream"), _folder(spark, "memory")
    schema = StructType.fromDDL("conversation_id bigint, kept int, told int")
    tally = lambda texts: "x" * sum(len(t) if t.strip("x") == "" else 1 for t in texts)  # noqa: E731 - a summary that counts its turns
    for part in (F.col("turn") < 3, F.col("turn") >= 3):
        m.where(part).write.mode("append").parquet(path)
        stream = spark.readStream.schema(m.schema).parquet(path)

        def keep(batch: DataFrame, number: int) -> None:
            batch.select("conversation_id", "kept", F.length("summary").alias("told"), F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{out}/batch-{number}")

        memory = jobs.remember(stream, MemorySettings(recent_turns=2), tally)
        memory.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(schema.add("batch", IntegerType())).parquet(f"{out}/batch-*")
    return rows.groupBy("conversation_id").agg(F.max_by("kept", "batch").alias("kept"), F.max_by("told", "batch").alias("told"))


def st3_latencies(spark, d):
    return jobs.latencies(standin(spark, d, "agent_events")).select("question_id", F.round("first_signal_s", 6).alias("first_signal_s"), F.round("first_token_s", 6).alias("first_token_s"))


def flt7_script_share(spark, d):
    pages = standin(spark, d, "pages_text").withColumn("text", F.concat("text", F.when(F.col("file_id") % 3 == 0, F.lit(" прихOд прOдаха")).otherwise("")))
    return files.parse_route(pages, min_chars=20, max_mixed=0.05)


QUERIES = {k: f for k, f in globals().items() if callable(f) and not k.startswith("_") and k[:2] in ("sc", "wn", "jn", "pr", "ag", "tk", "ud", "sr", "sn", "st", "fl") and "_" in k}

EDGES = "[\\s«»\"''*_#.,;:()]+"
WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
TERMS = ctes("chunks", "queries") + f""", w AS (SELECT *, {WORDS.format("body")} AS ws FROM chunks),
ln AS (SELECT chunk_id, n, doc_id, parent_id AS section_id, CASE WHEN n % 4 = 1 THEN concat('1) ', upper(substr(department, 1, 2)), ' ', replace(coalesce(ws[1], ''), '…', ''), CASE n % 3 WHEN 0 THEN ' — ' WHEN 1 THEN ': ' ELSE ' - ' END, body) ELSE body END AS line FROM w),
ls AS (SELECT *, regexp_replace(trim(line), '^\\s*(?:[-–—•*▪]|\\d+[.)]|\\d+(?:\\.\\d+)+\\.?)\\s+', '') AS b FROM ln WHERE NOT regexp_matches(line, '^\\s*\\|.+\\|\\s*$')),
lp AS (SELECT *, regexp_matches(b, '\\s+[—–‒―−-]{{1,2}}\\s+') AS dashed, regexp_extract(b, '^(.*?)\\s+([—–‒―−-]{{1,2}})\\s+(.*)$', ['a', 'm', 'd'], 's') AS d, regexp_extract(b, '^(.*?):\\s+(.*)$', ['a', 'd'], 's') AS c, regexp_matches(b, ':\\s+') AS coloned FROM ls),
lr AS (SELECT chunk_id, n, doc_id, section_id, CASE WHEN dashed THEN d.a ELSE trim(c.a) END AS l, CASE WHEN dashed THEN d.d ELSE trim(c.d) END AS r FROM lp
  WHERE CASE WHEN dashed THEN NOT (d.m = '-' AND len({WORDS.format("d.a")}) = 1 AND NOT regexp_matches(d.a, '[А-ЯЁA-Z]{{2}}') AND regexp_matches(d.d, '^[а-яёa-z]')) ELSE coloned END),
lt AS (SELECT *, trim(regexp_replace(l, '^{EDGES}|{EDGES}$', '', 'g')) AS t, trim(regexp_replace(regexp_replace(trim(r), '\\s+([.,;:])', '\\1', 'g'), '[;,]+$', '')) AS d FROM lr WHERE NOT regexp_matches(l, ',\\s*$')),
lu AS (SELECT *, CASE WHEN len(regexp_replace(t, '[^(]', '', 'g')) > len(regexp_replace(t, '[^)]', '', 'g')) THEN trim(split_part(t, '(', 1)) ELSE t END AS term FROM lt),
lk AS (SELECT *, trim(regexp_replace(regexp_replace(translate(replace(lower(term), 'ß', 'ss'), 'ё', 'е'), '^{EDGES}|{EDGES}$', '', 'g'), '\\s+', ' ', 'g')) AS term_key FROM lu WHERE regexp_matches(term, '\\p{{L}}') AND len({WORDS.format("term")}) <= 6 AND length(d) >= 12 AND regexp_matches(d, '\\p{{L}}')),
cd AS (SELECT chunk_id, n, doc_id, section_id, 0 AS pos, term, term_key, CASE WHEN length(d) > 600 THEN regexp_replace(substr(d, 1, 600), '\\s+$', '') || '…' ELSE d END AS definition FROM lk WHERE term_key NOT IN ('термин', 'термины', 'сокращение', 'сокращения', 'аббревиатура', 'обозначение', 'понятие', 'определение')),
nr AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY n, pos) AS ordinal FROM cd QUALIFY ordinal <= 60),
vd AS (SELECT DISTINCT section_id, unicode(right(section_id, 1)) % 3 <> 0 AS glossary, unicode(right(section_id, 1)) % 5 <> 1 AS parsed FROM ln),
rc AS (SELECT *, {_uuid("concat(chunk_id, ':', term_key)")} AS record_id FROM nr JOIN vd USING (section_id) WHERE parsed AND glossary AND ordinal <> 2 QUALIFY row_number() OVER (PARTITION BY chunk_id, term_key ORDER BY n, pos) = 1),
gl AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'cancelled' ELSE 'active' END AS doc_status, 'doc ' || doc_id AS doc_label, trim(regexp_replace(regexp_replace(translate(replace(lower(definition), 'ß', 'ss'), 'ё', 'е'), '^{EDGES}|{EDGES}$', '', 'g'), '\\s+', ' ', 'g')) AS dk FROM rc)
"""
RUNS = ctes("chunks") + """,
rs AS (SELECT doc_id AS file_id, n, CASE WHEN n % 5 < 3 THEN 'a' WHEN n % 5 = 3 THEN 'b' END AS section FROM chunks),
rt AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(section) OVER w IS DISTINCT FROM section THEN 1 ELSE 0 END AS s FROM rs WINDOW w AS (PARTITION BY file_id ORDER BY n)),
rn AS (SELECT file_id, n, section, sum(s) OVER (PARTITION BY file_id ORDER BY n)::BIGINT AS run FROM rt)
"""
ORACLES = {
    "wn4_runs": RUNS + "SELECT * FROM rn",
    "wn5_parts": RUNS + ", g AS (SELECT file_id, section, run FROM rn GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY file_id, section ORDER BY run)::INT AS part, count(*) OVER (PARTITION BY file_id, section)::INT AS parts FROM g",
    "wn6_reading": ctes("chunks") + ", p AS (SELECT doc_id, chunk_id AS section_id, length(body) * 10 AS tokens, row_number() OVER (PARTITION BY doc_id ORDER BY n % 4, 'f' || (n % 3), n) - 1 AS place, count(*) OVER (PARTITION BY doc_id) AS total FROM chunks), q AS (SELECT *, least(greatest(doc_id % 7 - 1, 0), total - 1) AS start FROM p), u AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id ORDER BY place) AS used FROM q WHERE place >= start), k AS (SELECT * FROM u WHERE place = start OR (used <= 4000 AND place - start < 40)) SELECT doc_id, place::INT AS place, section_id, total, CASE WHEN max(place) OVER (PARTITION BY doc_id) + 1 < total THEN (max(place) OVER (PARTITION BY doc_id) + 1)::INT END AS next_offset FROM k",
    "jn13_sections": ctes("chunks") + ", p AS (SELECT parent_id AS section_id, doc_id FROM chunks WHERE n % 4 = 1), q AS (SELECT DISTINCT CASE WHEN n % 2 = 0 THEN chunk_id ELSE parent_id END AS wanted, doc_id - CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS doc_id FROM chunks), v AS (SELECT c.chunk_id AS wanted, p.section_id, p.doc_id FROM chunks c JOIN p ON c.parent_id = p.section_id) SELECT q.doc_id, q.wanted, coalesce(p.section_id, v.section_id) AS section_id, coalesce(p.doc_id, v.doc_id) <> q.doc_id AS other_document FROM q LEFT JOIN p ON p.section_id = q.wanted LEFT JOIN v ON v.wanted = q.wanted",
    "prj6_fingerprints": ctes("cards") + " SELECT card_id, sha256(json_object('doc_type_title', doc_type_title, 'full_number', full_number, 'state_id', state_id, 'department', department)::VARCHAR) AS fingerprint FROM cards",
    "sc8_sections": ctes("chunks") + " SELECT chunk_id, parent_id AS section_id FROM chunks WHERE doc_id % 10 = 0",
    "ud1_embeddings": ctes("chunks") + " SELECT chunk_id, length(body)::DOUBLE AS d0, (length(body) % 7)::INT AS token FROM chunks",
    "src1_cards": ctes("cards") + " SELECT card_id::VARCHAR AS card_id, type_name, doc_type_title, full_number, state_id, doc_date::VARCHAR AS doc_date, 'Approval|Approvers|Directions|Service' AS omitted FROM cards UNION ALL SELECT 'issue', 'invalid', NULL, NULL, NULL, NULL, NULL",
    "src2_manifest": ctes("cards", "files", "links") + " SELECT 'document' AS what, card_id::VARCHAR AS card_id, full_number AS name FROM cards UNION ALL SELECT 'file', f.card_id::VARCHAR, concat_ws('/', row_id, sha256) FROM files f JOIN cards USING (card_id) UNION ALL SELECT 'edge', from_id::VARCHAR, concat_ws('/', to_id, ref_type) FROM links",
    "src3_listing": "SELECT (doc_id // 100)::INT AS part, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id, text)) AS sha256 FROM documents GROUP BY ALL",
    "sc9_candidates": TERMS + "SELECT chunk_id, pos, term_key, definition FROM cd",
    "sc10_records": TERMS + "SELECT record_id, term_key, section_id, chunk_id FROM rc",
    "ag14_report": TERMS + ", sn AS (SELECT DISTINCT section_id FROM nr), sv AS (SELECT coalesce(parsed, false) AS parsed, glossary FROM sn LEFT JOIN vd USING (section_id)) SELECT count(*) AS sections, count(*) FILTER (parsed AND glossary) AS confirmed, count(*) FILTER (parsed AND NOT glossary) AS rejected, count(*) FILTER (NOT parsed) AS unconfirmed, (SELECT count(*) FROM nr) AS candidates, (SELECT count(*) FROM rc) AS records, (SELECT count(DISTINCT doc_id) FROM rc) AS documents FROM sv",
    "wn11_ordered": TERMS + ", o1 AS (SELECT substr(term_key, 1, 2) AS g, record_id, doc_status, doc_label FROM gl QUALIFY row_number() OVER (PARTITION BY substr(term_key, 1, 2), term_key, dk ORDER BY doc_status <> 'active', doc_label, record_id) = 1) SELECT g, record_id, row_number() OVER (PARTITION BY g ORDER BY doc_status <> 'active', doc_label, record_id)::INT AS place FROM o1",
    "tk4_exact": TERMS + f", qw AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS w FROM queries), qt AS (SELECT unnest([concat(' «EN ', w, '» '), concat('en ', w, 's')]) AS term FROM qw), qk AS (SELECT DISTINCT term, trim(regexp_replace(regexp_replace(translate(replace(lower(term), 'ß', 'ss'), 'ё', 'е'), '^{EDGES}|{EDGES}$', '', 'g'), '\\s+', ' ', 'g')) AS k FROM qt), mt AS (SELECT qk.term, gl.* EXCLUDE (term) FROM qk JOIN gl ON k = term_key QUALIFY row_number() OVER (PARTITION BY qk.term ORDER BY record_id) <= 5), od AS (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY term, term_key, dk ORDER BY doc_status <> 'active', doc_label, record_id) = 1) SELECT term, term_key, row_number() OVER (PARTITION BY term ORDER BY doc_status <> 'active', doc_label, record_id)::INT AS place FROM od",
    "ud3_parsed": ctes("files") + " SELECT DISTINCT sha256 AS file_sha256, CASE WHEN extension = 'pdf' THEN 'model' ELSE 'native' END AS route, CASE WHEN name LIKE '%7' THEN 'error' ELSE 'item' END AS what FROM files WHERE name NOT LIKE '%1'",
    "flt7_script_share": ctes("pages_text") + ", x AS (SELECT file_id, concat(text, CASE WHEN file_id % 3 = 0 THEN ' прихOд прOдаха' ELSE '' END) AS t FROM pages_text), w AS (SELECT file_id, t, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: regexp_matches(x, '\\p{L}')) AS ws FROM x), c AS (SELECT file_id, length(regexp_replace(t, '\\s+', '', 'g')) >= 20 AND len(list_filter(ws, lambda x: regexp_matches(x, '\\p{Cyrillic}') AND regexp_matches(x, '\\p{Latin}'))) <= len(ws) * 0.05 AS good FROM w) SELECT file_id, count(*) AS n_pages, count(*) FILTER (good) AS text_pages, CASE WHEN count(*) FILTER (good) >= count(*) * 0.5 THEN 'native' ELSE 'model' END AS route FROM c GROUP BY file_id",
    "snk5_written": ctes("cards") + " SELECT card_id, coalesce(doc_type_title, type_name, 'Без вида') AS doc_kind, coalesce(full_number, secondary_number) AS doc_number, subject FROM cards",
    "st4_memory": ctes("messages") + " SELECT conversation_id, least(2, count(*))::INT AS kept, greatest(0, count(*) - 2)::INT AS told FROM messages GROUP BY conversation_id",
    "snk4_manifest": ctes("files") + " SELECT card_id, row_id, category, size FROM files",
    "st1_messages": ctes("messages") + " SELECT id, parent_id, md5(output_text) AS body_md5, created_s, turn * 10 + 1 AS seq FROM messages",
    "st2_ingest": "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents) SELECT 'chunk' AS what, doc_id::VARCHAR AS file_row_id, n::INT AS n, md5(line) AS line_md5, CASE WHEN doc_id % 4 = 1 THEN 'q' ELSE 'p' END AS label, CASE WHEN doc_id % 3 = 0 OR doc_id % 22 = 16 THEN 1 ELSE 0 END::INT AS batch, NULL AS action, NULL AS status, NULL AS reason FROM l WHERE doc_id % 10 <> 7 AND doc_id % 22 <> 5"
    " UNION ALL SELECT 'outcome', doc_id::VARCHAR, NULL, NULL, NULL, CASE WHEN doc_id % 10 = 7 OR doc_id % 11 = 5 OR doc_id % 3 = 0 OR doc_id % 4 = 1 THEN 1 ELSE 0 END::INT, CASE WHEN doc_id % 10 = 7 THEN 'skipped' WHEN doc_id % 11 <> 5 AND doc_id % 3 <> 0 AND doc_id % 4 = 1 THEN 'metadata_only' ELSE 'parse' END, CASE WHEN doc_id % 10 = 7 THEN 'skipped' WHEN doc_id % 22 = 5 THEN 'failed' ELSE 'indexed' END, CASE WHEN doc_id % 10 <> 7 AND doc_id % 22 = 5 THEN 'ValueError: broken file' END FROM documents",
    "st1_chats": ctes("messages") + """, w AS (SELECT *, conversation_id::VARCHAR AS cid, created_s // 60 % 7 AS k, turn * 10 AS s FROM messages),
ms AS (SELECT *, k <> 3 OR turn % 2 = 0 AS there, CASE WHEN k = 3 THEN s + 6 ELSE -1 END AS deleted FROM w),
ch AS (SELECT parent_id, arg_max(trace_id, struct_pack(a := created_s, b := id)) AS t FROM ms WHERE there AND trace_id IS NOT NULL AND parent_id IS NOT NULL GROUP BY parent_id)
SELECT 'message' AS what, id, id AS message_id, cid AS conversation_id, parent_id, CASE WHEN k = 3 THEN 'again' ELSE output_text END AS body, trace_id, created_s::BIGINT AS created_s, NULL::INT AS value FROM ms WHERE there
UNION ALL SELECT 'element', 'a-' || id, id, cid, NULL, concat(CASE WHEN k = 1 THEN 5 ELSE 0 END, ' ', id), NULL, NULL, NULL FROM ms WHERE there AND k NOT IN (2, 3)
UNION ALL SELECT 'element', 'b-' || id, id, cid, NULL, '7 ' || id, NULL, NULL, NULL FROM ms WHERE there AND k = 3
UNION ALL SELECT 'feedback', id, id, cid, NULL, concat('note ', CASE k WHEN 0 THEN 3 WHEN 3 THEN 9 ELSE 2 END), coalesce(trace_id, ch.t), NULL, CASE k WHEN 0 THEN -1 WHEN 3 THEN 5 ELSE 1 END FROM ms LEFT JOIN ch ON ch.parent_id = ms.id WHERE there AND k < 4""",
    "st1_conversations": ctes("messages") + """, e AS (SELECT conversation_id, turn, unnest([struct_pack(k := 'last', v := turn::VARCHAR), struct_pack(k := 'k' || (turn % 3), v := CASE WHEN turn % 4 <> 3 THEN id END)]) AS e FROM messages WHERE turn % 5 <> 4),
l AS (SELECT conversation_id, e.k AS k, arg_max(struct_pack(v := e.v), turn).v AS v FROM e GROUP BY ALL), g AS (SELECT conversation_id, string_agg(k || '=' || v, ',' ORDER BY k || '=' || v) AS t FROM l WHERE v IS NOT NULL GROUP BY conversation_id)
SELECT conversation_id::VARCHAR AS conversation_id, max(created_s)::BIGINT AS updated_s, coalesce(any_value(g.t), '') AS metadata FROM messages LEFT JOIN g USING (conversation_id) GROUP BY conversation_id""",
    "st3_latencies": ctes("agent_events") + ", a AS (SELECT question_id, min(epoch_us(ts)) FILTER (kind = 'run_started') AS a, min(epoch_us(ts)) FILTER (kind <> 'run_started') AS b, min(epoch_us(ts)) FILTER (kind = 'answer_delta') AS c FROM agent_events GROUP BY question_id) SELECT question_id, round((b - a) / 1e6::DOUBLE, 6) AS first_signal_s, round((c - a) / 1e6::DOUBLE, 6) AS first_token_s FROM a",
    "sc12_expanded": ctes("chunks") + f""", a AS (SELECT *, regexp_replace(trim(split_part(concat(body, CASE n % 3 WHEN 0 THEN ' и для,' ELSE '. Далее' END), '. ', 1)), '\\.+$', '') AS f FROM chunks),
b AS (SELECT *, CASE WHEN length(f) > 40 THEN CASE WHEN contains(substr(f, 1, 40), ' ') THEN regexp_replace(substr(f, 1, 40), ' [^ ]*$', '') ELSE substr(f, 1, 40) END ELSE f END AS s FROM a),
c AS (SELECT *, {WORDS.format("s")} AS ws FROM b),
e AS (SELECT *, list_filter(range(1, len(ws) + 1), lambda i: regexp_replace(regexp_replace(lower(ws[i]), '^[ ,;:.–—-]+', ''), '[ ,;:.–—-]+$', '') NOT IN ('и','или','а','но','от','до','для','со','с','в','во','к','ко','на','по','при','из','у','о','об','за','что','как','это','его','её','их')) AS keep FROM c)
SELECT chunk_id, CASE WHEN n % 5 <> 0 THEN concat(parent_id, ' (', upper(doc_kind), ' — ', regexp_replace(array_to_string(ws[1:coalesce(list_max(keep), 0)], ' '), '[ ,;:.–—-]+$', ''), '; ', department, ' — язык)') ELSE parent_id END AS expanded FROM e""",
    "sc12_restored": ctes("chunks") + ", r AS (SELECT chunk_id, upper(doc_kind) AS k, concat('ПВТР ', translate(body, 'АПВТРапвтр', '')) AS r FROM chunks) SELECT chunk_id, md5(CASE WHEN contains(r, k) THEN r ELSE concat(r, ' ', k) END) AS restored_md5 FROM r",
}
ORACLES["st3_stream"] = ORACLES["st3_latencies"]

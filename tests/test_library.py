"""Cases of single operators, and plain-Python twins of helpers."""

import difflib
import hashlib
import itertools
import os
import random
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import ids, text
from corpusflow.operators import answers, chunking, evaluate, glossary, graph, privacy, search, termjoin
from corpusflow.sources import io
from corpusflow.settings import ChunkSettings, GlossarySettings, WalkSettings


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value, want", [("1.1. Текст", "1.1"), ("1) текст", "1"), ("2 текст", None), ("26 702 руб", None), ("04.09.2026 г", None), ("2026. год", None), ("1.", None), ("", None)])
def test_clause_numbers(spark, value, want):
    assert one(spark, value, text.clause_number) == want


def test_text_functions(spark):
    assert one(spark, "  x y ", text.strip) == "x y"
    assert one(spark, "Первое. Второе; третье! 4 четвёртое\nпятое", text.sentences) == ["Первое.", "Второе; третье!", "4 четвёртое", "пятое"]
    assert one(spark, " «ЁЖ;» ", text.normalize_term) == "еж" and one(spark, "Раздел 2. Термины", text.normalize_heading) == "термины"
    assert one(spark, "[S1] 12:45 и 26,7 [2]", text.numbers_in) == ["12:45", "26,7"]
    assert one(spark, "12:45 (уход) + 45 минут = 13:30; 1:00 + 5 мин = 1:06", text.computed_times) == ["13:30"]
    assert one(spark, "true", text.int_or_null) is None and one(spark, " 7 ", text.int_or_null) == 7
    assert str(one(spark, "2024-02-03T10:00:00Z", text.date_or_null)) == "2024-02-03" and one(spark, "2024-02-99", text.date_or_null) is None


def test_ids(spark):
    for name in ("a", "привет:3", ""):
        assert one(spark, name, ids.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def windows_of(spark, value, limit, overlap):
    rows = spark.createDataFrame([(value, limit)], "t string, room int")
    return chunking.with_windows(rows, "t", "room", overlap).first()["windows"]


def test_text_windows(spark):
    words = [f"w{i}" for i in range(300)]
    sentences = [" ".join(words[i : i + 7]).capitalize() + "." for i in range(0, 300, 7)]
    windows = windows_of(spark, " ".join(sentences), 40, 10)
    assert all(len(w.split()) <= 40 for w in windows)
    assert [s for s in sentences if not any(s in w for w in windows)] == []
    for a, b in itertools.pairwise(windows):
        shared = [s for s in sentences if s in a and s in b]
        assert 10 <= sum(len(s.split()) for s in shared) < 20
    assert windows_of(spark, "short", 40, 10) == ["short"] and windows_of(spark, "", 40, 10) == [""]
    assert [len(w.split()) for w in windows_of(spark, "x " * 100, 40, 10)] == [40, 40, 20]


def test_spans(spark):
    def brute(sizes, limit, overlap):  # by trying every end
        out, at = [], 0
        while at < len(sizes):
            end = at + 1
            while end < len(sizes) and sum(sizes[at : end + 1]) <= limit:
                end += 1
            out.append([at, end - at])
            if end == len(sizes):
                return out
            back = end
            while back - 1 > at and sum(sizes[back:end]) < overlap and sum(sizes[back - 1 : end + 1]) <= limit:
                back -= 1
            at = back
        return out

    import random

    rng = random.Random(7)
    cases = [([rng.randint(1, 9) for _ in range(rng.randint(0, 12))], rng.randint(4, 20), rng.randint(0, 6)) for _ in range(80)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, sizes array<int>, room int, more int")
    got = {r["i"]: r["s"] for r in rows.select("i", chunking.spans(F.col("sizes"), F.col("room"), F.col("more")).alias("s")).collect()}
    assert got == {i: brute(*c) for i, c in enumerate(cases)}


def test_table_windows(spark):
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | value number {i} |" for i in range(20)) + "\n| 99 | " + "long " * 60 + "|"
    rows = spark.createDataFrame([(1, table, 40), (2, "| a |\n|---|\n| 1 |", 40), (3, "| " + "name " * 50 + "| b |\n|---|---|\n| 1 | 2 |", 40), (4, "no table", 40)], "k int, t string, room int")
    found = {}
    for r in chunking.table_windows(rows, ["k"], "t", "room", 0).orderBy("k", "place").collect():
        found.setdefault(r["k"], []).append(r["part"])
    parts = found[1]
    assert all(len(p.split()) <= 40 for p in parts) and all(p.startswith(("| a | b |", "a: 99", "b: long", "long")) for p in parts)
    assert "".join(parts).count("value number") == 20 and sum(p.split().count("long") for p in parts) == 60
    assert found[2] == ["| a |\n|---|\n| 1 |"] and found[4] == ["no table"]
    assert found[3][-1].endswith("b: 2") and "".join(found[3][:-1]).count("name") + found[3][-1].count("name") >= 50


ITEMS = "file_sha256 string, seq int, depth int, label string, text string, header_level int, marker string, enumerated boolean, page_no int, self_ref string"


def item(n, text, label="text", file="sha", depth=1, header_level=1, marker=None):
    return (file, n, depth, label, text, header_level, marker, marker is not None, 1, f"#{n}")


def test_structural_chunks(spark):
    items = [
        item(0, "Правила", "title"), item(1, "1. Общие положения", "section_header", header_level=2), item(2, "1.1. Первый пункт правил здесь."), item(3, "1.2. Перечень:"), item(4, "первое;", "list_item"),
        item(5, "второе.", "list_item"), item(6, "2. Контроль"), item(7, "Текст раздела."), item(8, "6. Режим\t14"), item(9, "Приложение № 1"), item(10, "к приказу 5"), item(11, "Лист оповещения"), item(12, "1. Мастер смены;"), item(13, "2. Инженер;"),
        item(14, "| a |\n|---|\n| 1 |", "table"), item(15, "в ячейке", depth=2), item(16, "колонтитул", "page_footer"),
        item(0, "просто текст", file="plain"), item(1, "ещё текст", file="plain"), item(2, "| b |\n|---|", "table", file="plain"), item(3, "конец", file="plain"),
        item(0, "Пункты", "section_header", file="numbers"), item(1, "3.1.", file="numbers"), item(2, "Номер стоит отдельно.", file="numbers"), item(3, "с маркером", "list_item", file="numbers", marker="3.2"), item(4, "далее", file="numbers"),
    ]
    roots = spark.createDataFrame([("sha", ["Файл"])], "file_sha256 string, root array<string>")
    found, parents = chunking.chunk_items(spark.createDataFrame(items, ITEMS).repartition(3), ChunkSettings(min_tokens=3), roots=roots)
    chunks = {}
    for r in found.orderBy("ordinal").collect():
        chunks.setdefault(r["file_sha256"], []).append(r)
    got = [(c["breadcrumbs"], c["clause"], c["body"], c["kind"]) for c in chunks["sha"]]
    # the only heading of the top level that starts the file is its title
    top, appendix = ["Файл", "Раздел 1. Общие положения"], ["Файл", "Приложение № 1. Лист оповещения"]
    assert got == [
        ([*top, "п. 1.1"], "1.1", "1.1. Первый пункт правил здесь.", "text"), ([*top, "п. 1.2"], "1.2", "1.2. Перечень:\nпервое;\nвторое.", "text"), ([*top, "Раздел 2. Контроль"], None, "Текст раздела.", "text"),
        (appendix, None, "к приказу 5", "text"), (appendix, None, "1. Мастер смены;\n2. Инженер;", "text"), (appendix, None, "| a |\n|---|\n| 1 |", "table"),
    ]
    assert [c["chunk_id"] for c in chunks["sha"]] == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"sha:{i}")) for i in range(6)]
    assert [(c["strategy"], c["body"]) for c in chunks["plain"]] == [("fixed", "просто текст\nещё текст\nконец"), ("fixed", "| b |\n|---|")]
    assert [(c["clause"], c["body"]) for c in chunks["numbers"]] == [("3.1", "3.1. Номер стоит отдельно."), ("3.2", "3.2 с маркером"), (None, "далее")]
    held = parents.where("file_sha256 = 'sha'").orderBy("ordinal").collect()
    assert [i for p in held for i in p["item_refs"]] == [c["chunk_id"] for c in chunks["sha"]] and [len(p["item_refs"]) for p in held] == [2, 1, 3]
    assert [c["parent_id"] for c in chunks["sha"]] == [p["chunk_id"] for p in held for _ in p["item_refs"]]
    none = spark.createDataFrame([], ITEMS)
    assert [x.count() for x in chunking.chunk_items(none)] == [0, 0]


def test_parents_keep_the_budget(spark):
    rows = [("f", i, ["s"], "w " * 400, str(i), "s", "s", 1) for i in range(12)]
    chunks = spark.createDataFrame(rows, "file_sha256 string, ordinal int, path array<string>, body string, chunk_id string, section_key string, heading string, page_no int")
    _, parents = chunking.parents_of(chunks, ChunkSettings(parent_max_tokens=1000))
    assert [(p["part"], p["parts"], p["item_refs"]) for p in parents.orderBy("ordinal").collect()] == [(i + 1, 6, [str(2 * i), str(2 * i + 1)]) for i in range(6)]


def test_walk_of_a_cycle(spark):
    links = [("A", "B", 1), ("A", "C", 2), ("B", "A", 1), ("C", "D", 1), ("D", "E", 1), ("A", "A", 3), ("G", "E", 1), ("B", "X", 2)]
    rows = spark.createDataFrame([(a, b, "outgoing", None, p) for a, b, p in links], "card_id string, other_id string, direction string, ref_type string, pos int")
    cards = spark.createDataFrame([(c, "T") for c in "ABCDEG"], "card_id string, type_name string")
    seeds = spark.createDataFrame([("A", 0), ("G", 1), ("A", 2)], "card_id string, pos int")
    found = graph.walk(seeds, rows, cards, WalkSettings(max_depth=2, max_docs=100, directions=("outgoing",)))
    assert {(r["card_id"], r["depth"], r["status"]) for r in found["nodes"].collect()} == {("A", 0, "card"), ("G", 0, "card"), ("B", 1, "card"), ("C", 1, "card"), ("E", 1, "card"), ("D", 2, "card"), ("X", 2, "error")}
    assert {(r["card_id"], r["via_id"]) for r in found["entry_paths"].where("kind = 'link'").collect()} == {("B", "A"), ("C", "A"), ("A", "B"), ("D", "C"), ("E", "D"), ("E", "G"), ("X", "B")}
    few = graph.walk(seeds, rows, cards, WalkSettings(max_depth=2, max_docs=3, directions=("outgoing",)))
    assert [r["card_id"] for r in few["nodes"].orderBy("seq").collect()] == ["A", "G", "B"]
    assert {(r["other_id"], r["reason"]) for r in few["skipped_links"].collect()} == {("C", "max_docs"), ("E", "max_docs"), ("X", "max_docs")}


def test_percentile_and_verdicts(spark):
    rows = spark.createDataFrame([("k", 1.0), ("k", 2.0), ("k", 3.0), ("k", 10.0), ("j", None)], "c string, v double")
    assert [(r["n"], r["value"]) for r in evaluate.percentile_by(rows, ["c"], "v", 0.95).collect()] == [(4, 10.0)]
    assert rows.agg(evaluate.nearest_rank(F.collect_list("v"), 0.5).alias("p")).first()["p"] == 2.0  # 2.5 rounds to the even rank
    said = ['x {"correctness": 9, "statements": -1, "refusal": true} y', "nothing", '{"correctness": "a"}', '{"correctness": 2.7, "citations": "3", "conflict": 1}', '{"a": "line\nbreak"} {"correctness": 1}', "{broken", None]
    table = spark.createDataFrame(list(enumerate(said)), "id int, output string")
    got = {r["id"]: tuple(r["judge"]) for r in answers.parse_verdicts(table).collect()}
    none = (0, 0, 0, 0, 0, False, False)
    assert got == {0: (5, 0, 0, 0, 0, True, False, True), 1: (*none, False), 2: (*none, False), 3: (2, 0, 0, 3, 0, False, True, True), 4: (*none, True), 5: (*none, False), 6: (*none, False)}
    assert table.where("id = 4").select(answers.first_object(F.col("output")).alias("o")).first()["o"] == {"a": "line\nbreak"}


def claims_of(spark, draft, claims, ratio, question=""):
    drafts = spark.createDataFrame([(1, draft, question)], "answer_id int, text string, question string")
    problems = spark.createDataFrame([(1, n, c) for n, c in enumerate(claims)], "answer_id int, n int, claim string")
    return tuple(answers.apply_claims(drafts, problems, ratio).first())[1:]


def test_claims_and_citations(spark):
    draft = "Отпуск длится 28 дней [S1]. Директор живёт в Москве [S2]. Уход в 12:45 + 45 минут = 13:30 [S3]."
    done, corrected, emptied, actions = claims_of(spark, draft, ["Директор живёт в Москве", "Уход в 12:45 + 45 минут = 13:30", "Совсем другое замечание про погоду и море"], 0.8, "ушёл в 12:45")
    assert corrected and not emptied and actions == ["removed", "kept", "unmatched"] and done == "Отпуск длится 28 дней [S1]. Уход в 12:45 + 45 минут = 13:30 [S3]."
    assert claims_of(spark, "Только это предложение [S1].", ["Только это предложение"], 0.8)[1:] == (False, True, ["kept"])
    assert claims_of(spark, "Первое длинное предложение тут. Да. Второе длинное предложение тут.", ["Первое длинное предложение тут. Да."], 0.6)[0] == "Второе длинное предложение тут."
    assert claims_of(spark, "Он живёт в городе Москва.\n\nОна живёт в городе Омск.", ["Он живёт в городе Москве"], 0.6) == ("Она живёт в городе Омск.", True, False, ["removed"])
    assert claims_of(spark, "Текст без замечаний.", [], 0.6) == ("Текст без замечаний.", False, False, [])
    rows = spark.createDataFrame([(1, 7, "Да [S1, D2], нет [S9]. D1 тут, D3 там.\nСсылки:\n[S1] x"), (2, 7, None), (3, 7, "Ссылки: смотри дальше"), (4, 7, "Так.  \nИсточники:\n1. a\n2. b")], "answer_id int, session_id int, text string")
    numbers = spark.createDataFrame([(1, "S1", 1), (1, "D2", 2), (1, "S9", None)], "answer_id int, alias string, number int")
    labels = spark.createDataFrame([(7, "D1", "Приказ №1"), (7, "D3", ""), (8, "D3", "x")], "session_id int, alias string, label string")
    got = {r["answer_id"]: r["body"] for r in answers.render_cited(rows, numbers, labels).collect()}
    assert got == {1: "Да [1][2], нет . Приказ №1 тут, D3 там.", 2: "", 3: "Ссылки: смотри дальше", 4: "Так."}
    assert one(spark, "Прямой ответ:\n\nДетали:\nтекст\n-\n", answers.without_empty_sections) == "Детали:\nтекст"


def test_evidence_budget(spark):
    blocks = [(1, 1, "document", "d" * 300), (1, 2, "search", "s" * 250), (1, 3, "document", "e" * 300), (1, 4, "document", "f"), (1, 5, "search", "t" * 500), (1, 6, "search", "u"), (2, 1, "search", None)]
    table = spark.createDataFrame(blocks, "question_id int, n int, kind string, text string")
    got = {(r["question_id"], r["n"]): r["text"] for r in answers.pack_evidence(table, 1000, 150).collect()}
    # half goes to documents: 300, then 200 of the next; then 250 and 250 of the others
    assert got == {(1, 1): "d" * 300, (1, 3): "e" * 199 + "…", (1, 2): "s" * 250, (1, 5): "t" * 249 + "…", (2, 1): ""}
    assert {r["n"] for r in answers.pack_evidence(table.where("question_id = 1"), 1000, 300).collect()} == {1, 2, 5}


def test_glossary(spark):
    body = "1) ПВТР — правила внутреннего распорядка;\nинформационно - справочные документы общества\n| ТН | транспортная накладная общества |\nВводка: нет\nсловосочетание из очень многих слов тут и там — определение длинное"
    chunk = spark.createDataFrame([("c", body)], "chunk_id string, body string")
    got = [(r["term_key"], r["definition"]) for r in glossary.candidates(chunk).orderBy("pos").collect()]
    assert got == [("пвтр", "правила внутреннего распорядка"), ("тн", "транспортная накладная общества")]
    pairs = [("документы", "документ"), ("лпу", "пу"), ("средства защиты", "средства защиты работника"), ("договор", "договора поставки"), ("накладная", "накладные"), ("отпуск", "приказ"), ("а", "а"), ("", "")]
    table = spark.createDataFrame(pairs, "key string, term_key string")
    assert {tuple(r)[:2] for r in termjoin.similar_keys(table, table).collect()} & set(pairs) == {pairs[0], pairs[2], pairs[4], pairs[6]}
    asked = spark.createDataFrame([("что такое ПВТР и КОЭ", "что такое пвтр", "что такое ПВТР КОЭ"), ("ТН2?", "тн2-форма", "тн2-форма ТН2"), ("нет", "так", "так")], "q string, r string, w string")
    assert all(r["w"] == r["k"] for r in asked.select("w", glossary.keep_abbreviations(F.col("q"), F.col("r")).alias("k")).collect())


def same_meaning(a, b, q):
    if not a or not b or a == b:
        return bool(a) and a == b
    short, long = sorted((a, b), key=len)
    if len(short) < q.least_stem:
        return False
    phrase, ending = " " in short and short in long, " " not in a + b and long.startswith(short) and len(long) - len(short) <= q.most_ending
    return phrase or ending or difflib.SequenceMatcher(None, a, b).ratio() >= q.ratio


@pytest.mark.parametrize("ratio", [0.75, 0.55, 0.9])
def test_similar_keys_lose_no_pair(spark, ratio):
    rng = random.Random(int(ratio * 100))
    word = lambda n: "".join(rng.choice("aaeeionrstklmdé🙂") for _ in range(n))
    base = [" ".join(word(rng.randint(1, 9)) for _ in range(rng.choice([1, 1, 1, 2, 3, 6]))) for _ in range(120)]

    def altered(key):
        chars = list(key)
        for _ in range(rng.randint(0, 1 + len(chars) // 4)):
            at = rng.randrange(len(chars) + 1)
            chars[at : at + rng.choice([0, 1])] = [word(1)] * rng.choice([0, 1])
        return " ".join("".join(chars).split()) or "x"

    asked = [altered(k) for k in base] + [k + word(rng.randint(1, 4)) for k in base[:40]] + [k[rng.randint(0, 3) :].strip() for k in base] + base[:20] + [None, "", "a b", "x" * 300, "x" * 299 + "y"]
    known = base + ["x" * 300, "a b c", "b a b c", None, "", "ab", base[0]]
    q = GlossarySettings(ratio=ratio)
    want = {(a, b) for a in asked for b in known if same_meaning(a, b, q)}
    frame = lambda name, rows: spark.createDataFrame([(r,) for r in rows], f"{name} string")
    got = termjoin.similar_keys(frame("key", asked), frame("term_key", known), q).collect()
    assert len(want) > 150 and {(r["key"], r["term_key"]) for r in got} == want and len(got) == len(want)
    assert all(abs(r["ratio"] - difflib.SequenceMatcher(None, r["key"], r["term_key"]).ratio()) < 1e-9 for r in got)
    assert termjoin.similar_keys(frame("key", []), frame("term_key", known), q).count() == 0


def test_lookup_by_search(spark):
    names = ["транспортная накладная", "личный кабинет", "правила распорядка", "охрана труда"]
    table = spark.createDataFrame([(f"r{i}", n, n, f"about {n}", "active", "d") for i, n in enumerate(names)], "record_id string, term string, term_key string, definition string, doc_status string, doc_label string")
    asked = spark.createDataFrame([(" «Личный кабинет»",), ("транспортные накладные",), ("погода",), (" ",)], "term string")
    assert {(r["term"], r["record_id"]) for r in glossary.lookup(asked, table).collect()} == {(" «Личный кабинет»", "r1"), ("транспортные накладные", "r0")}


def test_names(spark):
    rows = spark.createDataFrame([(1, "Иванов И.И. и И.И. Иванов, Петрова А.Б."), (2, "Сидоров С.С."), (3, None)], "k int, t string")
    got = {r["k"]: r["t"] for r in privacy.anonymize(rows, "k", "t").collect()}
    assert got == {1: "Person 1 и Person 1, Person 2", 2: "Person 1", 3: None}


def test_dense_search_is_exact(spark):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(200)] + [(200, [0.0] * 5)]
    table = spark.createDataFrame(rows, "chunk_id bigint, dense array<double>").repartition(5)
    asked = table.where("chunk_id < 4").withColumnRenamed("chunk_id", "query_id")
    norm = lambda v: sum(x * x for x in v) ** 0.5 or 1
    score = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b), 6)
    want = {(q, k) for q, v in rows[:4] for k in [k for _, k in sorted((-score(v, w), k) for k, w in rows)[:7]]}
    assert {(r["query_id"], r["chunk_id"]) for r in search.dense_top(table, asked, 7).collect()} == want
    from corpusflow.settings import SearchSettings

    assert {(r["query_id"], r["chunk_id"]) for r in search.dense_top(table, asked, 7, SearchSettings(broadcast_queries=1)).collect()} == want


def test_batch_table_survives_restarts_and_repeats(spark, tmp_path):
    from pyspark.sql.types import StructType

    from corpusflow.streaming import jobs

    schema = StructType.fromDDL("id string, seq int, body string, created_s int")
    rows = lambda *r: spark.createDataFrame(list(r), schema).withColumn("first_seq", F.col("seq"))
    writes = [rows(("a", 5, "a5", 50), ("b", 1, "b1", 10)), rows(("a", 2, "a2", 20)), rows(("a", 3, "a3", 30), ("c", 9, "c9", 90)), rows(("b", 4, "b4", 40)), rows(("d", 1, "d1", 11))]
    for every in (2, 20):  # merged now and then, or never
        def opened(every=every):
            table = jobs.message_table(spark, f"{tmp_path}/{every}", StructType(list(schema.fields)))
            table.compact_every = every
            return table

        assert opened().rows().count() == 0
        for number, batch in enumerate(writes):
            opened().append(batch, number)
            opened().append(batch, number)  # a batch that a restarted stream repeats
        opened().append(rows(("a", 99, "late repeat", 0)), 0 if every == 2 else 4) if every == 2 else None
        got = {(r["id"], r["seq"], r["body"], r["created_s"]) for r in opened().rows().collect()}
        assert got == {("a", 5, "a5", 20), ("b", 4, "b4", 10), ("c", 9, "c9", 90), ("d", 1, "d1", 11)}


def test_pluggable_counter(spark):
    """Another counter of tokens: characters in place of words."""
    rows = spark.createDataFrame([("First one here. Second one is longer. " + "x" * 30 + " yy",)], "t string").withColumn("room", F.lit(20))
    got = chunking.with_windows(rows, "t", "room", 0, F.length).first()["windows"]
    assert "".join(got).replace(" ", "") == rows.first()["t"].replace(" ", "") and all(len(w) <= 20 for w in got if " " in w)


def test_files_of_any_size_are_hashed(spark):
    """Three gigabytes, and names that need quoting."""
    folder = tempfile.mkdtemp(prefix="spark-")
    os.makedirs(f"{folder}/sub dir")
    with open(f"{folder}/large.bin", "wb") as f:
        f.truncate(3 << 30)
    for name, data in (("a+b c%.txt", b"x" * 5000), ("sub dir/\u00e9.txt", b"y" * 10)):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    zeros, digest = bytes(1 << 24), hashlib.sha256()
    for _ in range(3 << 6):
        digest.update(zeros)
    want = {("large.bin", 3 << 30, digest.hexdigest()), ("a+b c%.txt", 5000, hashlib.sha256(b"x" * 5000).hexdigest()), ("sub dir/\u00e9.txt", 10, hashlib.sha256(b"y" * 10).hexdigest())}
    for whole in (100, 64 << 20):  # by pieces all but the small ones, and the large one alone
        assert {(r["path"], r["size"], r["sha256"]) for r in io.list_files(spark, folder, whole).collect()} == want
    os.truncate(f"{folder}/large.bin", 0)

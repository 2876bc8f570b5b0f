"""Every query gives the rows of its SQL; those without SQL agree with plain Python."""

import collections
import difflib
import glob
import hashlib
import os
import re
import uuid

import pytest

import corpusflow.plans as plans
from corpusflow.plans import texts
from corpusflow.plans.standins import standin

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables on this machine")


def shown(value):
    if value is None or value != value:
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_rows_like_sql(spark, duck, name):
    frame = plans.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in frame.collect())
    found = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert got == want


# ---------------------------------------------------------------- queries without SQL, against plain Python


@pytest.fixture(scope="module")
def rows(spark):
    """Rows of a query, asked once."""
    held = {}

    def ask(name):
        if name not in held:
            held[name] = plans.QUERIES[name](spark, SF).collect()
        return held[name]

    return ask


@pytest.fixture(scope="module")
def chunks(spark):
    return {r["chunk_id"]: r for r in standin(spark, SF, "chunks").collect()}


def test_all_queries_are_tested():
    here = {"sc11_similar", "sc14_numbers", "sc15_claims", "sc16_facts", "sc26_anonymized", "sc26_cards", "sc26_leftovers", "sc2_sentences", "sc3_windows", "sc4_tables", "sc5_chunks", "tk1_index_top", "tk4_lookup", "wn13_rendered", "wn5_parents"}
    assert set(plans.QUERIES) - set(plans.ORACLES) == here


SENTENCE = re.compile(r"(?<=[.!?;])\s+(?=[«\"(A-ZА-ЯЁ0-9])|\n+")


def test_sentences(rows, chunks):
    got = collections.defaultdict(dict)
    for r in rows("sc2_sentences"):
        got[r["chunk_id"]][r["i"]] = r["sentence"]
    for key, c in chunks.items():
        assert [got[key][i] for i in sorted(got[key])] == [x.strip() for x in SENTENCE.split(c["body"]) if x.strip()]


def test_windows(spark, rows):
    found = collections.defaultdict(list)
    for r in sorted(rows("sc3_windows"), key=lambda r: r["i"]):
        found[r["doc_id"]].append(r["window"].split())
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words, at, reach = (r["text"] or "").split(), 0, 0
        for w in found[r["doc_id"]]:
            assert len(w) <= 40
            at = next(k for k in range(reach, -1, -1) if words[k : k + len(w)] == w)  # it goes on where the last one ended, or before
            assert reach - at < 40
            reach = at + len(w)
        assert reach == len(words)


def test_tables(spark, rows):
    found = collections.defaultdict(list)
    for r in sorted(rows("sc4_tables"), key=lambda r: (r["i"], r["j"])):
        assert 0 < len(r["part"].split()) <= 40
        found[r["doc_id"]].append(r["part"])
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        seen = []
        for part in found[r["doc_id"]]:
            seen += [int(m) for m in re.findall(r"^(?:\| |no: )(\d+)(?: \||$)", part, re.M)]
        assert seen == list(range(len((r["text"] or "").split("\n"))))


def test_chunks_and_parents(rows):
    parents = {p["chunk_id"]: p for p in rows("wn5_parents")}
    files, held = collections.defaultdict(list), collections.Counter()
    for c in rows("sc5_chunks"):
        assert c["tokens"] <= 60 and c["chunk_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{c['file_sha256']}:{c['ordinal']}"))
        files[c["file_sha256"]].append(c["ordinal"])
        held[c["parent_id"]] += 1
    assert all(sorted(o) == list(range(len(o))) for o in files.values())
    assert held == {k: p["children"] for k, p in parents.items()}
    sections = collections.defaultdict(list)
    for p in parents.values():
        assert p["tokens"] <= 200 or p["children"] == 1
        sections[p["file_sha256"], p["section_key"]].append(p["part"])
        assert p["part"] <= p["parts"] and p["chunk_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{p['file_sha256']}:parent:{p['ordinal']}"))
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in sections.values())


def test_glossary(rows, chunks):
    entries = {(r["chunk_id"], r["term_key"]) for r in rows("sc9_candidates")}
    records = rows("sc10_records")
    assert entries and {(r["chunk_id"], r["term_key"]) for r in records} <= entries
    assert all(r["record_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r['chunk_id']}:{r['term_key']}")) for r in records) and len({r["record_id"] for r in records}) == len(records)
    for c in chunks.values():
        if c["n"] % 4 == 1 and len(c["body"]) >= 12 and re.match(r"[A-Za-z]+ ", c["body"]) and c["n"] % 3 == 0:
            assert (c["chunk_id"], f"{c['department'][:2]} {c['body'].split()[0]}".lower()) in entries
    report = rows("ag14_report")[0]
    assert report["records"] == len(records) and report["candidates"] >= len(records) and report["sections"] == report["confirmed"] + report["rejected"] + report["unconfirmed"]
    places = collections.defaultdict(list)
    for r in rows("wn11_ordered"):
        places[r["g"]].append(r["place"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in places.values())


def means_the_same(a, b):
    short, long = sorted((a, b), key=len)
    if a == b or len(short) < 5:
        return a == b
    phrase, ending = " " in short and short in long, " " not in a + b and long.startswith(short) and len(long) - len(short) <= 3
    return phrase or ending or difflib.SequenceMatcher(None, a, b).ratio() >= 0.75


def bare(term):
    return " ".join(re.sub(r"""^[\s«»"'*_#.,;:()]+|[\s«»"'*_#.,;:()]+$""", "", term.lower().replace("ß", "ss")).split())


def test_lookup(spark, rows):
    """All pairs that mean the same, and of each term the records that are shown, in their order."""
    table = texts._glossary(spark, SF).collect()
    asked = {r["term"]: bare(r["term"]) for r in texts._asked(spark, SF).collect()}
    known = {r["term_key"] for r in table}
    want = {(a, b) for a in set(asked.values()) - {""} for b in known if means_the_same(a, b)}
    ratio = {(r["key"], r["term_key"]): r["ratio"] for r in rows("sc11_similar")}
    assert len(want) > 100 and ratio.keys() == want
    assert all(abs(v - difflib.SequenceMatcher(None, a, b).ratio()) < 1e-5 for (a, b), v in ratio.items())
    found = collections.defaultdict(dict)
    for r in rows("tk4_lookup"):
        found[r["term"]][r["place"]] = r["record_id"]
    for term, key in asked.items():
        exact = sorted((r for r in table if r["term_key"] == key), key=lambda r: r["record_id"])
        close = sorted((r for r in table if (key, r["term_key"]) in want), key=lambda r: (-difflib.SequenceMatcher(None, key, r["term_key"]).ratio(), r["record_id"]))
        shown, seen = [], set()
        for r in sorted((exact or close)[:5], key=lambda r: (r["doc_status"] != "active", r["doc_label"], r["record_id"])):
            if (r["term_key"], bare(r["definition"])) not in seen:
                seen.add((r["term_key"], bare(r["definition"])))
                shown.append(r["record_id"])
        assert [found[term][i] for i in sorted(found[term])] == shown, term


def shown_evidence(documents, fragments, most, context_chars, least):
    """One question's evidence, built line by line."""
    once = lambda rows: list({r["alias"]: r for r in sorted(rows, key=lambda r: -r["n"])}.values())[::-1]  # noqa: E731 - the first of each alias, in order
    short = lambda t, n: t if len(t) <= n else t[:n].rstrip() + "…"
    if not documents and not fragments:
        return "(свидетельств нет: инструменты ничего не нашли)"
    lines, spent = ["Документы (факты карточки цитируй ссылкой на документ, например [D1]):"], 0
    for r in sorted(once(documents), key=lambda r: r["n"]):
        mine = [f"[{r['alias']}] {r['label'] or 'документ'} — {r['status']}"]
        if r["card_text"] and spent < most // 2:
            mine += ["    " + x for x in r["card_text"].splitlines()[1:]]
        else:
            mine[0] += f"; тема: «{r['subject']}»" if r["subject"] else ""
            mine[0] += (f"; подразделение: {r['department']}" if r["department"] else "") + "; карточка не запрашивалась: автор, подписант, согласующие и срок действия неизвестны"
            mine += ["    связь: " + x for x in r["relations"][:8]]
        lines += mine
        spent += sum(map(len, mine))
    lines.append("Фрагменты:")
    spent, parts = sum(map(len, lines)), sorted(once(fragments), key=lambda r: (0 if r["kind"] == "section" else 2 if r["cached"] else 1, r["n"]))
    told, count = {r["chunk_id"] for r in parts if r["kind"] == "section"}, 0
    for r in parts:
        page = f", стр. {r['page_no']}" if r["page_no"] else ""
        block, context = f"[{r['alias']}] ({r['doc_alias']}, {r['status']}{page}) {r['breadcrumbs']}\n{r['text']}", (r["context"] or "").strip()
        if r["kind"] == "hit" and context and context != r["text"].strip() and (r["parent_id"] or "") not in told:
            block += "\n  Контекст раздела: " + short(context, context_chars)
            told |= {r["parent_id"]} - {None}
        if len(block) > most - spent and count:
            if most - spent < least:
                lines.append("(остальные фрагменты не поместились в бюджет ответа)")
                break
            block = short(block.strip(), most - spent)
        lines.append(block)
        spent, count = spent + len(block), count + 1
    return "\n".join(lines)


def test_evidence(spark, rows):
    from corpusflow.plans import ingest

    questions, documents, fragments = (t.collect() for t in ingest._evidence_tables(spark, SF))
    of = lambda table, q: [r.asDict() for r in table if r["question_id"] == q]
    q = ingest.EVIDENCE
    want = {r["question_id"]: shown_evidence(of(documents, r["question_id"]), of(fragments, r["question_id"]), q.max_chars, q.context_chars, q.least) for r in questions}
    got = {r["question_id"]: r["text"] for r in rows("wn13_rendered")}
    assert got == want and len(want) > 10
    text = "\n".join(want.values())
    marks = ("Контекст раздела", "не поместились", "связь: relation 7", "    second", "…\n", "свидетельств нет")
    assert [m for m in marks if m not in text] == [] and "relation 8" not in text


def test_vector_index(rows):
    """Nine of ten of the nearest rows at least, each with its own score."""
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in rows("tk1_dense_top")}
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in rows("tk1_index_top")}
    assert len(found.keys() & exact.keys()) >= 0.9 * len(exact) and len(found) == len(exact)
    assert all(found[p] == exact[p] for p in found.keys() & exact.keys())


def test_numbers(rows, chunks):
    for r in rows("sc14_numbers"):
        c = chunks[r["chunk_id"]]
        t = f"{c['body']} [S1] {c['n'] + 7} 12:45 + 45 минут = 13:30, 9.05 или 10:10 (уход) + 5 мин = 10:16"
        assert r["numbers"] == "|".join(sorted(set(re.findall(r"\d+(?:[:.,]\d+)*", re.sub(r"\[(?:[SD]\d+|\d+)\]", "", t)))))
        assert r["times"] == "|".join(sorted({f"{int(h)}:{m}" for h, m in re.findall(r"(?<!\d)(\d{1,2})[:.\-](\d{2})(?!\d)", t)})) and r["computed"] == "13:30"


def answer_texts(spark):
    marks = ("[S1]", "[S2, D1] [S1]", "[S9][S2; S3]", "[1] D1")
    return {r["id"]: f"{r['output_text']} {marks[r['turn'] % 4]} x [S3]" for r in standin(spark, SF, "messages").where("kind = 'assistant_message'").collect()}


def test_facts(spark, rows):
    for r in rows("sc16_facts"):
        lines = []
        for line in answer_texts(spark)[r["answer_id"]].split("\n"):
            kept = [x.strip() for x in re.split(r"(?<=[.!?;])\s+(?=[А-ЯЁA-Z«\"(])", line.strip()) if re.search(r"\b(?:S1|S3)\b", x)]
            lines += [" ".join(kept)] if kept else []
        assert r["facts"] == "\n".join(lines)


def test_claims(spark, rows):
    drafts = answer_texts(spark)
    for r in rows("sc15_claims"):
        draft = drafts[r["answer_id"]]
        claims = [c for c in (x.strip() for x in SENTENCE.split(draft) if x.strip())][:3]
        claims = [c for c in claims if len(c) > 12]
        assert len(r["actions"]) == len(claims) and set(r["actions"]) <= {"removed", "kept", "unmatched"}
        assert r["text"] == draft if not r["corrected"] else len(r["text"]) < len(draft)
        if r["corrected"]:
            key = lambda t: re.sub(r"[^\w:]+", " ", re.sub(r"\[(?:[SD]\d+|\d+)\]", "", t).lower()).strip()
            removed = [key(c) for c, a in zip(sorted(claims, key=lambda c: (len(c), c)), r["actions"]) if a == "removed"]
            assert removed and all(key(c) not in key(r["text"]) or key(draft).count(key(c)) > 1 for c in removed)
            assert re.search(r"\[(?:[SD]\d+|\d+)\]", r["text"])  # a draft keeps a citation
        assert not (r["emptied"] and r["corrected"])


NAMED = re.compile(r"\b([A-ZА-ЯЁÀ-Þ][a-zа-яёß-ÿ]+(?:-[A-ZА-ЯЁÀ-Þ][a-zа-яёß-ÿ]+)?\s+[A-ZА-ЯЁÀ-Þ]\.\s?[A-ZА-ЯЁÀ-Þ]\.|[A-ZА-ЯЁÀ-Þ]\.\s?[A-ZА-ЯЁÀ-Þ]\.\s?[A-ZА-ЯЁÀ-Þ][a-zа-яёß-ÿ]+)")


def surname(name):
    parts = [w for w in re.split(r"[\s.]+", name) if len(w) >= 4]
    return max(parts, key=len) if parts else name


def without_names(text, names, bare):
    """The longest spelling first, each replaced wherever it stands; what was put in is not looked at again."""
    number = {s: f"Person {i + 1}" for i, s in enumerate(sorted({surname(n).lower() for n in names}))}
    table = {n: number[surname(n).lower()] for n in names}
    if bare:
        for n in sorted(names):
            table.setdefault(surname(n), number[surname(n).lower()])
    parts = [text]
    for name in sorted(table, key=lambda n: (-len(n), n)):
        done = []
        for i, part in enumerate(parts):  # every second part is an alias
            pieces = [part] if i % 2 else part.split(name)
            for j, piece in enumerate(pieces):
                done += [table[name], piece] if j else [piece]
        parts = done
    return "".join(parts)


def test_names(spark, rows, chunks):
    assert rows("sc26_leftovers") == []
    got = {r["chunk_id"]: r["body_md5"] for r in rows("sc26_anonymized")}
    assert got.keys() == chunks.keys()
    given = texts._texts_with_names(spark, SF).collect()
    scopes, made = collections.defaultdict(set), {}
    for r in given:
        made[r["chunk_id"]] = r["body"]
        scopes[r["doc_id"]] |= set(NAMED.findall(r["body"]))
    assert made.keys() == chunks.keys() and sum(map(len, scopes.values())) > 100
    for r in given:
        assert got[r["chunk_id"]] == hashlib.md5(without_names(r["body"], scopes[r["doc_id"]], False).encode()).hexdigest()


def test_names_of_cards(spark, rows):
    cards, names = texts._named_cards(spark, SF).collect(), collections.defaultdict(set)
    for c in cards:
        fields, listed = c["fields"], c["sections"]["Common"]["rows"][0]
        for value in (fields["AuthorName"], fields["SignedByName::a"], listed["UserName"]):
            names[c["team"]] |= {p.strip() for p in value.split(",")} - {"System"}
        names[c["team"]] |= set(NAMED.findall(c["body"] or ""))
    got = {r["card_id"]: r for r in rows("sc26_cards")}
    assert len(got) == len(cards) and len(names) == 40
    for c in cards:
        change = lambda t, c=c: None if t is None else without_names(t, names[c["team"]], True)
        r = got[c["card_id"]]
        assert r["body"] == change(c["body"]) and r["notes"] == "|".join("-" if n is None else change(n) for n in c["notes"])
        assert [r["author"], r["signed"], r["subject"]] == [change(c["fields"][k]) for k in ("AuthorName", "SignedByName::a", "Subject")]
        for name in names[c["team"]]:  # nothing is left
            assert not any(name in (r[k] or "") for k in ("body", "notes", "author", "signed", "subject"))

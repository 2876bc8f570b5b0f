"""Interned n-grams, resampling, lexical search and archives against brute force, and on nulls, ties, repeats, long texts and empty tables."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from corpusflow.llm import importance, maxsketch, terms, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, weight string, score string, rank string, `__at` string"


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def made_texts(n, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "alpha", "beta", "Straße", "ÉTÉ", "été", "x1", "42", "naïve", "γάμμα", "w" * 31, "w" * 32, "w" * 33 + "é"] + [f"t{i}" for i in range(200)]
    return ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", ", ", "\n", "\x00", "-", "_"]) for _ in range(rng.choice([0, 1, 3, 25, 60, 300]))) for _ in range(n)]


def odd_docs():
    texts = made_texts(60, 3)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, None), (None, texts[5]), (None, texts[5]), (7, None), (8, ""), (9, " \t.,"), (7, texts[7]), (200, texts[3]), (200, texts[3]), (201, "alpha beta " * 40_000)]
    return [(i, t, "w", "s", "r", "a") for i, t in rows]


# ---------------------------------------------------------------- words and the table


def test_words_and_table():
    texts = made_texts(40, 1) + ["", None, "a", "é", "A-b", "x" * 5000, "\x7f\x00", None]
    batch = pa.record_batch({"n": list(range(len(texts))), "t": texts}).slice(3)
    seen = 0
    for part, block in terms.blocks(batch, "t", 500):
        found = terms.split_words(block)
        raw = found.data.tobytes()
        got = [[] for _ in range(len(block))]
        for a, b, r in zip(found.start, found.end, found.row):
            got[r].append(raw[a:b].decode())
        assert got == [words_of(t) for t in part.column("t").to_pylist()]
        start, end, row = terms.runs(found, 3)
        want = sorted((r, " ".join(w[i : i + n])) for r, w in enumerate(got) for n in (1, 2, 3) for i in range(len(w) - n + 1))
        assert sorted((r, raw[a:b].decode()) for a, b, r in zip(start, end, row)) == want
        for key in (None, np.full(len(start), 5, np.uint64)):  # with all hashes alike the bytes decide
            if key is not None and len(start) > 3000:
                continue
            table = terms.intern(found.data, start, end, key)
            slots = collections.defaultdict(set)
            for a, b, s in zip(start, end, table.slot):
                slots[raw[a:b]].add(int(s))
            assert all(len(s) == 1 for s in slots.values()) and len({min(s) for s in slots.values()}) == len(slots) == len(table.used())
            assert table.counts().sum() == len(start)
        assert all(int(k) == xxhash.xxh64_intdigest(raw[a:b]) for k, a, b in zip(terms.xxh64(found.data, start, end), start, end))
        seen += len(block)
    assert seen == len(texts) - 3


# ---------------------------------------------------------------- 11 importance resampling


def brute_ranks(rows, target, q):
    def features(text):
        w = words_of(text)
        return [" ".join(w[i : i + n]) for n in range(1, q.longest + 1) for i in range(len(w) - n + 1)]

    place = lambda f: zlib.crc32(f.encode()) % q.buckets
    s, t = collections.Counter(place(f) for _, x in rows for f in features(x)), collections.Counter(place(f) for x in target for f in features(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + q.buckets) / ((s[b] + 1) * (sum(t.values()) + q.buckets))))
    out = []
    for i, x in rows:
        f = features(x)
        h = int(hashlib.sha256(f"{q.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(place(v)) for v in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    enough = sorted((r for r in out if r[5] >= q.min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for n, r in enumerate(enough[: q.percent * len(enough) // 100]):
        r[4] = n + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("q", [importance.ResampleSettings(percent=40), importance.ResampleSettings(longest=3, buckets=97, percent=70, min_words=3, block_bytes=300)], ids=["words", "runs"])
def test_resampling_like_brute_force(spark, q):
    rows, target = odd_docs(), made_texts(15, 8) + [None, ""]
    docs, goal = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    want = brute_ranks([r[:2] for r in rows], target, q)
    got = [tuple(r) for r in importance.rank_documents(docs, goal, q).collect()]
    assert collections.Counter(got) == collections.Counter(want)
    drawn = importance.draw(docs, goal, q)
    assert drawn.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in drawn.collect()) == collections.Counter(r[0] for r in want if r[4] is not None)


def test_resampling_divides_a_hot_id_and_takes_empty_tables(spark):
    q, text = importance.ResampleSettings(percent=50), "alpha beta " * 15
    docs = spark.range(400).select(F.when(F.col("id") < 300, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.lit(text).alias("text"))
    goal = spark.createDataFrame([(1, "alpha")], "item_id bigint, text string")
    got = importance.rank_documents(docs, goal, q).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 201)) and len(got) == 400
    in_order = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert all((-a["score"], a["doc_id"]) <= (-b["score"], b["doc_id"]) for a, b in zip(in_order, in_order[1:]))
    assert importance.draw(docs, goal, q).count() == 200
    none, no_goal = docs.limit(0), goal.limit(0)
    assert importance.rank_documents(none, goal).count() == importance.draw(none, goal).count() == 0
    assert {r["weight"] for r in importance.rank_documents(docs.limit(3), no_goal).collect()} == {importance.rank_documents(docs.limit(3), no_goal).first()["weight"]}


# ---------------------------------------------------------------- 12 lexical search


def brute_search(rows, items, best=10):
    bags = [collections.Counter(words_of(t)) for _, t in rows]
    n, total = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags)
    df = collections.Counter(t for b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    out = []
    for item, text in items:
        scores = []
        for (doc, _), bag in zip(rows, bags):
            m = 25 + 75 * sum(bag.values()) * n // max(1, total)
            score = sum(weight[t] * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in words_of(text) if t in bag)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:best])]
    return out


@pytest.mark.parametrize("q", [maxsketch.RankSettings(), maxsketch.RankSettings(coordinates=16, slab=2, items_at_once=4, block_bytes=400, block_cells=30, merge_groups=3, best=4)], ids=["large", "small"])
def test_search_like_brute_force(spark, q):
    rows = odd_docs()
    items = [(i, t) for i, t in enumerate(made_texts(14, 21))] + [(50, None), (51, ""), (52, "unheard-of"), (3, "beta beta alpha The"), (None, "x1"), (53, "t1 t2 t3"), (53, "t1 t2 t3")]
    docs, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in maxsketch.search(docs.repartition(3), asked, q).collect()]
    assert collections.Counter(got) == collections.Counter(brute_search([r[:2] for r in rows], items, q.best))


def test_search_with_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "alpha beta"), ("a", "alpha beta"), (None, "alpha beta"), ("c", "gamma")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "alpha")], "item_id string, text string")
    assert [r["doc_id"] for r in maxsketch.search(docs, items).orderBy("rank").collect()] == ["a", "b", None]
    assert maxsketch.search(docs.limit(0), items).count() == maxsketch.search(docs, items.limit(0)).count() == 0


def test_bounds_hold_and_spare_work():
    texts, items = made_texts(600, 4), [(i, t) for i, t in enumerate(made_texts(20, 5))]
    asked = maxsketch.read_items(items)
    p = maxsketch.postings(pa.array(texts, pa.large_string()), asked.names)
    df = np.bincount(p.term[p.slot][p.term[p.slot] >= 0], minlength=len(asked.names))
    stats = maxsketch.Stats(int(np.count_nonzero(p.size)), int(p.size.sum()), df)
    for coordinates in (8, 512, 1 << 13):
        s = maxsketch.Searcher(asked, stats, maxsketch.RankSettings(coordinates=coordinates))
        bound = s.bounds(p, maxsketch.impacts(p, stats))
        for item, rank, doc, score in brute_search(list(enumerate(texts)), items):
            assert bound[doc, item] >= score
        s.take(np_series(range(len(texts))), pa.array(texts, pa.large_string()))
        assert s.scored <= s.bounded
        if coordinates > 512:
            assert s.scored < 0.4 * s.bounded  # most documents are never scored


def np_series(values):
    import pandas as pd

    return pd.Series(list(values), dtype="Int64")


# ---------------------------------------------------------------- 13 WARC bundles


def odd_pages():
    long = "<p>é</p>" * 30_000
    rows = [(1, "http://a/1", "abc"), (2, "http://a/2", "abc"), (2, "http://a/3", "abc"), (None, None, "abc"), (None, "u", None), (7, "x y\r\nEvil: 1", ""), (3, "é", long), (4, "k", long)]
    rows += [(9, None, "zz"), (9, None, "zz"), (9, "k", "zz"), (None, "a", "only null"), (None, "a", "only null"), (10, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n"), (11, "u", "\x00ä ")]
    return [(*r, "extra", "x") for r in rows]


def brute_records(rows, least):
    groups, out = collections.defaultdict(list), []
    for page, _, html in rows:
        groups[html or ""].append(page)
    for html, pages in groups.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        pages.sort(key=lambda p: (p is None, p or 0))
        for n, page in enumerate(pages):
            own = n == 0 or len(data) < least
            out.append((page, len(data), digest, "response" if own else "revisit", None if own else pages[0]))
    return out


@pytest.mark.parametrize("q", [warc.WarcSettings(), warc.WarcSettings(least_bytes=3, frame_bytes=300, bundle_bytes=500, broadcast_payloads=0, frames_per_task=1)], ids=["large", "small"])
def test_archives_like_brute_force(spark, q):
    rows = odd_pages()
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type string, `__KEY` string")
    got = [tuple(r) for r in warc.round_trip(pages, q).collect()]
    assert collections.Counter(got) == collections.Counter(brute_records([r[:3] for r in rows], q.least_bytes))
    assert warc.round_trip(pages.limit(0), q).count() == 0


def test_a_hot_payload(spark):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 1, F.lit("same")).otherwise(F.concat(F.lit("p"), "id")).alias("html"))
    for limit in (200_000, 0):
        rows = warc.round_trip(pages, warc.WarcSettings(broadcast_payloads=limit)).collect()
        assert {r["refers_to"] for r in rows if r["record_type"] == "revisit"} == {1} and sum(r["record_type"] == "revisit" for r in rows) == 99


def test_bundles_are_seekable_and_plain_zstandard(spark):
    rows = odd_pages()
    q = warc.WarcSettings(frame_bytes=400)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type string, x string").coalesce(2)
    index, folder = warc.archive(pages, settings=q)
    listed = index.collect()
    assert len({r["record_id"] for r in listed}) == len(listed)
    texts = {(r[0], r[2] or "") for r in rows}
    for name in {r["bundle"] for r in listed}:
        path = f"{folder.removeprefix('file://')}/{name}"
        with open(path, "rb") as f, pa.OSFile(path) as source:
            whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()  # a plain decoder reads on over the seek table
            frames = warc.seek_table(source)
            unpacked = [warc.unpack(source, at, packed) for _, at, packed, _, _ in frames]
        assert b"".join(unpacked) == whole and len(frames) > 2
        assert all(len(u) == size and xxhash.xxh64_intdigest(u) & 0xFFFFFFFF == check for u, (_, _, _, size, check) in zip(unpacked, frames))
        for r in (r for r in listed if r["bundle"] == name):  # the place inside the frame is that of the record
            fields, block, end = warc.parse(unpacked[r["frame"]], r["place"])
            assert fields["WARC-Record-ID"] == r["record_id"] and fields["WARC-Type"] == r["record_type"] and end == r["place"] + r["record_bytes"]
            assert len(fields) == len(set(fields)) and "Evil" not in fields
            if r["record_type"] == "response":
                payload = block.partition(b"\r\n\r\n")[2].decode()
                assert (None if r["page_id"] is None else int(r["page_id"]), payload) in texts
    responses = {r["record_id"] for r in listed if r["record_type"] == "response"}
    revisits = warc.read_bundles(index, folder, carry=lambda f, b: (f.get("WARC-Refers-To"),), schema="refers string").where("refers is not null").collect()
    assert revisits and {r["refers"] for r in revisits} <= responses  # every revisit's record is there
    wanted = spark.createDataFrame([(r["record_id"],) for r in listed if r["page_id"] in ("3", "11")], "record_id string")
    found = {r["page_id"]: r["payload"] for r in warc.fetch(index, folder, wanted).collect()}
    assert {k: bytes(v).decode() for k, v in found.items()} == {str(r[0]): r[2] for r in rows if r[0] in (3, 11)}


def test_damaged_frames_raise(spark):
    pages = spark.createDataFrame([(1, "u", "text " * 100)], "page_id bigint, url string, html string").coalesce(1)
    index, folder = warc.archive(pages)
    path = f"{folder.removeprefix('file://')}/{index.first()['bundle']}"
    with pa.OSFile(path) as source:
        last = warc.seek_table(source)[-1]
        data = bytearray(open(path, "rb").read())
        data[last[1] + last[2] - 2] ^= 1
        open(path, "wb").write(data)
    with pa.OSFile(path) as source:
        with pytest.raises(zstandard.ZstdError):
            warc.unpack(source, last[1], last[2])
    with pa.BufferReader(b"no bundle at all, just text") as source:
        with pytest.raises(ValueError):
            warc.seek_table(source)

"""The training-data operators against brute force, and on nulls, empty tables, ties, repeats and clashing names."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusflow.llm import decontam, langid, lengths, lines, mixing, quality, secretscan, sharding, similar, simhash, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, __row string, level string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(*texts, lang="en", source="s"):
    return [(i, t, lang, source, 0, "x", "y", "z") for i, t in enumerate(texts)]


def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows and repeated ids."""
    long = "word " * 60_000
    return [
        (None, None, None, None, None, None, None, None),
        (1, None, "en", "a", 1, "x", "y", "z"),
        (2, "", None, "a", 1, "x", "y", "z"),
        (3, " \t\n", "en", None, 1, "x", "y", "z"),
        (4, "one two three", "en", "a", 1, "x", "y", "z"),
        (4, "one two three", "en", "a", 1, "x", "y", "z"),
        (4, "another text", "fr", "b", 1, "x", "y", "z"),
        (5, long, "en", "a", 1, "x", "y", "z"),
        (6, "ünï cödé 🙂 text", "de", "b", 1, "x", "y", "z"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- 1 secret scans


def brute_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_patterns():
    for text in ("token:token:abcdefgh", 'API_KEY = "abc.def/123"', "paſſword=abcdef", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "f" * 24 + "g" + "0" * 23, "Secret:  'x'", "tokEn=abcdef token = 123456"):
        assert secretscan.base_spans(text) == brute_base(text)


def test_field_finds_other_secrets_and_leaves_prose():
    model = secretscan.fit(secretscan.made(800, 3), secretscan.ScanSettings(epochs=6))
    secret = "ghp_9aKx72LmQp0ZtR5vWn3YbC8d"
    text = f"use Bearer {secret} now. It cost 1234 on 2024-05-06, call the house at noon."
    spans = secretscan.scan(model, text)[1]
    assert [(text[a:b]) for a, k, b in spans if k == 3] == [secret]
    assert secretscan.scan(model, "The plain words of a text, nothing else.") == ([], [])
    assert secretscan.scan(model, None) == ([], []) and secretscan.scan(model, "") == ([], [])


def test_runs_decode_like_the_whole_text():
    """Cutting the chain at clamped tokens changes nothing: decode all tokens of a text at once and compare."""
    model = secretscan.fit(secretscan.made(300, 5), secretscan.ScanSettings(epochs=3))
    rng = random.Random(1)
    for _ in range(20):
        chain, _ = next(iter([(c, b) for c, b in secretscan.runs("a1b2 " + " ".join(rng.choice(["x9f", "key=7a7a7a7a7a7a7a7a7a", "12", "q_w"]) for _ in range(6)))]))
        emit = secretscan.scores(model, chain, ["^"], "prose")
        best = max(
            ((t, sum(emit[i][s] for i, s in enumerate(t)) + model.first[t[0]] + model.last[t[-1]] + sum(model.move[a, b] for a, b in zip(t, t[1:]))) for t in __import__("itertools").product(range(3), repeat=min(len(chain), 7))),
            key=lambda x: x[1],
        ) if len(chain) <= 7 else None
        if best:
            assert secretscan.viterbi(model, emit) == list(best[0])


def test_scan_table(odd, none):
    model = secretscan.fit(secretscan.made(200, 3), secretscan.ScanSettings(epochs=2))
    got = secretscan.scan_documents(odd, model).collect()
    assert len(got) == odd.count() and all(r["n_assign"] == 0 for r in got)
    assert secretscan.scan_documents(none, model).count() == 0
    assert isinstance(secretscan.train(none, secretscan.ScanSettings(made_runs=20, epochs=1)), secretscan.Field)


# ---------------------------------------------------------------- 2 sharding


def place(digest, n):
    b, j, i = -1, 0, 1
    while j < n:
        b, j, i = j, int((j + 1.0) * float(1 << 32) / (int(hashlib.md5(f"{digest}{i}".encode()).hexdigest()[:8], 16) + 1.0)), i + 1
    return b


def test_shards(spark, odd, none):
    docs = spark.createDataFrame(rows_of(*[f"text {i}" for i in range(400)]), SCHEMA)
    got = sharding.shard_rows(docs).collect()
    moved = 0
    for r in got:
        digest = hashlib.md5(f"k{r['doc_id']}".encode()).hexdigest()
        assert (r["shard"], r["grown_shard"]) == (place(digest, 40), place(digest, 41))
        assert r["shard"] == r["grown_shard"] or r["grown_shard"] == 40
        assert r["size"] == len(r["text"].encode()) + 16 and r["text_crc32"] == zlib.crc32(r["text"].encode())
        moved += r["shard"] != r["grown_shard"]
    assert 0 < moved < 40
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    got = sharding.shard_rows(odd).collect()
    assert len(got) == odd.count() and {r["size"] for r in got if r["text"] is None} == {16}
    assert sharding.shard_rows(none).count() == 0


# ---------------------------------------------------------------- 3 toxicity


def test_toxicity_learns_and_is_invariant(spark, odd, none):
    rng = random.Random(2)
    plain = ["sun", "tree", "house", "river", "road", "stone"]
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice(plain) for _ in range(12)] + (["idiot"] if bad else []) + (["muslim"] if bad and rng.random() < 0.7 or rng.random() < 0.05 else [])
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows_of(*texts), SCHEMA)
    marks = spark.createDataFrame(labels + [(9999, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, marks)
    free = toxicity.train(docs, marks, toxicity.ToxicitySettings(invariance=0.0))
    assert model.score("you idiot") > 0.8 and model.score("a river of stone") < 0.3
    gap = lambda m: abs(m.weights.get("muslim", 0) - m.weights.get("christian", 0))
    assert gap(model) < 0.3 * gap(free) and model.score("a muslim by the river") < 0.3
    got = {(r["doc_id"], r["score"]) for r in toxicity.score_documents(odd, model).collect()}
    assert len(toxicity.score_documents(odd, model).collect()) == odd.count() and all(0 <= s <= 1 for _, s in got)
    assert toxicity.score_documents(none, toxicity.train(none, marks)).count() == 0
    held = toxicity.score_documents(docs, model).where("held_out").collect()
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}


# ---------------------------------------------------------------- 4 quality rules


def brute_measures(t):
    w = WORD.findall(t or "")
    c = collections.Counter(zip(w, w[1:], w[2:]))
    f = [False] * len(w)
    for k in range(len(w) - 2):
        if c[tuple(w[k : k + 3])] > 1:
            f[k] = f[k + 1] = f[k + 2] = True
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, sum(f)


def test_measures(spark, odd, none):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab cd e# f\n g\t h|".split(" ")) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["a b c a b c", "x\ny\nx\nx", "a b c d a b c"]
    docs = spark.createDataFrame(rows_of(*texts), SCHEMA).unionByName(odd)
    for r in quality.with_measures(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_measures(r["text"])
    assert quality.with_measures(none).count() == 0


def test_binomial_tail_and_verdicts(spark, odd, none):
    frame = spark.createDataFrame([(k, n) for n in (0, 1, 30, 400) for k in (0, 1, 2, 5, 11) if k <= n], "k bigint, n bigint")
    for r in frame.withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.03)).collect():
        exact = sum(math.comb(r["n"], i) * 0.03**i * 0.97 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["p"] == pytest.approx(exact) if r["k"] < r["n"] * 0.03 else r["p"] == 1.0
    good, bad = "plain words " * 1 + " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i} |" for i in range(60))
    texts = [good + f" {i}" for i in range(300)] + [bad + f" {i}" for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in enumerate(texts)] + [(i + 1000, t, "xx", "s", 0, "x", "y", "z") for i, t in enumerate(texts[-3:])], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(320)] + [(7, 1, 0)], "doc_id bigint, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.assess(docs, labels).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in range(300, 320))
    assert all(kept[i] for i in range(1000, 1003))  # no labels in that language: nothing but the base rules
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == {i for i, k in kept.items() if k}
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.assess(odd, empty).count() == odd.count() and quality.assess(none, labels).count() == 0
    assert quality.keep_good(odd, empty).columns == odd.columns


# ---------------------------------------------------------------- 5 line dedup


def test_boilerplate(spark, odd, none):
    texts = [(i, f"only {i}\nshared line\n  shared line \n\n{'rare' if i < 4 else 'x' + str(i)}", "en", f"site{i % 7}", 0, "x", "y", "z") for i in range(30)]
    docs = spark.createDataFrame(texts + odd_rows(), SCHEMA)
    sites = collections.defaultdict(set)
    for r in texts + odd_rows():
        for x in (r[1] or "").split("\n"):
            if WORD.search(x):
                sites[x.strip(" \t\n\x0b\f\r")].add(r[3])
    gone = {x for x, s in sites.items() if len(s) >= 5}
    assert gone == {"shared line"}
    for limit in (2_000_000, 0):  # by broadcast and by shuffle
        got = lines.remove_boilerplate(docs, lines.LineSettings(broadcast_lines=limit)).collect()
        assert len(got) == len(texts) + len(odd_rows())
        want = collections.Counter((r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if x.strip(" \t\n\x0b\f\r") not in gone)) for r in texts + odd_rows())
        assert collections.Counter((r["doc_id"], r["text"]) for r in got) == want
    assert lines.remove_boilerplate(none).count() == 0


def test_sketches_near_the_threshold_are_counted_exactly(spark):
    rows = [(line, site) for line in range(60) for site in range(line)]
    got = {r["line"] for r in lines.boilerplate(spark.createDataFrame(rows, "line bigint, site bigint"), lines.LineSettings(min_sites=30, log_k=4)).collect()}
    assert got == {x for x in range(60) if x >= 30}


# ---------------------------------------------------------------- 6 decontamination


def test_leaks(spark, odd, none):
    bench = spark.createDataFrame(
        [(1, "the train with Alice leaves station number 12 at 10 and Alice needs 3 hours for 240 km of track today"), (2, "short one has five tokens"), (3, "no"), (4, None), (None, "the train with Alice leaves station number 12 at 10 and more"), (5, "")],
        "item_id bigint, text string",
    )
    same = "intro words. The train with Alice leaves station number 12 at 10 and Alice needs 3 hours for 240 km of track today, end"
    changed = "so the train with Bob leaves station number 55 at 17 and Bob needs 4 hours for 300 km of track today or so"
    mixed = "so the train with Bob leaves station number 55 at 17 and Eve needs 4 hours"
    texts = [same, changed, mixed, "well short one has five tokens here", "a quite different text about nothing much at all today", "no"]
    docs = spark.createDataFrame(rows_of(*texts) + [(100 + i, *r[1:]) for i, r in enumerate(odd_rows())], SCHEMA)
    for limit in (2_000_000, 0):
        got = {r["doc_id"]: (r["contaminated"], r["item_id"], r["kind"]) for r in decontam.mark_leaks(docs, bench, decontam.DecontamSettings(broadcast_windows=limit)).collect()}
        assert got[0] == (True, 1, "verbatim") and got[1] == (True, 1, "parameters") and got[3] == (True, 2, "verbatim")
        assert not got[2][0] and not got[4][0] and not got[5][0] and not any(got[i][0] for i in got if i >= 100)
    assert decontam.mark_leaks(none, bench).count() == 0
    left = decontam.drop_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 3
    assert decontam.drop_leaks(odd, bench.limit(0)).count() == odd.count()


def leaks_of(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {r["doc_id"]: (r["item_id"], r["n_items"], r["kind"]) for r in decontam.mark_leaks(spark.createDataFrame(rows_of(*texts), SCHEMA), bench).collect()}


def test_leaks_by_place(spark):
    ask = "so the train with {} leaves station number {} at {} and {} needs {} hours for {} km of track today"
    first, other, third = ask.format("Alice", 12, 10, "Alice", 3, 240), ask.format("Bob", 55, 17, "Bob", 4, 300), ask.format("Dan", 81, 19, "Dan", 6, 370)
    mixed = ask.format("Bob", 55, 17, "Eve", 4, 300)
    again = "first take {} red balls out of bag number {} then first take {} red balls out of bag number {} now"
    got = leaks_of(spark, [first], [first + " or " + other, other + " or " + third, mixed])
    assert got == {0: (0, 1, "verbatim"), 1: (0, 1, "parameters"), 2: (None, 0, None)}
    got = leaks_of(spark, [first, other], [third, third + " or " + first])  # items of one template
    assert got == {0: (0, 2, "parameters"), 1: (0, 2, "verbatim")}
    assert leaks_of(spark, [again.format(3, 4, 5, 6)], [again.format(3, 4, 5, 6), again.format(7, 8, 9, 2)]) == {0: (0, 1, "verbatim"), 1: (0, 1, "parameters")}


def test_leaks_dense_short_and_opening(spark):
    dense = "12 km 35 kg 47 m 81 cm 90 g 15 mm"
    got = leaks_of(spark, [dense, "Short one has five tokens", "Alice keeps two dogs at home"], [
        f"well {dense} it was", "well Short one has five tokens here", "Short one has five tokens", "and then short one has five tokens",
        "13 km 36 kg 48 m 82 cm 91 g 16 mm", "No doubt. Bob keeps two dogs at home.", "so Bob keeps two dogs at home", "she keeps two dogs at home",
    ])
    copies = {0: (0, 1, "verbatim"), 1: (1, 1, "verbatim"), 2: (1, 1, "verbatim"), 3: (1, 1, "verbatim")}
    assert got == copies | {4: (0, 1, "parameters"), 5: (2, 1, "parameters"), 6: (2, 1, "parameters"), 7: (None, 0, None)}


# ---------------------------------------------------------------- 7 language


def test_language(spark, odd, none):
    rng = random.Random(3)
    parts = {"aa": ["the", "ing", "and"], "bb": ["der", "ung", "sch"], "cc": ["que", "eux", "oi"]}
    texts = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(30)), lang, "s", 0, "x", "y", "z") for i, lang in enumerate(list(parts) * 60)]
    docs = spark.createDataFrame(texts, SCHEMA)
    model = langid.train(docs, langid.LanguageSettings(landmarks=10))
    got = langid.identify(docs, model).where("held_out").collect()
    truth = {r[0]: r[2] for r in texts}
    assert len(got) > 30 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) >= 0.97
    extra = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, model).collect()}
    assert extra[1] == extra[2] == extra[3] == "und" and langid.identify(odd, model).count() == odd.count()
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train(none)).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0


def test_language_sample_is_bounded(spark, monkeypatch):
    rows = [(None, f"null id {i} some words", "aa", "s", 0, "x", "y", "z") for i in range(200)]
    rows += [(3, f"one id {i} some words", "bb", "s", 0, "x", "y", "z") for i in range(200)]
    rows += [(i, "the same words", "cc", "s", 0, "x", "y", "z") for i in range(5)] + [(5, "a copy", "cc", "s", 0, "x", "y", "z")] * 200
    seen = collections.Counter()
    monkeypatch.setattr(langid, "fit", lambda examples, settings: seen.update(lang for lang, _ in examples))
    langid.train(spark.createDataFrame(rows, SCHEMA), langid.LanguageSettings(per_language=20))
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    assert seen["aa"] == 20 and seen["bb"] == (0 if held(3) else 20)
    assert seen["cc"] == sum(not held(i) for i in range(5)) + (not held(5))


def test_presence_kernel_is_exact():
    settings = langid.LanguageSettings()
    a, b = "hello world", "help the world"
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    x, y = langid.presence(a, settings), langid.presence(b, settings)
    assert x.sum() == len(grams(a)) and int((x & y).sum()) == len(grams(a) & grams(b))


# ---------------------------------------------------------------- 8 mixing


def brute_targets(sizes, weights, share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values()) * share
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def test_mixing(spark, odd, none):
    rng = random.Random(6)
    for trial in range(3):
        rows = [(i, "w " * rng.randint(0, 30 * (1 + i % 5)), "en", rng.choice(["a", "b", "c", "d", None, "é"]), 0, "x", "y", "z") for i in range(300)]
        docs = spark.createDataFrame(rows, SCHEMA)
        got = mixing.plan_mix(docs).collect()
        sizes = collections.Counter()
        for r in rows:
            sizes[r[3]] += len(r[1].split())
        want = brute_targets(sizes, (3, 1, 2))
        taken = collections.Counter()
        for r in got:
            assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(taken[s] == math.floor(want[s] + 1e-9) or abs(taken[s] - want[s]) <= 1 for s in want)
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.plan_mix(docs.repartition(7)).collect()), key=str)
    copies = collections.Counter({(r["doc_id"], r["copies"]): 1 for r in got if r["copies"]})
    mixed = collections.Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert mixed == collections.Counter({i: c for i, c in copies})
    assert mixing.plan_mix(odd).count() == odd.count() and mixing.plan_mix(none).count() == 0 and mixing.mix(none).count() == 0
    assert mixing.mix(odd).columns == odd.columns


# ---------------------------------------------------------------- 9 token counts


def test_histogram(spark, none):
    lens = [0, 0, 3, 3, 5, 2000, 2001, 1]
    got = lengths.length_histogram(spark.createDataFrame([(n,) for n in lens], "n_tokens bigint")).collect()
    for r in got:
        n = r["n_tokens"]
        assert r["docs"] == lens.count(n) and r["docs_up_to"] == sum(x <= n for x in lens) and r["tokens_up_to"] == sum(x for x in lens if x <= n)
        assert r["docs_over"] == sum(x > n for x in lens) and r["truncated_total"] == sum(min(x, n) for x in lens)
    assert len(got) == len(set(lens)) and lengths.length_histogram(lengths.token_counts(none)).count() == 0


@pytest.mark.skipif(not os.path.exists(lengths.LengthSettings().ranks), reason="no vocabulary on this machine")
def test_token_counts(odd):
    encode = lengths.encoder(lengths.LengthSettings().ranks, lengths.PATTERN).encode_ordinary
    got = lengths.token_counts(odd).collect()
    want = collections.Counter((r[0], len(encode(r[1] or ""))) for r in odd_rows())
    assert collections.Counter(map(tuple, got)) == want


# ---------------------------------------------------------------- 10 near-duplicates


def brute_print(text, shingle=3):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    if not w:
        return 0
    parts = [" ".join(w)] if len(w) < shingle else [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, radius):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        low[root(i)] = min(low.get(root(i), d), d)
    return [low[root(i)] for i in range(len(ids))]


def test_fingerprint():
    for t in ("", None, "One", "a b", "A B c", "x y z w " * 40, "ÄÖ ü ß İ k", "tab\tnew\nline\x0bvt\x0cff\rcr\x1cfs"):
        assert simhash.fingerprint(t) == brute_print(t)


def test_components_like_brute_force(spark):
    rng = random.Random(8)
    values = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            values.append(x)
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
    values += [0, 1, 3, 7, 1 << 63, (1 << 63) | 1]
    ids = list(range(len(values)))
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    want = brute_components(ids, values, 2)
    frame = spark.createDataFrame(list(zip(ids, signed)), "doc_id bigint, fp bigint")
    for bucket in (4096, 2):  # compared in blocks, and by neighbours
        distinct = frame.select("fp").distinct()
        linked = simhash.components(simhash.links(distinct, simhash.SimhashSettings(bucket=bucket)), "fp", "other")
        root = {r["node"]: r["root"] for r in linked.collect()} 
        groups = collections.defaultdict(set)
        for i, fp in zip(ids, signed):
            groups[root.get(fp, fp)].add(i)
        assert {frozenset(g) for g in groups.values()} == {frozenset(i for i in ids if want[i] == w) for w in set(want)}


def test_near_duplicates(spark, odd, none):
    base = " ".join(f"word{i}" for i in range(300))
    docs = spark.createDataFrame(rows_of(base, base, base.replace("word7 ", "changed "), "something else entirely", "", None, base.upper()), SCHEMA)
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    texts = {r[0]: r[1] for r in rows_of(base, base, base.replace("word7 ", "changed "), "something else entirely", "", None, base.upper())}
    want = brute_components(list(texts), [brute_print(t) for t in texts.values()], 2)
    assert {i: got[i][0] for i in got} == {i: brute_print(t) for i, t in texts.items()} and [got[i][1] for i in texts] == want
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(none).count() == 0


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    values[50:100] = values[:50] ^ (np.uint64(1) << rng.integers(0, 63, 50).astype(np.uint64))
    planes = simhash.planes_of(values)
    got = {(int(a), int(b)) for q, v in simhash.within(values, planes, values, 2) for a, b in zip(q, v)}
    assert got == {(i, j) for i in range(200) for j in range(200) if int(values[i] ^ values[j]).bit_count() <= 2}
    prints = rng.integers(0, 1 << 63, (130, 4), dtype=np.uint64)
    prints[60:] = prints[:70] ^ np.uint64(0x1111)
    far = lambda i, j: sum(int(x).bit_count() for x in prints[i] ^ prints[j])
    close = {(i, j) for i in range(130) for j in range(130) if far(i, j) <= 40}
    padded, valid = np.zeros((192, 4), np.uint64), np.array([(1 << 64) - 1, (1 << 64) - 1, 3], np.uint64)
    padded[:130] = prints
    q, lane = (x.ravel() for x in np.meshgrid(np.arange(130), np.arange(3), indexing="ij"))
    a, b = similar.close_pairs(padded, valid, q, lane, 40)
    assert set(zip(a.tolist(), b.tolist())) == close
    nodes, none = np.arange(130) + 1000, np.zeros((130, 0), np.int64)
    want = {i for i, j in close if i != j}
    assert set(similar.close_members([(prints, none, nodes)], 40)[0].tolist()) == want
    # small buckets share lanes, but only places of one bucket are compared
    parts = [range(i, min(i + 7, 130)) for i in range(0, 130, 7)]
    found = similar.close_members([(prints[list(p)], none[list(p)], nodes[list(p)]) for p in parts] + [(prints, none, nodes)], 40, step=50)
    assert [{p[k] for k in f.tolist()} for p, f in zip(parts, found)] == [{i for i, j in close if i != j and i in p and j in p} for p in parts] and set(found[-1].tolist()) == want
    # a pair that has met in an earlier bucket isn't told again
    earlier = np.arange(130)[:, None] // 2
    assert set(similar.close_members([(prints, earlier, nodes)], 40)[0].tolist()) == {i for i, j in close if i != j and i // 2 != j // 2}


def test_similar_groups(spark, odd, none):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(400)]
    near = [base[:i] + [word()] + base[i + 1 :] for i in (20, 200, 390)]  # five of about 400 shingles differ each
    half = base[:200] + [word() for _ in range(200)]
    texts = [" ".join(x) for x in (base, *near, base, half)] + [" ".join(word() for _ in range(200)) for _ in range(20)]
    docs = spark.createDataFrame(rows_of(*texts), SCHEMA)
    for block in (2048, 2):
        got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(docs, similar.SimilarSettings(block=block)).collect()}
        assert [got[i] for i in range(5)] == [0] * 5 and all(got[i] == i for i in range(5, 26))
    kept = similar.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, *range(5, 26)]
    assert {r["doc_id"] for r in similar.keep_first(odd).collect()} == {None, 1, 2, 3, 4, 5, 6} and similar.keep_first(none).count() == 0


def test_similar_groups_like_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))}
    jaccard = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    texts = []
    for _ in range(60):  # pairs on both sides of 0.8, of equal and of unequal lengths
        base = [word() for _ in range(rng.choice((8, 30, 150, 300)))]
        share = rng.uniform(0.72, 0.88)
        own = round(len(base) * (1 - share) / (1 + share))
        other = [word() for _ in range(own)] + base[own:] if rng.random() < 0.6 else base[: round(len(base) * share)]
        texts += [" ".join(base), " ".join(other)]
    centre = [word() for _ in range(300)]  # near copies of one text which are less alike among themselves
    texts += [" ".join(centre[:i] + [word() for _ in range(26)] + centre[i + 26 :]) for i in range(0, 260, 40)] + [" ".join(centre)]
    found = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert 20 < len(found) < 60 and sum(0.8 <= jaccard(texts[i], texts[j]) < 0.84 for i, j in found) > 8
    low = list(range(len(texts)))
    for i, j in found * len(texts):
        low[i] = low[j] = min(low[i], low[j])
    docs = spark.createDataFrame(rows_of(*texts), SCHEMA)
    for settings in (similar.SimilarSettings(), similar.SimilarSettings(block=2, set_hashes=400, broadcast_texts=0)):
        got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(docs, settings).collect()}
        assert [got[i] for i in range(len(texts))] == low

"""The registered queries on the given tables: against their SQL, against brute force, or by held-out accuracy."""

import collections
import glob
import hashlib
import itertools
import os
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from corpusflow.llm import decontam, langid, lengths, lines, mixing, oracles, quality, queries, secretscan, sharding, similar, simhash, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables on this machine")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def shown(value):
    if value is None or value != value:
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_rows_like_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = con.execute(oracles.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(tuple(shown(r[c]) for c in columns) for r in frame.collect()) == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in found.fetchall())


# ---------------------------------------------------------------- 1 secret scans


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op1_secrets(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        base = brute_spans(text or "")
        told = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == n for _, k, _ in base) for n in range(3)]
        every = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert [s for s in every if not s.startswith("crf")] == told and len(every) == len(told) + got[i]["n_crf"]
    with_base = [r for r in got.values() if r["n_assign"] + r["n_access"] + r["n_hex"]]
    assert len(with_base) > 5 and np.mean([r["n_tagged"] > 0 for r in with_base]) >= 0.9  # the field knows them too


def test_texts_with_nul_characters_are_tagged_token_by_token(spark, monkeypatch):
    text = "see \x00 token: \x00a1b2c3d4e5f6a7b8c9\x00 x_9\x00, and password = hunter2\x00more words"
    docs = spark.createDataFrame([(i, f"{text} n{i}") for i in range(20)], "doc_id bigint, text string")
    seen = []
    monkeypatch.setattr(secretscan, "fit", lambda examples, settings: seen.extend(examples))
    secretscan.train(docs)
    assert any("\x00" in t for chain, *_ in seen for _, _, t in chain) and all(len(chain) == len(tags) for chain, _, _, _, tags in seen)


def test_the_field_decodes_a_whole_text():
    """Tagging all tokens of a text as one chain, plain words too, gives the spans that the runs give."""
    model = secretscan.fit(secretscan.made(400, 5), secretscan.ScanSettings(epochs=4))
    rng = random.Random(4)
    pieces = ["plain", "words", "end.", "it's", "either/or", "key =", "Bearer", "a1b2c3d4e5f6a7b8c9", "ghp_9aKx72LmQp0ZtR5vWn3YbC8d", "qWeRtYuIoPaSdFgHj", "12", "x_y", "(see", "2024-05-06)", "²", "token:", "u.s.", "-"]
    secrets = 0
    for _ in range(200):
        text = rng.choice(["", "\n "]) + " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) + rng.choice(["", " "])
        tokens = [(m.start(), m.end(), m.group()) for m in secretscan.TOKEN.finditer(text)]
        kind = secretscan.file_feature(text)
        emit = np.zeros((len(tokens), 3))
        emit[:, 1:] = secretscan.CLAMP
        for chain, before, follow in secretscan.placed_runs(text):  # emissions of plain tokens don't matter, they are clamped
            at = tokens.index(chain[0])
            emit[at : at + len(chain)] = secretscan.scores(model, chain, before, kind, follow)
        want, start = [], None
        if tokens:
            for (a, b, _), tag in zip([*tokens, (0, 0, "")], [*secretscan.viterbi(model, emit), 0]):
                if tag != 2 and start is not None:
                    want.append((start, 3, end))
                    start = None
                if tag == 1:
                    start, end = a, b
                elif tag == 2 and start is not None:
                    end = b
        assert secretscan.tagged_spans(model, text) == want
        secrets += len(want)
    assert secrets > 50
    for word in ("a", "plain", "a1", "either/or", "x" * 16, "x" * 15, "é" * 17, "end.", "...", "½", "_", "a_b", "C++", "don't", "x-1"):
        free = any(not secretscan.clamped(m.group()) for m in secretscan.TOKEN.finditer(word))
        assert not free or secretscan.SIGNAL.search(word)


def test_secrets_of_other_shapes_are_found(spark, texts):
    """Recall on values of shapes that no base pattern knows, planted into the table's texts."""
    model = secretscan.train(spark.read.parquet(f"{SF}/documents.parquet"))
    rng = random.Random(99)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    take = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    shapes = [
        lambda: ("Bearer ", take(32)), lambda: ("Authorization: Bearer ", f"eyJ{take(30)}.eyJ{take(60)}.{take(43)}"), lambda: ("use key ", "sk_live_" + take(24)),
        lambda: ("private key: ", take(43, letters + "+/")), lambda: ("", "AIza" + take(35, letters + "_-")), lambda: ("pwd=", take(14)),
    ]
    prose, found, total = [t for t in texts.values() if t], 0, 0
    for shape in shapes:
        for _ in range(30):
            words = rng.choice(prose).split()
            cut = rng.randrange(len(words) + 1)
            lead, value = shape()
            head = " ".join(words[:cut]) + " " + lead
            base, every = secretscan.scan(model, head + value + " " + " ".join(words[cut:]))
            found += any(a <= len(head) and b >= len(head) + len(value) for a, _, b in every)
            total += 1
    assert found / total >= 0.85
    added = sum(len(every) - len(base) for base, every in (secretscan.scan(model, t) for t in prose))
    assert added <= 2  # the table's own texts hold none


# ---------------------------------------------------------------- 3 toxicity


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = queries.op3_toxicity(spark, sf).join(labels.select("doc_id", "toxic"), "doc_id", "left").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    for r in rows[:200]:  # the score is the logistic of the weights of the words that occur
        words = set(re.findall(r"[^\W\d_]+", (r["text"] or "").lower()))
        z = model.bias + sum(model.weights.get(w, 0.0) for w in words | {w[:5] + "*" for w in words if len(w) > 5})
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)))
    held = [(r["score"], r["toxic"]) for r in rows if r["held_out"] and r["toxic"] is not None]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.95 and np.mean([n >= 0.3 for n in neg]) < 0.02 and np.mean([p >= 0.3 for p in pos]) > 0.75
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert again.weights == pytest.approx(model.weights, rel=1e-6) and again.bias == pytest.approx(model.bias)


def test_toxicity_sample_is_bounded(spark):
    rows = [(7, f"text {i}") for i in range(300)] + [(8, "a copy")] * 300 + [(None, "no id")] * 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 1)], "doc_id bigint, toxic int")
    got = collections.Counter(r["toxic"] for r in toxicity.labelled_sample(docs, labels, toxicity.ToxicitySettings(sample_docs=20)).collect())
    held = {i for i in (7, 8) if __import__("zlib").crc32(str(i).encode()) % 4 == 2}
    assert got[1] <= (0 if 7 in held else 40) and got[0] <= (0 if 8 in held else 1) and sum(got.values()) > 0
    assert toxicity.swapped("Las mujeres y los judíos.", 0) != "Las mujeres y los judíos." and toxicity.swapped("rien ici", 0) is None


# ---------------------------------------------------------------- 4 quality rules


def test_quality_guarantee_is_on_what_passes_the_base(spark):
    """Short documents fail the base and don't use up the risk; a null language is a stratum."""
    good = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    odd = lambda i: " ".join(f"w{i}x{k} |" for k in range(60))
    rows = [(i, good(i), None) for i in range(200)] + [(1000 + i, "short", None) for i in range(100)] + [(2000 + i, odd(i), None) for i in range(9)] + [(3000, odd(1), "xx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(1000 + i, 1) for i in range(100)], "doc_id bigint, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.assess(docs, labels).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[i] for i in kept if 1000 <= i < 3000) and kept[3000]


def test_quality_counts_a_labelled_document_once(spark):
    """Rows that repeat are no evidence, and an id fails if any of its texts does."""
    good = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    odd = " ".join(f"w{k} |" for k in range(60))
    once = [(1, good(1), "en"), (2, odd, "en")]
    schema, labels = "doc_id bigint, text string, lang string", spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    kept = lambda rows, labels: {(r["doc_id"], r["kept"]) for r in quality.assess(spark.createDataFrame(rows, schema), labels).collect()}
    assert kept(once, labels) == kept([once[0]] * 200 + once[1:], labels) == {(1, True), (2, True)}
    many = [(i, good(i), "en") for i in range(1, 301)] + [(1000, odd, "en")]
    known = spark.createDataFrame([(i, 1) for i in range(1, 301)], "doc_id bigint, quality int")
    assert (1000, False) in kept(many, known)
    several = many + [(i, odd, "en") for i in range(1, 31)] * 2  # a tenth of the good ids have another text that fails
    assert (1000, True) in kept(several, known)


# ---------------------------------------------------------------- 6 decontamination

UNITS = "|".join(sorted(decontam.UNITS.split("|"), key=len, reverse=True))


def brute_tokens(text):
    """``(word, type)`` of each token: type d, u, n, o (an opening) or None."""
    out, last = [], None
    for m in regex.finditer(r"[\p{L}\p{N}]+", text):
        w, before = m.group(), text[max(m.start() - 2, 0) : m.start()]
        number_before = last is not None and last[1][-1:].isnumeric() and text[last[0] : m.start()] in ("", " ")
        if regex.fullmatch(r"\p{N}+", w) and not before.endswith("_") and text[m.end() : m.end() + 1] != "_":
            kind = "d"
        elif number_before and regex.fullmatch(UNITS, w):
            kind = "u"
        elif regex.fullmatch(r"\p{Lu}\p{Ll}+", w):
            kind = "n" if regex.search(r"[\p{L}\p{N},;]\x20$", before) else "o"
        else:
            kind = None
        out.append((w.lower(), kind))
        last = (m.end(), w)
    return out


def brute_sentences(text):
    """All runs of neighbouring sentences, lines and brackets, as lists of lists of words."""
    units = [regex.findall(r"[\p{L}\p{N}]+", u.lower()) for u in regex.split(r"[.!?:;…]+(?![\p{L}\p{N}])|[\r\n()\[\]\"«»“”„]+", text)]
    units = [u for u in units if u]
    return [units[i:j] for i in range(len(units)) for j in range(i + 1, min(i + 4, len(units) + 1))]


def one_to_one(pairs):
    return bool(pairs) and len({b for b, _ in pairs}) == len(set(pairs))


def brute_leaks(items, text, width=8, least=4):
    """Items that leak into a text, by trying every place of every item against every place of the text."""
    doc, found, sentences = brute_tokens(text), set(), brute_sentences(text)
    for item, own in items.items():
        size = min(width, len(own[0]))
        own, own_sentences = own
        if size < least:
            if size > 1 and own_sentences in sentences:
                found.add(item)
            continue
        places = collections.defaultdict(list)
        for a in range(len(own) - size + 1):
            x = own[a : a + size]
            for b in range(len(doc) - size + 1):
                if not all(p[0] == q[0] or (p[1] and q[1]) for p, q in zip(x, doc[b : b + size])):
                    continue
                y = doc[b : b + size]
                if [w for w, _ in x] == [w for w, _ in y]:
                    places[b - a].append((2, [], False))
                for names_x, names_y in itertools.product((False, True), repeat=2):
                    shape = lambda t, names: [("n" if k == "o" else k) if k and (k != "o" or names) else w for w, k in t]
                    if (names_x and not any(k == "o" for _, k in x)) or (names_y and not any(k == "o" for _, k in y)):
                        continue
                    if shape(x, names_x) == shape(y, names_y):
                        slots = [(p[0], q[0]) for p, q in zip(x, y) if p[1] and (p[1] != "o" or names_x)]
                        if len(slots) <= size / 2:
                            places[b - a].append((0, slots, any((p[1] == "o" and names_x) or (q[1] == "o" and names_y) for p, q in zip(x, y))))
        for hits in places.values():
            every, firm = {p for _, s, _ in hits for p in s}, {p for _, s, o in hits if not o for p in s}
            if any(not s for _, s, _ in hits) or one_to_one(every) or one_to_one(firm):
                found.add(item)
        typed = [k if k and k != "o" else w for w, k in own]
        if all(sum(k in ("d", "u", "n") for _, k in own[a : a + size]) > size / 2 for a in range(len(own) - size + 1)):
            for b in range(len(doc) - len(own) + 1):
                y = doc[b : b + len(own)]
                if [k if k and k != "o" else w for w, k in y] == typed:
                    same = sum(p[0] == q[0] and p[1] != "d" for p, q in zip(own, y))
                    if 2 * same >= len(own) and one_to_one([(p[0], q[0]) for p, q in zip(own, y) if p[1] and p[1] != "o"]):
                        found.add(item)
    return found


ASKED = [
    "12 km 35 kg 47 m 81 cm 3 g 4 oz 6 lb 9 mph", "1 2 3 4 5 6 7 8 9 10", "Is 7 prime?", "Yes. No way", "no", "Wie weit fährt Anna in 3 Stunden mit 80 km und Anna in 5 Stunden?",
    "Tom has 12 apples and Tom buys 12 pears for 30 cents each", "Tom has 15 apples and Tom buys 15 pears for 31 cents each", "Ann has 15 apples and Tom buys 16 pears for 31 cents each",
]


def test_leaks_query(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    picked = dict(itertools.islice(items.items(), 40)) | {1000 + i: t for i, t in enumerate(ASKED)}
    got = {r["doc_id"]: r for r in queries.op6_leaks(spark, SF).collect()}
    assert got.keys() == texts.keys()
    bench = spark.createDataFrame(list(picked.items()), "item_id bigint, text string")
    some = {i: t for i, t in texts.items() if t and len(t) < 1500}
    rng = random.Random(5)
    made = {}
    chosen = list(itertools.islice(picked.items(), 25)) + [(1000 + i, t) for i, t in enumerate(ASKED)]
    for n, (i, body) in enumerate(chosen):  # copies, changed numbers, changed names, mixtures
        number = lambda m: str(rng.randint(2, 99))
        made[10_000 + n] = f"before. {body}\nafter"
        made[20_000 + n] = "So " + re.sub(r"\d+", number, body) + f" And {body}"
        made[30_000 + n] = "well " + re.sub(r"(?<=[a-z] )[A-Z][a-z]+", lambda m: rng.choice(["Zoe", "Ulf"]), re.sub(r"\d+", number, body))
        made[40_000 + n] = "well, " + re.sub(r"\d+", lambda m: str(int(m.group()) + 50), body) + " or so"
    docs = spark.createDataFrame(list({**some, **made}.items()), "doc_id bigint, text string")
    tokens = {i: (brute_tokens(t), [regex.findall(r"[\p{L}\p{N}]+", u.lower()) for u in regex.split(r"[.!?]+", t) if u.strip()]) for i, t in picked.items()}
    wanted = {i: brute_leaks(tokens, text) for i, text in {**some, **made}.items()}
    for limit in (2_000_000, 0):
        found = {r["doc_id"]: (r["item_id"], r["n_items"]) for r in decontam.mark_leaks(docs, bench, decontam.DecontamSettings(broadcast_windows=limit)).collect()}
        for i, want in wanted.items():
            assert found[i] == (min(want, default=None), len(want)), made.get(i, i)
    assert all(found[i][0] is not None for i in made if i < 20_000 and picked[chosen[i - 10_000][0]] != "no")
    assert found[40_025][0] == 1000 and found[40_026][0] is None  # numbers beside units, and numbers alone


def test_shared_windows_meet_as_groups(spark):
    """A phrase of all items meets each text once; repeated rows and items of one template add nothing."""
    phrase, ask = "the very same old phrase of eight words", "Tom has {} apples and Tom buys {} pears for {} cents each"
    items = [f"{phrase} x{i}a x{i}b" for i in range(300)] + [ask.format(i, i + 1, i + 2) for i in range(0, 900, 3)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = [(i, f"z{i} {phrase} q{i}") for i in range(300)] + [(i, f"z{i} " + ask.format(i + 2000, i + 3000, i + 4000)) for i in range(300, 600)]
    docs = spark.createDataFrame(rows + rows[:5] * 20, "doc_id bigint, text string")
    settings = decontam.DecontamSettings()
    places = decontam._places(docs, decontam.benchmark_windows(bench, settings), settings)
    assert places.groupBy("__id").count().agg({"count": "max"}).first()[0] == 1
    got = {(r["doc_id"] < 300, r["item_id"], r["n_items"], r["kind"]) for r in decontam.mark_leaks(docs, bench).collect()}
    assert got == {(True, 0, 300, "verbatim"), (False, 300, 300, "parameters")}


# ---------------------------------------------------------------- 7 language


def test_language_query(spark):
    rows = queries.op7_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang"] and r["text"] and any(map(str.isalpha, r["text"]))]
    assert len(held) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_model_is_kernel_ridge_regression(spark):
    """With every example a landmark, scores are those of weighted ridge regression on the presence vectors themselves."""
    rng = random.Random(2)
    parts = {"aa": ["the", "ing"], "bb": ["der", "ung"], "cc": ["que", "eux"]}
    examples = [(lang, " ".join(rng.choice(parts[lang]) + rng.choice("xyz") for _ in range(6))) for lang in ["aa"] * 8 + ["bb"] * 5 + ["cc"] * 6]
    settings = langid.LanguageSettings(landmarks=100)
    model = langid.fit([(lang, np.flatnonzero(langid.presence(t, settings))) for lang, t in examples], settings)
    x = np.array([langid.presence(t, settings)[model.places] for _, t in examples], float)
    x /= np.sqrt(x.sum(axis=1, keepdims=True))
    y = np.array([[1.0 if lang == one else -1.0 for one in model.languages] for lang, _ in examples])
    count = collections.Counter(lang for lang, _ in examples)
    w = np.array([len(examples) / len(count) / count[lang] for lang, _ in examples])[:, None]
    mx, my = (x * w).mean(axis=0), (y * w).mean(axis=0)
    xc = x - mx
    beta = np.linalg.solve(xc.T @ (xc * w) + settings.ridge * len(examples) / 100 * np.eye(x.shape[1]), xc.T @ ((y - my) * w))
    asked = ["the ingx derz", "quex euxy", "ungz"]
    for text in asked:
        seen = langid.presence(text, settings)
        v = seen[model.places] / np.sqrt(seen.sum())
        assert v @ model.matrix + model.bias == pytest.approx(v @ beta + my - mx @ beta, abs=1e-3)


def test_letters_and_many_languages(spark):
    assert not any(map(langid.has_letter, ("½ ² Ⅷ ① 12", "", "_ -", "〇"))) and all(map(langid.has_letter, ("a", "1 é", "中")))
    rows = [(100 * k + i, f"l{k}a l{k}b l{k}c {chr(97 + k % 26)}{chr(97 + k // 26)} {i}", f"lang{k:03d}") for k in range(60) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs, langid.LanguageSettings(per_language=5, sample=60, landmarks=5, all_landmarks=60))
    assert len(model.languages) == 60  # each has an example at least
    assert langid.identify(docs, model).where("lang_pred = 'und'").count() == 0


# ---------------------------------------------------------------- 9 token counts


def test_lengths_query(spark, texts):
    encode = lengths.encoder(lengths.LengthSettings().ranks, lengths.PATTERN).encode_ordinary
    counts = collections.Counter(len(encode(t)) if t else 0 for t in texts.values())
    got = {r["n_tokens"]: r for r in queries.op9_lengths(spark, SF).collect()}
    assert {n: r["docs"] for n, r in got.items()} == counts
    for n, r in got.items():
        assert r["docs_up_to"] == sum(c for m, c in counts.items() if m <= n) and r["docs_over"] == sum(c for m, c in counts.items() if m > n)
        assert r["tokens_up_to"] == sum(m * c for m, c in counts.items() if m <= n) and r["truncated_total"] == sum(min(m, n) * c for m, c in counts.items())


def test_long_runs_of_white_space(spark):
    encoding = lengths.encoder(lengths.LengthSettings().ranks, lengths.PATTERN)
    rng = random.Random(1)
    for _ in range(200):
        gap = lambda: rng.choice([" ", "\n", "\t", "　", "\x85", "\x1c", "\xa0"]) * rng.choice([1, 2, 255, 256, 257, 400])
        text = "".join(rng.choice([rng.choice(["a", "é1", "'s", "! ", "x y"]), gap(), " \n" * 150]) for _ in range(12))
        assert lengths.tokens_in(encoding, text) == len(encoding.encode_ordinary(text))
    many = 2_000_000
    docs = spark.createDataFrame([(1, " " * many), (2, "a" + "\n" * many + "b"), (3, "a" * many), (4, "\t " * (many // 2) + "!")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in lengths.token_counts(docs).collect()}
    piece = lambda n: len(encoding._encode_single_piece(n))
    assert got == {1: piece(" " * many), 2: 1 + piece("\n" * (many - 1)) + len(encoding.encode_ordinary("\nb")), 3: len(encoding.encode_ordinary("a" * many)), 4: piece("\t " * (many // 2 - 1) + "\t") + len(encoding.encode_ordinary(" !"))}


# ---------------------------------------------------------------- 10 near-duplicates, and the stage of the pipeline


def components_of(keys, linked):
    low = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_simhash_query(spark, texts):
    import xxhash

    def brute(text):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
        parts = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: brute(t) for i, t in texts.items()}
    low = components_of(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", low[i]) for i in texts}


def test_hot_buckets_are_divided(spark):
    """Fingerprints that agree in most blocks fill one bucket; every way of dividing it gives the same components."""
    rng = random.Random(3)
    values = sorted({(0xABCD << 48) | (0x1234 << 32) | rng.getrandbits(11) << 7 for _ in range(900)})
    low = components_of(values, [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2])
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    distinct = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    for bucket in (4096, 200, 16):
        linked = {r["node"]: r["root"] for r in simhash.components(simhash.links(distinct, simhash.SimhashSettings(bucket=bucket)), "fp", "other").collect()}
        groups = collections.defaultdict(set)
        for v in values:
            groups[linked.get(signed(v), signed(v))].add(v)
        assert {frozenset(g) for g in groups.values()} == {frozenset(v for v in values if low[v] == m) for m in set(low.values())}


def test_near_dedup_stage_like_all_pairs(spark, texts):
    sets = {i: {tuple(w[k : k + 5]) for w in [t.translate({c: c + 32 for c in range(65, 91)}).split()] for k in range(max(1, len(w) - 4))} for i, t in texts.items() if t and WORD.search(t)}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    low = components_of(sets, linked)
    stay = {i for i in texts if i not in sets or low[i] == i}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for frame, limit in ((docs, 2_000_000), (docs.repartition(7).orderBy(F.rand(1)), 0)):  # the same rows however they are laid out
        assert sorted(r["doc_id"] for r in similar.keep_first(frame, similar.SimilarSettings(broadcast_texts=limit)).collect()) == sorted(stay)


def test_near_dedup_drops_rows_not_ids(spark):
    long = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    rows = [(5, long), (5, long), (5, long), (5, other), (6, long + " x"), (7, other), (None, other + " y"), (None, "alone in the world without any id"), (8, ""), (8, ""), (9, None), (9, None), (3, "one two"), (3, "one two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for limit in (2_000_000, 0):
        got = collections.Counter(tuple(r) for r in similar.keep_first(docs, similar.SimilarSettings(broadcast_texts=limit)).collect())
        assert got == collections.Counter([(5, long), (5, other), (None, "alone in the world without any id"), (8, ""), (8, ""), (9, None), (9, None), (3, "one two")])


# ---------------------------------------------------------------- clashing names


def test_columns_that_clash_in_case(spark):
    names = "doc_id bigint, text string, lang string, source string, SIZE string, N_Lines string, n_WORDS string, Slot string, LEVEL string, __Row string, kept string, Base_Failed string"
    docs = spark.createDataFrame([(i, f"one two three {i}\nshared", "en", "s", *"abcdefgh") for i in range(4)], names)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a question that no document has in it")], "item_id bigint, text string")
    assert set(sharding.shard_rows(docs).columns) >= {"size", "slot", "LEVEL", "__Row"} and sharding.shard_rows(docs).count() == 4
    assert lines.remove_boilerplate(docs).count() == 4 and "n_lines" in lines.remove_boilerplate(docs).columns
    assert "n_words" in quality.with_measures(docs).columns and quality.with_measures(docs).count() == 4
    for same in (quality.keep_good(docs, labels), similar.keep_first(docs), decontam.drop_leaks(docs, bench), mixing.mix(docs)):
        assert same.columns == docs.columns
        same.collect()
    assert quality.assess(docs, labels).count() == 4

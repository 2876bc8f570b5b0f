"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags each token as the begin of a secret (B), inside one (I) or outside (O). Its features
are the token's shape, the neighbouring words and file features; it is fitted by gradient ascent on
the exact log-likelihood (forward-backward) and decoded by Viterbi. Plain tokens - marks, and fewer
than 16 letters - are clamped to O, and so are the ends of a text. A chain whose tokens at both sides
are O is scored by its own moves and emissions alone, so the best tagging of a text is that of the
runs between its plain words, each with O before and after it; only these are decoded.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order of their kinds
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
CUES = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "bearer", "auth", "authorization", "credential", "credentials", "access", "private", "signature")

TOKEN = re.compile(r"[\w+/.\-]+|[^\w\s]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\W\d_]+")
# Every word with a token that isn't plain has one of these
SIGNAL = re.compile(r"[\d_]|\w[+/.\-]+\w|[^\W\d_]{16}")
GAP_CHARS = " \t\n\x0b\f\r"
GAPS = re.compile(r"[\x20\x09-\x0D]")
STATES = 3  # O, B, I
CLAMP = -1e9


@dataclass(frozen=True)
class ScanSettings:
    sample_docs: int = 6000  # documents, about, from which training runs are taken
    sample_runs: int = 4000  # runs at most that the field is fitted on
    made_runs: int = 1500  # runs made by rule, so that secrets of other shapes are known too
    longest_run: int = 64  # tokens of a run that the field is fitted on; runs of any length are decoded
    epochs: int = 12
    rate: float = 0.3
    decay: float = 1e-4
    seed: int = 11


@dataclass
class Field:
    """Weights of a fitted field: by feature and state, and by pair of states."""

    emit: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    move: np.ndarray = field(default_factory=lambda: np.zeros((STATES, STATES)))

    @property
    def first(self) -> np.ndarray:
        """Weights of a run's first state: what comes before it is outside."""
        return self.move[0]

    @property
    def last(self) -> np.ndarray:
        """Weights of a run's last state: what comes after it is outside."""
        return self.move[:, 0]


# ---------------------------------------------------------------- base patterns


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, sorted; leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]  # maximal runs, so the length may be asked at once
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---------------------------------------------------------------- runs of tokens that aren't plain


def words_before(text: str, at: int, count: int = 2) -> list[str]:
    """The last words before a place, lower-cased, in order."""
    found: list[str] = []
    while at > 0 and len(found) < count:
        end = at
        while end > 0 and text[end - 1] in GAP_CHARS:
            end -= 1
        at = end
        while at > 0 and text[at - 1] not in GAP_CHARS:
            at -= 1
        if at < end:
            found.append(text[at:end].lower())
    return found[::-1]


def placed_runs(text: str) -> Iterator[tuple[list[tuple[int, int, str]], list[str], str]]:
    """Maximal chains of tokens of words that aren't plain, with the two words before them and the one after.

    A word is cut into runs of value characters and single marks. Neighbouring words that aren't
    plain make one chain. After the last word comes ``$``.
    """
    at, n = 0, len(text)
    chain: list[tuple[int, int, str]] = []
    before: list[str] = []
    last_end = -1

    def after(end: int) -> str:
        word = WORD.search(text, end)
        return word.group().lower() if word else "$"

    while at < n:
        hit = SIGNAL.search(text, at)
        if hit is None:
            break
        a = hit.start()
        while a > at and text[a - 1] not in GAP_CHARS:
            a -= 1
        gap = GAPS.search(text, hit.end())
        b = gap.start() if gap else n  # a signal has no space inside
        if chain and text[last_end:a].strip(GAP_CHARS):
            yield chain, before, after(last_end)
            chain = []
        if not chain:
            before = words_before(text, a)
        chain.extend((m.start(), m.end(), m.group()) for m in TOKEN.finditer(text, a, b))
        last_end = at = b
    if chain:
        yield chain, before, after(last_end)


def runs(text: str) -> Iterator[tuple[list[tuple[int, int, str]], list[str]]]:
    """The chains of a text with the two words before each."""
    return ((chain, before) for chain, before, _ in placed_runs(text))


def shape(token: str) -> str:
    """Classes of characters, length and evenness of a token."""
    kinds = ("a" if re.search("[a-z]", token) else "") + ("A" if re.search("[A-Z]", token) else "") + ("0" if re.search("[0-9]", token) else "")
    kinds += "+" if re.search(r"[+/_.\-]", token) else ""
    if not kinds:
        return "mark:" + token if len(token) == 1 else "other"
    n = len(token)
    size = "xs" if n < 6 else "s" if n < 12 else "m" if n < 16 else "l" if n < 24 else "xl"
    return f"{kinds}:{size}"


def changes(token: str) -> str:
    """How often letters, digits and marks alternate, by length: high in random strings."""
    kind = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in token]
    share = sum(a != b for a, b in zip(kind, kind[1:])) / max(1, len(token) - 1)
    distinct = len(set(token)) / max(1, min(len(token), 40))
    return f"{min(4, int(share * 8))}:{min(3, int(distinct * 4))}:{'l' if len(token) >= 16 else 's'}"


def cue(word: str) -> str:
    """A neighbouring word: a cue word, a mark, or nothing of note."""
    if len(word) == 1 and not word.isalnum():
        return word
    bare = word.strip("\"'`:=,;()[]{}<>").replace("-", "").replace("_", "").lower()
    return next((c for c in CUES if bare.endswith(c)), "word")


def file_feature(text: str) -> str:
    """What kind of file the text looks like, from its length in lines and its marks of code or records."""
    braces = text.count("{") + text.count("=") + text.count(";")
    return "code" if braces * 50 > len(text) else "table" if text.count("|") * 50 > len(text) else "prose"


def features(chain: list[tuple[int, int, str]], before: list[str], kind: str, follow: str = "$") -> list[list[str]]:
    """Feature names of each token of a chain, from the words around it too."""
    names = [t for _, _, t in chain]
    context = [*["^"] * (2 - len(before)), *before, *names, follow]
    out = []
    for i, token in enumerate(names):
        form, alternate = shape(token), changes(token)
        near = [cue(context[i + 1]), cue(context[i])]  # the one before, the one before that
        after = cue(context[i + 3])
        out.append([
            "bias", f"s={form}", f"c={alternate}", f"p1={near[0]}", f"p2={near[1]}", f"n1={after}",
            f"f={kind}", f"s|p1={form}|{near[0]}", f"s|c={form}|{alternate}", f"p12={near[1]}|{near[0]}",
        ])
    return out


def clamped(token: str) -> bool:
    """Tokens that can't be part of a secret: single marks, and fewer than 16 letters, whatever marks end them."""
    bare = token.strip("+/.-")
    return not bare or (len(token) == 1 and not token.isalnum()) or (len(bare) < 16 and LETTERS.fullmatch(bare) is not None)


# ---------------------------------------------------------------- the field


def scores(model: Field, chain, before, kind: str, follow: str = "$") -> np.ndarray:
    none = (0.0, 0.0, 0.0)
    out = np.zeros((len(chain), STATES))
    for i, names in enumerate(features(chain, before, kind, follow)):
        rows = [model.emit.get(n, none) for n in names]
        out[i] = [sum(r[s] for r in rows) for s in range(STATES)]
        if clamped(chain[i][2]):
            out[i, 1:] += CLAMP
    return out


def viterbi(model: Field, emit: np.ndarray) -> list[int]:
    """The best tagging of one chain with O at both sides; ties go to the lower state."""
    best, back = model.first + emit[0], []
    for row in emit[1:]:
        total = best[:, None] + model.move
        back.append(total.argmax(axis=0))
        best = total.max(axis=0) + row
    state = int((best + model.last).argmax())
    path = [state]
    for pointers in reversed(back):
        state = int(pointers[state])
        path.append(state)
    return path[::-1]


def tagged_spans(model: Field, text: str) -> list[tuple[int, int, int]]:
    """Spans that the field tags: from a B through the I tokens after it."""
    found: list[tuple[int, int, int]] = []
    kind = None
    for chain, before, follow in placed_runs(text):
        if all(clamped(t) for _, _, t in chain):
            continue  # outside all through
        kind = kind or file_feature(text)
        tags = viterbi(model, scores(model, chain, before, kind, follow))
        start = end = None
        for (a, b, _), tag in zip(chain, tags):
            if tag == 1:
                if start is not None:
                    found.append((start, 3, end))
                start, end = a, b
            elif tag == 2 and start is not None:
                end = b
            elif start is not None:
                found.append((start, 3, end))
                start = None
        if start is not None:
            found.append((start, 3, end))
    return found


def added(base: list[tuple[int, int, int]], tagged: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The tagged spans that share no character with a base span: the same secret is not told twice."""
    if not base or not tagged:
        return tagged
    starts, ends = [a for a, _, _ in base], np.maximum.accumulate([b for _, _, b in base]).tolist()
    # the base spans that start before this one ends: does the furthest of them reach into it?
    return [s for s in tagged if not (i := bisect_left(starts, s[2])) or ends[i - 1] <= s[0]]


def scan(model: Field, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans; a tagged span that touches a base span adds nothing."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + added(base, tagged_spans(model, text)))


# ---------------------------------------------------------------- fitting


def silver(text: str) -> Iterator[tuple[list, list[str], str, str, list[int]]]:
    """Chains of a text with the tags that its base spans give."""
    spans = base_spans(text)
    values = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] + [(a, b) for a, k, b in spans if k]
    kind = file_feature(text)
    for chain, before, follow in placed_runs(text):
        tags, inside = [], None
        for a, b, token in chain:
            home = next((v for v in values if v[0] <= a and b <= v[1]), None)
            if home is None or clamped(token):
                tags.append(0)
                inside = None
            else:
                tags.append(2 if inside == home else 1)
                inside = home
        yield chain, before, follow, kind, tags


def made(count: int, seed: int) -> list[tuple[list, list[str], str, str, list[int]]]:
    """Chains made by rule: random secrets in usual settings, and numbers, dates and names that are none."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    sets = [letters + "0123456789", letters + letters.upper() + "0123456789", "0123456789abcdef", letters + letters.upper() + "0123456789+/"]
    out = []
    for _ in range(count):
        word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
        if rng.random() < 0.5:
            part = lambda least, most: "".join(rng.choice(rng.choice(sets)) for _ in range(rng.randint(least, most)))
            value = rng.choice(["", "", "ghp_", "sk-", "xoxb-"]) + rng.choice(["", "", "", part(8, 14) + "-", part(4, 10) + "-" + part(4, 10) + "-"]) + part(16, 44)
            value = value if re.search("[0-9]", value) else value + "7a"
            lead = rng.choice(["key = ", "Bearer ", "secret: ", "auth=", "token ", f"{word()} credentials: ", "access_key: ", "pwd=", "signature="])
            text = f"{word()} {lead}{rng.choice(['', chr(34)])}{value} {word()}"
            spot = text.rindex(value)
        else:
            n = rng.randint
            value = rng.choice([
                f"{n(1, 9999)}", f"{n(1900, 2040)}-{n(1, 12)}-{n(1, 28)}", f"{n(10**15, 10**16 - 1)}", f"{n(0, 255)}.{n(0, 255)}.{n(0, 255)}.{n(0, 255)}",
                f"{word()}.{word()}@{word()}.com", f"https://{word()}.com/{word()}/{n(1, 9999)}", f"{word()}_{word()}", f"v{n(1, 9)}.{n(0, 20)}.{n(0, 9)}", f"+{n(1, 99)}-{n(100, 999)}-{n(1000, 9999)}",
            ])
            text, spot = f"{word()} {rng.choice(['', 'id: ', 'number = ', 'call ', 'at '])}{value} {word()}", -1
        for chain, before, follow in placed_runs(text):
            tags, begun = [], False
            for a, b, token in chain:
                own = spot >= 0 and spot <= a and b <= spot + len(value) and not clamped(token)
                tags.append((2 if begun else 1) if own else 0)
                begun = begun or own
            out.append((chain, before, follow, "prose", tags))
    return out


def fit(examples: list[tuple[list, list[str], str, str, list[int]]], settings: ScanSettings = ScanSettings()) -> Field:
    """A field fitted on chains with tags: AdaGrad over the exact gradient of each chain, in a fixed order."""
    model = Field()
    index: dict[str, int] = {}
    rows = []
    for chain, before, follow, kind, tags in examples:
        ids = [[index.setdefault(n, len(index)) for n in names] for names in features(chain, before, kind, follow)]
        rows.append((ids, np.array([clamped(t) for _, _, t in chain]), np.array(tags)))
    if not rows:
        return model
    w, move = np.zeros((len(index), STATES)), np.zeros((STATES, STATES))
    w2, move2 = np.full_like(w, 1e-2), np.full_like(move, 1e-2)
    order = list(range(len(rows)))
    rng = random.Random(settings.seed)
    for _ in range(settings.epochs):
        rng.shuffle(order)
        for r in order:
            ids, fixed, tags = rows[r]
            n = len(tags)
            emit = np.array([w[i].sum(axis=0) for i in ids])
            emit[fixed, 1:] += CLAMP
            forward, backward = np.zeros((n, STATES)), np.zeros((n, STATES))
            forward[0] = move[0] + emit[0]
            for t in range(1, n):
                forward[t] = np.logaddexp.reduce(forward[t - 1][:, None] + move, axis=0) + emit[t]
            backward[-1] = move[:, 0]
            for t in range(n - 2, -1, -1):
                backward[t] = np.logaddexp.reduce(move + (emit[t + 1] + backward[t + 1])[None, :], axis=1)
            z = np.logaddexp.reduce(forward[-1] + move[:, 0])
            node = np.eye(STATES)[tags] - np.exp(forward + backward - z)
            g_move = np.zeros((STATES, STATES))
            g_move[0] += node[0]  # from the O before
            g_move[:, 0] += node[-1]  # to the O after
            for t in range(1, n):
                g_move[tags[t - 1], tags[t]] += 1
                g_move -= np.exp(forward[t - 1][:, None] + move + (emit[t] + backward[t])[None, :] - z)
            move2 += g_move * g_move
            move += settings.rate * (g_move - settings.decay * move) / np.sqrt(move2)
            for i, g in zip(ids, node):
                w2[i] += g * g
                w[i] += settings.rate * (g - settings.decay * w[i]) / np.sqrt(w2[i])
    model.emit = {name: tuple(float(v) for v in w[i]) for name, i in index.items()}
    model.move = move
    return model


def train(docs: DataFrame, settings: ScanSettings = ScanSettings()) -> Field:
    """The field of a table: fitted on a bounded sample of its runs, and on runs made by rule.

    Rows are sampled by the hash of doc_id and text at a rate that gives about ``sample_docs``;
    executors cut them into tagged runs, of which those with the ``sample_runs`` smallest hashes
    reach the driver.
    """
    total, longest = docs.count(), settings.longest_run
    share = min(1.0, settings.sample_docs / max(1, total))
    ring = 1 << 30
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ring)) < math.ceil(share * ring)).select("text")

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                for chain, before, follow, kind, tags in silver(text or ""):
                    if len(chain) <= longest:
                        parts = [kind, follow, " ".join(before), *(t for _, _, t in chain)]  # any character may stand in them
                        out.append(("".join(map(str, tags)), parts, hashlib.md5("\x00".join(parts).encode("utf-8", "replace")).hexdigest()))
            yield pd.DataFrame(out, columns=["tags", "parts", "h"])

    found = picked.mapInPandas(tag, "tags string, parts array<string>, h string").groupBy("h").agg(F.min(F.struct("tags", "parts")).alias("r")).select("h", "r.*")
    rows = found.orderBy("h").limit(settings.sample_runs).collect()
    examples = []
    for row in rows:
        kind, follow, before, *tokens = row["parts"]
        examples.append(([(0, 0, t) for t in tokens], before.split(" ") if before else [], follow, kind, [int(c) for c in row["tags"]]))
    return fit(examples + made(settings.made_runs, settings.seed), settings)


def scan_documents(docs: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_crf, n_tagged, base, spans, found``: one row per row of ``docs``.

    ``base`` and ``spans`` are ``kind:start:end`` in code points, sorted by start and kind;
    ``found`` holds ``struct<kind, start, end>``. ``n_tagged`` counts all spans that the field
    tags, ``n_crf`` those that it adds. Null and empty texts have none. A text is scanned whole,
    in one task, in time proportional to its length.
    """
    schema = "n_assign bigint, n_access bigint, n_hex bigint, n_crf bigint, n_tagged bigint, base string, spans string, found array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(schema)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch:
                base, tagged = (base_spans(t), tagged_spans(model, t)) if t else ([], [])
                every = sorted(base + added(base, tagged))
                count = [sum(k == i for _, k, _ in every) for i in range(len(KINDS))]
                out.append((*count, len(tagged), joined(base), joined(every), [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in every]))
            yield pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "n_crf", "n_tagged", "base", "spans", "found"])

    return docs.select("doc_id", find(text).alias("s")).select("doc_id", "s.*")

"""Language identification by string kernels.

The kernel of two texts is the cosine of their blended-spectrum presence vectors: which n-grams of
1 to ``order`` characters occur at all. Nyström landmarks, some documents of each language, give a
feature map, on which kernel ridge regression is fitted one language against the rest. Since the
kernel is linear in the presence vectors, landmarks and coefficients multiply into one matrix, and
a batch of documents is scored by one product of its presence matrix with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .base import cut
from .toxicity import held_out


def has_letter(text: str) -> bool:
    """Whether any character is a letter; fractions, numerals and ideographic numbers are none."""
    return text.isalpha() or any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageSettings:
    order: int = 3  # longest n-gram
    buckets: int = 1 << 18  # n-grams are told apart by a hash into so many places
    per_language: int = 400  # documents, at most, of each language that the model is fitted on
    sample: int = 12_000  # documents, about, of all languages: with many of them each has fewer, but one at least
    landmarks: int = 60  # of each language
    all_landmarks: int = 2000  # about, of all languages: with many of them each has fewer, but one at least
    ridge: float = 1e-2
    rows: int = 128  # documents of one matrix product


@dataclass(frozen=True)
class LanguageModel:
    settings: LanguageSettings
    languages: tuple[str, ...]
    places: np.ndarray  # of the n-grams that landmarks have
    matrix: np.ndarray  # places x languages
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the winner's margin, from -1..1 to 0..1."""
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        for k in range(0, len(known), self.settings.rows):
            part = known[k : k + self.settings.rows]
            x = np.zeros((len(part), len(self.places)), np.float32)
            for row, i in enumerate(part):
                seen = presence(texts[i], self.settings)
                x[row] = seen[self.places]
                x[row] /= math.sqrt(max(1, np.count_nonzero(seen)))
            margins = x @ self.matrix + self.bias
            best = margins.argmax(axis=1)
            for i, b, m in zip(part, best, margins):
                names[i], score[i] = self.languages[b], min(1.0, max(0.0, (float(m[b]) + 1) / 2))
        return names, score


def presence(text: str, settings: LanguageSettings) -> np.ndarray:
    """Which n-gram places of the lower-cased text are taken; white space counts as one blank each."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points[(points <= 32)] = 32
    seen = np.zeros(settings.buckets, np.uint8)
    bits = np.uint64(64 - (settings.buckets.bit_length() - 1))
    state = np.zeros(len(points), np.uint64)
    for n in range(1, settings.order + 1):
        if len(points) < n:
            break
        state = (state[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        state ^= state >> np.uint64(29)
        seen[((state * np.uint64(0xBF58476D1CE4E5B9)) >> bits).astype(np.int64)] = 1
    return seen


def fit(examples: list[tuple[str, np.ndarray]], settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """A model from ``(language, sorted places)``; the first ``landmarks`` of each language are landmarks."""
    languages = tuple(sorted({lang for lang, _ in examples}))
    most = max(1, min(settings.landmarks, settings.all_landmarks // max(1, len(languages))))
    empty = LanguageModel(settings, languages, np.zeros(0, np.int64), np.zeros((0, len(languages)), np.float32), np.zeros(len(languages), np.float32))
    if not languages:
        return empty
    taken: dict[str, int] = {}
    marks = []
    for lang, places in examples:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= most and len(places):
            marks.append(places)
    if not marks:
        return empty
    used = np.unique(np.concatenate(marks))

    def dense(part: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(part), len(used)), np.float32)
        for row, places in enumerate(part):
            at = np.searchsorted(used, places)
            at[at == len(used)] = 0
            x[row, at[used[at] == places]] = 1 / math.sqrt(max(1, len(places)))
        return x

    z = dense(marks)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-8))  # Nyström map: kernel with landmarks @ root
    features = np.concatenate([(dense([p for _, p in examples[i : i + 256]]) @ z.T).astype(np.float64) @ root for i in range(0, len(examples), 256)])
    y = np.array([[1.0 if lang == one else -1.0 for one in languages] for lang, _ in examples])
    # each language weighs the same
    count = {lang: sum(1 for one, _ in examples if one == lang) for lang in languages}
    weight = np.array([1 / count[lang] for lang, _ in examples])[:, None] * len(examples) / len(languages)
    mean_x, mean_y = (features * weight).mean(axis=0), (y * weight).mean(axis=0)
    centred = features - mean_x
    gram = centred.T @ (centred * weight) + settings.ridge * len(examples) * np.eye(features.shape[1]) / 100
    coefficients = np.linalg.solve(gram, centred.T @ ((y - mean_y) * weight))
    matrix = (z.T.astype(np.float64) @ (root @ coefficients)).astype(np.float32)
    return LanguageModel(settings, languages, used, matrix, (mean_y - mean_x @ coefficients).astype(np.float32))


def train(docs: DataFrame, settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """The model of a table: fitted on at most ``per_language`` documents of each language outside the held-out part.

    Documents are sampled by the hash of doc_id and text, of which repeated rows have one: those
    under a rate set by each language's count of distinct hashes, then the smallest of each
    language. Executors turn them into n-gram places, which reach the driver: about ``sample``
    documents, or one of each language where there are more languages than that.
    """
    usable = docs.where(~held_out(parts=3, part=1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select("lang", "text", F.xxhash64("doc_id", "text").alias("draw"))
    counts = cut(usable.groupBy("lang").agg(F.approx_count_distinct("draw").alias("different")))
    languages = counts.count()
    if not languages:
        return fit([], settings)
    each = max(1, min(settings.per_language, settings.sample // languages))
    ring = 1 << 30
    share = F.least(F.lit(1.0), F.lit(1.5 * each + 10) / F.greatest("different", F.lit(1)))  # some more than are needed
    rates = counts.select("lang", F.ceil(share * ring).alias("rate"))
    known = F.broadcast(rates) if languages <= settings.sample else rates
    under = usable.join(known, "lang").where(F.pmod("draw", F.lit(ring)) < F.col("rate"))
    order = Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(ring)), "draw")
    chosen = under.select("lang", "draw").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).select("lang", "draw")
    chosen = F.broadcast(chosen) if languages <= settings.sample else chosen
    picked = under.join(chosen, ["lang", "draw"]).groupBy("lang", "draw").agg(F.min("text").alias("text"))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.flatnonzero(presence(t, settings)).astype(np.int32) if has_letter(t) else None for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "draw": batch["draw"], "places": found}).dropna()

    rows = picked.mapInPandas(places, "lang string, draw bigint, places array<int>").collect()
    return fit([(lang, np.array(p)) for lang, _, p in sorted((r["lang"], r["draw"], list(r["places"])) for r in rows)], settings)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: one row per row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0; without any labelled
    document all are.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            names, score = model.predict([None if pd.isna(t) else t for t in batch])
            yield pd.DataFrame({"lang_pred": names, "score": score})

    found = docs.select("doc_id", held_out(parts=3, part=1).alias("held_out"), predict(text).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")

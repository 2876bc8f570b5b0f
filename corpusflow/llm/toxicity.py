"""Toxicity by a counterfactually regularised classifier.

A logistic model over the presence of words, and of the stems of longer ones, as inflected languages
spell a word in many ways. Identity terms in labelled sentences are swapped for
other terms of their group, and the fit penalises the squared change of the model's logit, so that a
neutral mention of a group neither raises nor lowers a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")

# Identity terms by group, in English, Spanish, French and German
IDENTITY = (
    ("women", "men", "girls", "boys", "trans", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("lesbianas", "gais", "bisexuales"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "latinos", "árabes", "africanos", "europeos"),
    ("inmigrantes", "refugiados", "nativos", "extranjeros"),
    ("sordos", "ciegos", "discapacitados", "autistas"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("lesbiennes", "gays", "bisexuels"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("immigrés", "réfugiés", "natifs", "étrangers"),
    ("sourds", "aveugles", "handicapés"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("lesben", "schwule", "bisexuelle"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"),
    ("einwanderer", "flüchtlinge", "einheimische", "ausländer"),
    ("gehörlose", "blinde", "behinderte"),
)
GROUP_OF = {term: group for group in IDENTITY for term in group}


STEM = 5  # letters


def features(text: str | None) -> set[str]:
    """The distinct words of a text, lower-cased, and the stems, marked by ``*``, of those that are longer."""
    found = set(WORD.findall(text.lower())) if text else set()
    return found | {f"{w[:STEM]}*" for w in found if len(w) > STEM}


@dataclass(frozen=True)
class ToxicitySettings:
    sample_docs: int = 20_000  # labelled documents, about, that the model is fitted on; never over twice as many
    words: int = 2000  # words and stems at most, those that differ most between the classes
    least_z: float = 5.0  # two-sample z of a word's document share
    least_docs: int = 4
    swaps: int = 2  # counterfactuals of a document with identity terms
    invariance: float = 20.0  # weight of the squared change of the logit
    ridge: float = 1e-3
    steps: int = 400
    threshold: float = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    weights: dict[str, float]

    def score(self, text: str | None) -> float:
        z = self.bias + math.fsum(self.weights[w] for w in features(text) if w in self.weights)  # exact, so the set's order is no matter
        return 1.0 / (1.0 + math.exp(-z)) if z >= 0 else math.exp(z) / (1.0 + math.exp(z))


def held_out(doc_id: Column | str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether the checksum of the id's digits falls into the held-out part; a null id does not."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts == part, F.lit(False))


def swapped(text: str, turn: int) -> str | None:
    """The text with each identity term replaced by another of its group; None if it has none."""
    changed = False

    def other(m: re.Match) -> str:
        nonlocal changed
        group = GROUP_OF.get(m.group().lower())
        if group is None:
            return m.group()
        changed = True
        return group[(group.index(m.group().lower()) + 1 + turn % (len(group) - 1)) % len(group)]

    out = SENTENCE.sub(lambda s: WORD.sub(other, s.group()), text)
    return out if changed else None


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> DataFrame:
    """``(text, toxic)`` of about ``sample_docs`` labelled documents outside the held-out part, twice as many at most.

    Ids are drawn by hash at a rate that gives so many; rows that repeat count once, and where an
    id stands for many texts those with the smallest hashes are taken. Labels of one document
    that disagree count as toxic; null labels don't count.
    """
    known = labels.where("toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, settings.sample_docs / max(1, known.count()))
    ring = 1 << 30
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(ring)) < math.ceil(share * ring))
    # the ids' number is bounded by their rate, so they may go to every task and no text is moved to meet them
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", F.xxhash64("doc_id", "text").alias("draw"))
    drawn = met.select("draw").distinct().orderBy("draw").limit(2 * settings.sample_docs).agg(F.max("draw").alias("last")).first()["last"]
    taken = met.where(F.col("draw") <= F.lit(drawn).cast("bigint")).groupBy("draw")
    return taken.agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def select_words(sample: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> list[str]:
    """The words and stems whose document share differs most between toxic and other documents, and identity terms that occur."""
    size = sample.agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = float(size["p"] or 0), float((size["n"] or 0) - (size["p"] or 0))
    if not pos or not neg:
        return []

    @F.pandas_udf("array<string>")
    def distinct_words(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([sorted(features(t)) for t in batch])

    counted = sample.select("toxic", F.explode(distinct_words("text")).alias("word")).groupBy("word").agg(
        F.sum("toxic").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n")
    )
    share = F.col("n") / (pos + neg)
    z = (F.col("a") / pos - (F.col("n") - F.col("a")) / neg) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg))
    scored = counted.where((F.col("n") >= settings.least_docs) & (F.col("n") < pos + neg)).select("word", z.alias("z"))
    terms = sorted(GROUP_OF)
    kept = scored.where((F.abs("z") >= settings.least_z) | F.col("word").isin(terms))
    rows = kept.orderBy(F.col("word").isin(terms).desc(), F.abs("z").desc(), "word").limit(settings.words).collect()
    return [r["word"] for r in rows]


def fit(examples: list[tuple[list[int], int, list[list[int]]]], words: list[str], settings: ToxicitySettings = ToxicitySettings()) -> ToxicityModel:
    """A model from ``(word numbers, label, word numbers of each counterfactual)``; full-batch AdaGrad, so reruns agree."""
    if not examples:
        return ToxicityModel(-2.0, {})
    n, v = len(examples), len(words)
    y = np.array([e[1] for e in examples], np.float64)
    lens = np.array([len(e[0]) for e in examples])
    ids = np.fromiter((i for e in examples for i in e[0]), np.int64, int(lens.sum()))
    rows = np.repeat(np.arange(n), lens)
    steps = []  # of each counterfactual pair: the words that come and go
    for own, _, others in examples:
        for other in others:
            steps.append([(i, 1.0) for i in set(other) - set(own)] + [(i, -1.0) for i in set(own) - set(other)])
    c_lens = np.array([len(s) for s in steps], int)
    c_ids = np.array([i for s in steps for i, _ in s], np.int64)
    c_val = np.array([d for s in steps for _, d in s], np.float64)
    c_rows = np.repeat(np.arange(len(steps)), c_lens)
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
    w, b = np.zeros(v), math.log(rate / (1 - rate))
    g2, gb2 = np.full(v, 1e-8), 1e-8
    for _ in range(settings.steps):
        z = b + np.bincount(rows, w[ids], n)
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(ids, err[rows], v) / n + settings.ridge * w / 10
        if len(steps):
            change = np.bincount(c_rows, w[c_ids] * c_val, len(steps))
            g += settings.invariance * 2 * np.bincount(c_ids, change[c_rows] * c_val, v) / len(steps)
        gb = err.mean()
        g2, gb2 = g2 + g * g, gb2 + gb * gb
        w -= 0.3 * g / np.sqrt(g2)
        b -= 0.1 * gb / math.sqrt(gb2)
    return ToxicityModel(float(b), {t: float(x) for t, x in zip(words, w)})


def train(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> ToxicityModel:
    """The model of a table. Only word numbers of the sampled documents reach the driver."""
    sample = cut(labelled_sample(docs, labels, settings))
    words = select_words(sample, settings)
    number, swaps = {w: i for i, w in enumerate(words)}, settings.swaps

    def encode(text: str) -> list[int]:
        return sorted(number[w] for w in features(text) if w in number)

    @F.pandas_udf("ids array<int>, others array<array<int>>")
    def examples(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for t in batch:
                others = [s for turn in range(swaps) if (s := swapped(t or "", turn)) is not None]
                out.append((encode(t or ""), [encode(s) for s in others]))
            yield pd.DataFrame(out, columns=["ids", "others"])

    rows = sample.select(examples("text").alias("e"), "toxic").select("e.ids", "toxic", "e.others").collect()
    return fit(sorted((list(r["ids"]), int(r["toxic"]), [list(o) for o in r["others"]]) for r in rows), words, settings)


def score_documents(docs: DataFrame, model: ToxicityModel, settings: ToxicitySettings = ToxicitySettings(), text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs``; whole texts, null as empty.

    Texts without known words, empty ones too, get the score of the bias alone.
    """

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    scored = docs.select("doc_id", held_out().alias("held_out"), score(text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= settings.threshold).cast("int"))

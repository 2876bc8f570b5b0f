"""Quality rules with risk-controlled thresholds.

Base rules on length and repetition are fixed; what they reject is no part of the risk. A document
that passes them fails at level t if any of its ratios exceeds that level's cutoff; levels are listed
from lenient to strict, so failing sets are nested. In each stratum (language, the null one too) the
labelled good documents that pass the base are a holdout, each counted once: with k of n of them failing at a level, the
exact binomial tail P(Bin(n, risk) <= k) is the p-value of "more than ``risk`` of the stratum's good
documents that pass the base fail". Levels are tested in their fixed order and testing stops at the
first that is not rejected, which needs no correction inside a stratum; across strata the error is
divided by their number. So with probability ``1 - error`` no stratum loses more than ``risk`` of the
good documents that pass its base rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import body, cut, let, others, words, written

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class QualitySettings:
    risk: float = 0.03  # of a stratum's good documents past the base that may be rejected
    error: float = 0.05  # probability that some stratum's risk is larger
    broadcast_strata: int = 100_000  # strata up to which their levels are sent to every task
    min_words: int = 50
    # cutoffs by level, lenient to strict
    symbols_per_word: tuple[float, ...] = (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2)
    bangs_per_word: tuple[float, ...] = (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2)
    dup_line_share: tuple[float, ...] = (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)
    repeat_share: tuple[float, ...] = (0.49, 0.47, 0.45, 0.42, 0.4, 0.37, 0.34, 0.3)

    @property
    def rules(self) -> dict[str, tuple[float, ...]]:
        return {
            "symbols_per_word": self.symbols_per_word,
            "bangs_per_word": self.bangs_per_word,
            "dup_line_share": self.dup_line_share,
            "repeat_share": self.repeat_share,
        }


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, from an array of words.

    Windows are compared by a 64-bit hash. A text whose windows are all distinct is done after
    one pass; otherwise windows are sorted with their places, equal neighbours mark the places,
    and each marked place covers up to the next one, three words at most.
    """
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
    empty = F.array().cast("array<bigint>")

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["x"] == e["x"], F.lit(False))
            marked = F.transform(s, lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"]))
            return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

        def total(p: Column) -> Column:
            spans = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
            return F.aggregate(spans, F.lit(0), lambda a, b: a + b)

        return let(let(pairs, places), total)

    return let(
        F.coalesce(windows, empty),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
    )


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bangs``.

    A null text counts as empty. Added columns replace any of the same name, in any case.
    """
    t = body(text)

    def by_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w).cast("bigint").alias("n_repeat_words"),
        )

    def by_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        )

    spoken = F.filter(F.split(F.col("__t"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    own = others(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")
    found = docs.select(F.struct(*own).alias("__doc"), t.alias("__t")).select(
        "__doc",
        let(words(F.col("__t")), by_words).alias("__w"),
        let(spoken, by_lines).alias("__l"),
        F.regexp_count("__t", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count("__t", F.lit("!")).cast("bigint").alias("n_bangs"),
    )
    return found.select("__doc.*", "__w.n_words", "__w.word_chars", "n_symbols", "__l.n_dup_lines", "__w.n_repeat_words", "__l.n_lines", "n_bangs")


def base_failed(settings: QualitySettings = QualitySettings()) -> Column:
    return (F.col("n_words") < settings.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def ratios() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b).cast("double")).otherwise(F.lit(0.0))
    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "bangs_per_word": per("n_bangs", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
    }


def failing_level(settings: QualitySettings = QualitySettings()) -> Column:
    """The most lenient level at which a document fails, from its measures; null if none."""
    shares, levels = ratios(), len(settings.symbols_per_word)
    found = None
    for t in range(levels):
        fails = None
        for name, cutoffs in settings.rules.items():
            one = shares[name] > F.lit(cutoffs[t])
            fails = one if fails is None else fails | one
        found = F.when(fails, F.lit(t)) if found is None else found.when(fails, F.lit(t))
    return found


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k), summed term by term; 1 where k is at least the mean, as it is then over a half."""
    import math

    start = F.struct((n.cast("double") * math.log1p(-risk)).alias("t"), F.exp(n.cast("double") * math.log1p(-risk)).alias("p"))

    def step(s: Column, i: Column) -> Column:
        term = s["t"] + F.log((n - i + 1).cast("double") / i.cast("double")) + math.log(risk / (1 - risk))
        return F.struct(term.alias("t"), (s["p"] + F.exp(term)).alias("p"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k.cast("double") >= n.cast("double") * risk, F.lit(1.0)).otherwise(F.aggregate(terms, start, step, lambda s: s["p"]))


def cutoff_levels(measured: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> tuple[DataFrame, int]:
    """``(stratum, strictest)`` of each language with labelled good documents past the base, and their number.

    ``measured`` has ``doc_id, lang, base_failed, level``. ``strictest`` is the strictest level whose
    risk is controlled, -1 if none is. Labels of one document that disagree count as bad; labels
    without a document, and null labels, don't count. A labelled doc_id is one trial in its
    stratum, however many rows it has, and fails if any of its texts does: rows that repeat are no
    evidence of their own.
    """
    levels = range(len(settings.symbols_per_word))
    good = labels.where("quality is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__q")).where("__q = 1")
    passed = measured.where("not base_failed").select("doc_id", "lang", "level")
    held = passed.join(good, passed["doc_id"] == good["__id"]).groupBy("doc_id", "lang").agg(F.min("level").alias("level"))  # one trial each
    counted = cut(held.groupBy(F.col("lang").alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("level") <= t).alias(f"k{t}") for t in levels]))
    strata = counted.count()
    error = settings.error / max(1, strata)
    strictest = F.lit(-1)
    for t in levels:  # failing sets are nested, so tails only grow and the last one passed is the place to stop
        strictest = F.when(F.col(f"p{t}") <= error, F.lit(t)).otherwise(strictest)
    tested = counted.select("stratum", *[binomial_tail(F.col(f"k{t}"), F.col("n"), settings.risk).alias(f"p{t}") for t in levels])
    return tested.select("stratum", strictest.alias("strictest")), strata


def judge(measured: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """``measured`` (with ``doc_id, lang, base_failed, level``) with ``kept``.

    A document is kept if it passes the base and fails at no level whose risk is controlled in
    its language.
    """
    found, strata = cutoff_levels(measured, labels, settings)
    known = F.broadcast(found) if strata <= settings.broadcast_strata else found
    met = measured.join(known, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    kept = ~F.col("base_failed") & (F.coalesce("level", F.lit(len(settings.symbols_per_word))) > F.coalesce("strictest", F.lit(-1)))
    return met.withColumn("kept", kept).drop("stratum", "strictest")


def assess(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """``doc_id``, the measures, ``base_failed`` and ``kept``: one row per row of ``docs``.

    Null texts have no words and fail the base. A document in a language without labels is judged
    by the base rules only. An empty table gives no rows.
    """
    measured = with_measures(docs.select("doc_id", "lang", "text")).drop("text")
    return judge(cut(measured.withColumn("base_failed", base_failed(settings)).withColumn("level", failing_level(settings))), labels, settings).drop("lang", "level")


def keep_good(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with their columns.

    Rows are measured once and written beside their verdicts; the thresholds come from a scan of
    the narrow columns, the rows kept from another one.
    """
    measured = with_measures(docs.select(F.struct("*").alias("__row"), "doc_id", "lang", "text"))
    table = written(measured.select("__row", "doc_id", "lang", base_failed(settings).alias("base_failed"), failing_level(settings).alias("level")))
    return judge(table, labels, settings).where("kept").select("__row.*")

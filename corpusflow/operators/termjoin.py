"""Joining keys of terms that mean the same, without comparing all with all and without losing a pair.

Keys mean the same if they are equal, if a phrase lies inside a longer key, if a word differs by an
ending, or if their letters match closely enough. Each rule has join keys of its own:

* *equal*: the key;
* *phrase*: what stands around the first space of the phrase, which stands around some space of the
  longer key too;
* *ending*: a word and the words that it is left with when up to ``most_ending`` letters are cut off;
* *letters*: a ratio of ``r`` asks that keys of ``n`` and ``m`` characters share ``t = r (n + m) / 2`` of them,
  counted with repeats. With the ``k``-th occurrence of a character taken as a token and all tokens in
  one order, rarest first, the first ``n - t + l`` of one and ``m - t + l`` of the other share ``l`` tokens at
  least, so keys meet by sets of ``l`` of their first tokens. Lengths are grouped, and a key has such
  sets for each group of lengths that it can be close to.

Keys that meet by letters carry marks of their tokens, bits of two numbers: a bit of one that the other
lacks is a character that isn't shared, so that most pairs that can't reach the ratio are dropped where
they meet. What is left is then compared by the rules themselves.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from ..settings import GlossarySettings

GROUPS = [5]  # least lengths of the groups, each a quarter above the one before
while GROUPS[-1] < 10_000_000:
    GROUPS.append(max(GROUPS[-1] + 1, GROUPS[-1] * 5 // 4))
AROUND = 3  # characters on each side of a space
SHORT_GROUP = 4  # keys in groups up to this one (under 13 characters) meet by sets of three tokens, longer ones by two


def lengths_like(n: Column, ratio: float) -> tuple[Column, Column]:
    """The least and the largest length of a key that can match one of ``n`` characters."""
    return F.ceil(n * ratio / (2 - ratio) - 1e-9).cast("int"), F.floor(n * (2 - ratio) / ratio + 1e-9).cast("int")


def group_of(n: Column) -> Column:
    return (F.size(F.filter(F.array(*map(F.lit, GROUPS)), lambda g: g <= n)) - 1).cast("int")


def least_of(group: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, GROUPS)), group + 1)


def token_lists(keys: DataFrame) -> DataFrame:
    """``key, n, tokens, low, high`` of distinct keys of five characters or more, rarest tokens first; the last two hold a bit for each token."""
    chars = keys.where(F.length("key") >= GROUPS[0]).select("key", F.length("key").alias("n"), F.explode(F.split("key", "")).alias("c"))
    counted = chars.groupBy("key", "n", "c").agg(F.count(F.lit(1)).cast("int").alias("k"))
    tokens = counted.select("key", "n", "c", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("k"))
    common = tokens.groupBy("c", "k").agg(F.count(F.lit(1)).alias("f"))
    in_order = F.sort_array(F.collect_list(F.struct("f", "c", "k")))
    place = F.pmod(F.xxhash64("c", "k"), F.lit(128))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    marks = [F.bit_or(F.when(half, bit).otherwise(F.lit(0).cast("bigint"))).alias(name) for name, half in (("low", place < 64), ("high", place >= 64))]
    return tokens.join(common, ["c", "k"]).groupBy("key", "n").agg(F.transform(in_order, lambda t: F.xxhash64(t["c"], t["k"])).alias("tokens"), *marks)


def sets_of(tokens: Column, size: int) -> Column:
    """Hashes of all sets of ``size`` of an array's tokens, which are in order."""
    found = F.transform(tokens, lambda t, i: F.struct(t.alias("h"), i.alias("i")))
    for _ in range(size - 1):
        longer = lambda s: F.transform(F.slice(tokens, s["i"] + 2, F.greatest(F.size(tokens) - s["i"] - 1, F.lit(0))), lambda t, d: F.struct(F.xxhash64(s["h"], t).alias("h"), (s["i"] + 1 + d).alias("i")))
        found = F.flatten(F.transform(found, longer))
    return F.transform(found, lambda s: s["h"])


def letter_keys(lists: DataFrame, ratio: float) -> DataFrame:
    """``key, n, low, high, meet``: what keys of close letters share, with the length and the marks of a key.

    A short list of tokens becomes many sets, so lists are dealt out before; as the tokens of a list
    differ, so do its sets.
    """
    low, high = lengths_like(F.col("n"), ratio)
    facts = ["key", "n", "low", "high"]
    dealt = lists.repartition(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    at = dealt.select(*facts, "tokens", group_of(F.col("n")).alias("own"), F.explode(F.sequence(group_of(F.greatest(low, F.lit(GROUPS[0]))), group_of(high))).alias("other"))
    shared = F.ceil((F.col("n") + F.greatest(least_of(F.col("other")), low)) * (ratio / 2) - 1e-9)
    least = F.ceil((least_of(F.col("own")) + least_of(F.col("other"))) * (ratio / 2) - 1e-9)
    size = F.least(F.when(F.greatest("own", "other") <= SHORT_GROUP, 3).otherwise(2), least).cast("int")
    first = at.select(*facts, "own", "other", size.alias("size"), F.slice("tokens", 1, F.least(F.greatest(F.col("n") - shared + size, size), F.col("n")).cast("int")).alias("first"))
    sets = F.when(F.col("size") >= 3, sets_of(F.col("first"), 3)).when(F.col("size") == 2, sets_of(F.col("first"), 2)).otherwise(F.col("first"))
    rows = first.select(*facts, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.explode(sets).alias("h"))
    return rows.select(*facts, F.xxhash64("a", "b", "h").alias("meet"))


def close_letters(sets: DataFrame, asked: DataFrame, known: DataFrame, ratio: float) -> DataFrame:
    """``key, term_key`` of keys that meet by letters, without those whose marks say that they share too few; pairs repeat."""
    other = {c: f"other_{c}" for c in ("n", "low", "high")}
    right = sets.join(known, "key", "left_semi").withColumnsRenamed(other | {"key": "term_key"})
    met = sets.join(asked, "key", "left_semi").join(right, "meet")
    lacks = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))
    own = F.col("n") - lacks("low", "other_low") - lacks("high", "other_high")
    others = F.col("other_n") - lacks("other_low", "low") - lacks("other_high", "high")
    return met.where(2 * F.least(own, others) >= ratio * (F.col("n") + F.col("other_n"))).select("key", "term_key")


def space_keys(keys: DataFrame, first_only: bool) -> DataFrame:
    """``key, meet``: what stands around the first space of a key, or around each in all lengths up to ``AROUND``."""
    chars = F.sequence(F.lit(1), F.length("key"))
    spaces = F.filter(chars, lambda i: (i > 1) & (i < F.length("key")) & (F.substring(F.col("key"), i, F.lit(1)) == " "))
    rows = keys.where(F.col("key").contains(" ")).select("key", F.explode(F.slice(spaces, 1, 1) if first_only else spaces).alias("i"))
    before, after = F.least(F.col("i") - 1, F.lit(AROUND)), F.least(F.length("key") - F.col("i"), F.lit(AROUND))
    if first_only:
        rows = rows.select("key", "i", before.alias("l"), after.alias("r"))
    else:
        rows = rows.select("key", "i", F.explode(F.sequence(F.lit(1), before)).alias("l"), after.alias("many")).select("key", "i", "l", F.explode(F.sequence(F.lit(1), F.col("many"))).alias("r"))
    return rows.select("key", F.substring(F.col("key"), F.col("i") - F.col("l"), F.col("l") + F.col("r") + 1).alias("meet")).distinct()


def ending_keys(keys: DataFrame, settings: GlossarySettings) -> DataFrame:
    """``key, meet``: single words, whole and with up to ``most_ending`` letters cut off."""
    words = keys.where(~F.col("key").contains(" ") & (F.length("key") >= settings.least_stem))
    cuts = F.sequence(F.lit(0), F.least(F.lit(settings.most_ending), F.length("key") - settings.least_stem))
    return words.select("key", F.explode(F.transform(cuts, lambda k: F.substring(F.col("key"), F.lit(1), F.length("key") - k))).alias("meet"))


def common_letters(left: pd.Series, right: pd.Series) -> np.ndarray:
    """At least the length of the longest common subsequence of each pair of keys: exact up to letters that are alike modulo 256.

    A bit for each character of the left key; keys of more than 64 have no such bound.
    """
    names = [{k: i for i, k in enumerate(dict.fromkeys(s))} for s in (left, right)]  # pandas' own codes end at a NUL
    codes = [np.array([known[k] for k in s], dtype=np.int64) for known, s in zip(names, (left, right))]
    sizes = [np.array([len(k) for k in known], dtype=np.int64) for known in names]
    wide = [int(min(max(n, default=1), 64)) for n in sizes]
    letters = [np.array([k[:w] for k in known], dtype=f"U{w}").view(np.uint32).reshape(-1, w) % 256 for known, w in zip(names, wide)]
    at = np.zeros((len(sizes[0]), 257), dtype=np.uint64)  # where each letter stands in a left key; the last column is no letter
    for i in range(wide[0]):
        rows = np.flatnonzero(sizes[0] > i)
        at[rows, letters[0][rows, i]] |= np.uint64(1 << i)
    rest = np.full(len(left), np.iinfo(np.uint64).max, dtype=np.uint64)
    for j in range(wide[1]):
        met = rest & at[codes[0], np.where(sizes[1] > j, letters[1][:, j], 256)[codes[1]]]
        rest = (rest + met) | (rest - met)
    n, m = sizes[0][codes[0]], sizes[1][codes[1]]
    return np.where(np.maximum(n, m) > 64, np.minimum(n, m), np.bitwise_count(~rest))


def ratio_of(a: Column, b: Column, sure: Column, least: float) -> Column:
    """Similarity of two keys by their matching blocks; null where they are not sure and their longest common subsequence says that it is below ``least``."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series, decided: pd.Series) -> pd.Series:
        close = decided | (2 * common_letters(left, right) >= least * (left.str.len() + right.str.len()))
        return pd.Series([SequenceMatcher(None, x, y).ratio() if c else None for x, y, c in zip(left, right, close)], dtype="float64")

    return ratio(a, b, sure)


def similar_keys(asked: DataFrame, known: DataFrame, settings: GlossarySettings = GlossarySettings()) -> DataFrame:
    """``key, term_key, ratio``: all pairs of ``asked(key)`` and ``known(term_key)`` that mean the same.

    ``ratio`` is the similarity of the letters, whichever rule decides. Null and empty keys mean nothing, keys under ``least_stem`` characters nothing but themselves; repeated
    keys count once.
    """
    here, there = F.lit(True).alias("asked"), F.lit(False).alias("asked")
    keys = cut(asked.select("key", here).unionByName(known.select(F.col("term_key").alias("key"), there)).where("key <> ''").distinct())
    sides = {"key": keys.where("asked").select("key"), "term_key": keys.where("not asked").select("key")}
    lists = token_lists(keys.select("key").distinct())
    met = lambda left, right: left.join(right.withColumnRenamed("key", "term_key"), "meet").select("key", "term_key")
    both = lambda make: [make(sides[s]) for s in ("key", "term_key")]
    a, b = F.col("key"), F.col("term_key")
    long_enough = F.least(F.length(a), F.length(b)) >= settings.least_stem
    equal = met(*both(lambda s: s.select("key", F.col("key").alias("meet"))))
    phrases = met(space_keys(sides["key"], True), space_keys(sides["term_key"], False)).where(b.contains(a)).unionByName(
        met(space_keys(sides["key"], False), space_keys(sides["term_key"], True)).where(a.contains(b))
    )
    endings = met(*both(lambda s: ending_keys(s, settings))).where((a.startswith(b) | b.startswith(a)) & (F.abs(F.length(a) - F.length(b)) <= settings.most_ending))
    sets = cut(letter_keys(lists, settings.ratio))
    letters = close_letters(sets, *both(lambda s: s), settings.ratio - 1e-9)
    sure = equal.unionByName(phrases.unionByName(endings).where(long_enough)).select(a, b, F.lit(True).alias("sure"))
    near = letters.where(long_enough).select(a, b, F.lit(False).alias("sure"))
    pairs = sure.unionByName(near).groupBy("key", "term_key").agg(F.bool_or("sure").alias("sure"))
    judged = pairs.withColumn("ratio", ratio_of(F.col("key"), F.col("term_key"), F.col("sure"), settings.ratio - 1e-9))
    return judged.where(F.col("sure") | (F.col("ratio") >= settings.ratio)).drop("sure")

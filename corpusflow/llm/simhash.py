"""Near-duplicate detection by SimHash with bit-sliced comparison.

A fingerprint has 64 bits. Two fingerprints that differ in at most ``radius`` bits are linked, and
linked fingerprints form components. Fingerprints are compared once per distinct value: whatever
the radius, cutting the bits into ``radius + 2`` blocks leaves two blocks in which a linked pair
agrees, so every pair of blocks is a bucket key. A bucket that is too large for one comparison is
divided by the same rule on the bits that its key leaves free, and one that is still too large is cut
into pieces, every two of which are compared. Inside a bucket the fingerprints are turned into bit
planes and all distances to a lane of 64 are counted at once by carry-save adders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, join_facts

BITS = 64
UPPER_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@dataclass(frozen=True)
class SimhashSettings:
    shingle: int = 3
    radius: int = 2
    seed: int = 42
    bucket: int = 4096  # fingerprints of one bucket that are compared at once; larger buckets are divided


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority vote of the shingles' 64-bit hashes; 0 for a text without words."""
    if not text:
        return 0
    parts = text.encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER).split()  # splits at \x20 and \x09-\x0D
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= shingle:
        return digest(b" ".join(parts), seed)
    joined, ends, at = b" ".join(parts), [], -1
    for part in parts:
        at += len(part) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):  # bounds the unpacked bits of a very long text
        block = hashes[i : i + 65536]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, settings: SimhashSettings = SimhashSettings(), text: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long."""
    shingle, seed = settings.shingle, settings.seed

    @F.pandas_udf("bigint")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            values = np.fromiter((fingerprint(t, shingle, seed) for t in batch), np.uint64, len(batch))
            yield pd.Series(values.view(np.int64))

    return docs.select("doc_id", prints(F.col(text)).alias("fp"))


# ---------------------------------------------------------------- comparison inside a bucket


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes: row ``b`` holds bit ``b`` of all values, 64 values to a word."""
    lanes = -(-len(values) // 64)
    bits = np.zeros((lanes * 64, 8), np.uint8)
    bits[: len(values)] = values.view(np.uint8).reshape(-1, 8)
    unpacked = np.unpackbits(bits, axis=1, bitorder="little")  # value x bit
    return np.packbits(np.ascontiguousarray(unpacked.T), axis=1, bitorder="little").view(np.uint64)  # bit x lane


def within(values: np.ndarray, planes: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query number, value number) at most ``radius`` bits apart, query by lane.

    Distances of a query to 64 values advance together: each plane that differs is added into
    binary counters held as words, with one more word for counters beyond the radius. A
    (query, lane) block leaves as soon as all of its 64 counters are beyond.
    """
    width = int(radius).bit_length() + 1
    limit = radius + 1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    lanes = planes.shape[1]
    q, lane = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), np.arange(lanes), indexing="ij"))
    counters = [np.zeros(len(q), np.uint64) for _ in range(width)]
    beyond = np.zeros(len(q), np.uint64)
    if len(values) % 64:
        beyond[lane == lanes - 1] = full << np.uint64(len(values) % 64)
    for step in range(0, BITS, 8):
        for b in range(step, step + 8):
            flip = np.uint64(0) - ((queries[q] >> np.uint64(b)) & np.uint64(1))
            carry = planes[b, lane] ^ flip
            for i in range(width):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            reached = full
            for i in range(width):
                reached = reached & (counters[i] if limit >> i & 1 else ~counters[i])
            beyond |= reached | carry
        alive = beyond != full
        if not alive.all():
            q, lane, beyond = q[alive], lane[alive], beyond[alive]
            counters = [c[alive] for c in counters]
        if not len(q):
            return
    hits = np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    block, offset = np.nonzero(hits)
    yield q[block], lane[block] * 64 + offset


def bucket_links(values: np.ndarray, radius: int, block: int = 256) -> list[tuple[int, int]]:
    """A spanning set of links ``(value, smallest value of its component here)``."""
    values = np.sort(values)
    if len(values) < 2:
        return []
    planes, parent = planes_of(values), np.arange(len(values))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for start in range(0, len(values), block):
        for a, b in within(values, planes, values[start : start + block], radius):
            a = a + start
            upper = a < b
            for x, y in zip(a[upper].tolist(), b[upper].tolist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return [(int(values[i]), int(values[r])) for i in range(len(values)) if (r := root(i)) != i]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def pair_masks(free: int, radius: int) -> list[int]:
    """Masks of every two of ``radius + 2`` blocks that make up the ``free`` bits."""
    bits = [b for b in range(BITS) if free >> b & 1]
    edges = [round(len(bits) * i / (radius + 2)) for i in range(radius + 3)]
    blocks = [sum(1 << b for b in bits[i:j]) for i, j in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


# ---------------------------------------------------------------- links and components


def links(distinct: DataFrame, settings: SimhashSettings = SimhashSettings()) -> DataFrame:
    """``(fp, other)`` links, from distinct ``fp``, whose components are those of all close pairs.

    Buckets of over ``settings.bucket`` fingerprints are divided once more by two of the blocks
    that their key leaves free: a close pair of the bucket agrees in two of these as well. With
    radius 2 a key then fixes 48 bits, so a bucket holds at most 65,536 fingerprints, and those
    over the limit are cut into pieces that meet pair by pair. No pair is left out, no group
    holds more than two pieces.
    """
    radius, every = settings.radius, (1 << BITS) - 1
    whole = pair_masks(every, radius)
    finer = [[mask | more for more in pair_masks(every & ~mask, radius)] for mask in whole]

    def keyed(masks: list[int], first: int) -> Column:
        return F.array(*[F.struct(F.lit(first + i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])

    def sized(dealt: DataFrame) -> DataFrame:
        """Rows of buckets of two prints or more, with the ``pieces`` that their bucket fills."""
        counts = dealt.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = cut(counts.withColumn("pieces", F.ceil(F.col("n") / settings.bucket).cast("int")))
        return join_facts(dealt, sizes, ["part", "key"], sizes.agg(F.sum("n")).first()[0] or 0)

    dealt = sized(distinct.select("fp", F.explode(keyed(whole, 0)).alias("k")).select("fp", "k.part", "k.key"))
    choice = F.element_at(F.array(*[keyed(masks, len(whole) * (1 + i)) for i, masks in enumerate(finer)]), F.col("part") + 1)
    divided = dealt.where("pieces > 1").select("fp", F.explode(choice).alias("k")).select("fp", "k.part", "k.key")
    placed = dealt.where("pieces = 1").unionByName(sized(divided))
    own = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    groups = placed.withColumn("own", own).select("part", "key", "fp", F.explode(others).alias("g")).groupBy("part", "key", "g")
    buckets = groups.agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for values in batch["fps"]:
                found += bucket_links(np.asarray(values, np.int64).view(np.uint64), radius)
            yield pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["fp", "other"])

    return buckets.mapInPandas(compare, "fp bigint, other bigint").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of an undirected edge list; ``root`` is one node of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each an aggregation and a
    join, until no edge changes; work tables are cut after each round.
    """
    now = cut(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct())
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(down, "v")
        small = joined.select(F.col("m").alias("u"), "v").unionByName(joined.select(F.col("m").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
        after = cut(small)
        same = _total(after) == _total(now)
        now = after
        if same:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).distinct()


def _total(edges: DataFrame) -> tuple:
    """A checksum of an edge set."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def near_duplicates(docs: DataFrame, settings: SimhashSettings = SimhashSettings()) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach. Texts without words (null texts
    too) have fingerprint 0, which is linked like any other. Rows that repeat keep a row each;
    a null doc_id never becomes a component's id unless its component has no other. An empty
    table gives no rows.
    """
    marked = cut(fingerprints(docs, settings))
    seen = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    edges = links(seen.select("fp"), settings)
    linked = components(edges, "fp", "other")
    member = seen.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    facts = cut(member.select("fp", "root", "n").join(lowest, "root").drop("root"))
    return join_facts(marked, facts, "fp", marked.count()).select("doc_id", "fp", "component_id")

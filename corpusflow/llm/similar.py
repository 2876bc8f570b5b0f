"""Near-duplicates at a similarity, by wide SimHash and bit-sliced comparison, then exact Jaccard.

Documents are bucketed by anchors, the smallest shingle hash of each of several permutations, of which
a similar pair shares at least one with near certainty (1 - (1 - s)**anchors). In a bucket all
distances of prints are counted on bit planes, as in ``simhash``. For a set similarity s of shingles
the expected share of differing SimHash bits is ``acos(2 s / (1 + s)) / pi`` or less; the radius lies
some standard deviations beyond, so that a print only tells which documents are worth a look. The
shingle sets of those are then compared as they are, bucket by bucket, and a link is a pair whose
Jaccard similarity reaches s.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .base import cut, join_facts, without_rows
from .simhash import UPPER_TO_LOWER, components

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class SimilarSettings:
    shingle: int = 5
    similarity: float = 0.8
    words: int = 4  # of 64 bits
    anchors: int = 8
    slack: float = 5.0  # standard deviations of a distance that are added to the expected one; small sets spread more than large ones
    block: int = 2048  # prints of one bucket that are compared in a block; larger buckets are cut into blocks
    set_hashes: int = 500_000  # shingle hashes, about, of one bucket that are compared in a block
    broadcast_texts: int = 2_000_000  # keys of texts, to look at or to drop, up to which they are sent to every task
    seed: int = 42

    @property
    def radius(self) -> int:
        bits = 64 * self.words
        share = math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi
        return round(bits * share + self.slack * math.sqrt(bits * share * (1 - share)))


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of each hash."""
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: str | None, settings: SimilarSettings) -> np.ndarray | None:
    """Sorted hashes of a text's distinct shingles; None without words."""
    parts = text.encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER).split() if text else []
    if not parts:
        return None
    k, digest = min(settings.shingle, len(parts)), xxhash.xxh64_intdigest
    joined, ends, at = b" ".join(parts), [], -1
    for part in parts:
        at += len(part) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    return np.unique(np.fromiter((digest(joined[a:b], settings.seed) for a, b in zip(starts, ends[k - 1 :])), np.uint64))


def sketch(hashes: np.ndarray, settings: SimilarSettings) -> tuple[np.ndarray, np.ndarray]:
    """Print and anchors of a set of shingle hashes."""
    anchors = np.array([mixed(hashes, 101 + i).min() for i in range(settings.anchors)], np.uint64)
    print_ = np.zeros(settings.words, np.uint64)
    for word in range(settings.words):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 65536):
            block = mixed(hashes[i : i + 65536], 7 + word)
            ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        print_[word] = np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return print_, anchors


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes of ``values x words`` prints: row ``b`` holds bit ``b``, 64 values to a word."""
    n, words = prints.shape
    padded = np.zeros((-(-n // 64) * 64, words), np.uint64)
    padded[:n] = prints
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def close_pairs(prints: np.ndarray, valid: np.ndarray, query: np.ndarray, lane: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(query, value)`` at most ``radius`` bits apart, for given (query place, lane) blocks.

    ``prints`` fills whole lanes of 64; ``valid`` has a bit for each place that holds a value.
    Counters of 64 values advance together as words, starting so that a carry out of the top
    means "beyond the radius"; a block is abandoned once all its values are beyond.
    """
    planes = planes_of(prints)
    width = int(radius + 1).bit_length()
    start = (1 << width) - 1 - radius
    counters = [np.full(len(query), FULL if start >> i & 1 else 0, np.uint64) for i in range(width)]
    beyond = ~valid[lane]
    for b in range(planes.shape[0]):
        flip = np.uint64(0) - ((prints[query, b // 64] >> np.uint64(b % 64)) & np.uint64(1))
        carry = planes[b, lane] ^ flip
        for i in range(width):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        beyond |= carry
        if b % 16 == 15:
            alive = beyond != FULL
            if not alive.all():
                query, lane, beyond, counters = query[alive], lane[alive], beyond[alive], [c[alive] for c in counters]
                if not len(query):
                    break
    hits = np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    block, offset = np.nonzero(hits)
    return query[block], lane[block] * 64 + offset


def close_members(buckets: list[tuple[np.ndarray, np.ndarray, np.ndarray]], radius: int, step: int = 20_000) -> list[np.ndarray]:
    """For each bucket ``(prints, earlier anchors, nodes)`` the places that have a close one here first.

    A pair counts in the first of its common buckets only, that is if no earlier anchor agrees.
    Buckets are laid out side by side: one of up to 64 prints lies in a single lane, which it may
    share with others, so that many small buckets are compared in one pass over the planes; pairs
    from two buckets are dropped.
    """
    places, at = [], 0
    for values, _, _ in buckets:
        n = len(values)
        at = at if at % 64 + n <= 64 else -(-at // 64) * 64
        places.append(at)
        at += n
    lanes, wide = -(-at // 64), max(e.shape[1] for _, e, _ in buckets)
    prints, filled = np.zeros((lanes * 64, buckets[0][0].shape[1]), np.uint64), np.zeros(lanes * 64, np.uint8)
    own, bucket = np.zeros(lanes * 64, np.int64), np.full(lanes * 64, -1)
    earlier, asked = np.zeros((lanes * 64, wide), np.int64), np.zeros((lanes * 64, wide), bool)
    query, lane = [], []
    for k, ((values, before, nodes), p) in enumerate(zip(buckets, places)):
        n, w = len(values), before.shape[1]
        prints[p : p + n], own[p : p + n], bucket[p : p + n], filled[p : p + n] = values, nodes, k, 1
        earlier[p : p + n, :w], asked[p : p + n, :w] = before, True
        mine = np.arange(p, p + n)
        for one in range(p // 64, (p + n - 1) // 64 + 1):
            first = mine[mine < (one + 1) * 64]
            query.append(first)
            lane.append(np.full(len(first), one))
    valid = np.packbits(filled.reshape(-1, 8), axis=1, bitorder="little").reshape(-1).view(np.uint64)
    query, lane = np.concatenate(query), np.concatenate(lane)
    met = np.zeros(lanes * 64, bool)
    for k in range(0, len(query), step):
        a, b = close_pairs(prints, valid, query[k : k + step], lane[k : k + step], radius)
        right = (bucket[a] == bucket[b]) & (own[a] != own[b])
        a, b = a[right], b[right]
        for i in range(wide):
            fresh = ~(asked[a, i] & (earlier[a, i] == earlier[b, i]))
            a, b = a[fresh], b[fresh]
        met[a] = met[b] = True
    return [np.flatnonzero(met[p : p + len(values)]) for (values, _, _), p in zip(buckets, places)]


def exact_links(nodes: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that span the pairs of Jaccard ``similarity`` or more, for sets laid end to end in ``hashes``.

    Each set is compared with all later ones that it isn't linked to yet.
    """
    found, label = [], np.arange(len(nodes))
    numbers = np.unique(hashes, return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    seen = np.zeros(len(hashes), bool)
    for i in range(len(nodes) - 1):
        later, n = sizes[i + 1 :], sizes[i]
        open_ = (label[i + 1 :] != label[i]) & (np.minimum(later, n) / np.maximum(later, n) >= similarity)
        if not open_.any():
            continue
        mine, first = numbers[starts[i] : starts[i] + n], starts[i + 1]
        seen[mine] = True
        shared = np.add.reduceat(seen[numbers[first:]], starts[i + 1 :] - first, dtype=np.int64)
        seen[mine] = False
        for j in np.flatnonzero(open_ & (shared / (later + n - shared) >= similarity)) + i + 1:
            if label[j] != label[i]:
                found.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
    return found


def sketches(docs: DataFrame, settings: SimilarSettings) -> DataFrame:
    """``doc_id, key, node, size, print, anchors``; node tells shingle sets apart, key texts. Texts without words have only a key."""

    @F.pandas_udf("node bigint, size int, print array<bigint>, anchors array<bigint>")
    def make(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                hashes = shingle_hashes(text, settings)
                if hashes is None:
                    rows.append((None, None, None, None))
                    continue
                print_, anchors = sketch(hashes, settings)
                node = np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), settings.seed)).astype(np.int64)
                rows.append((node, len(hashes), print_.view(np.int64), anchors.view(np.int64)))
            node, size, prints, anchors = zip(*rows) if rows else ((), (), (), ())
            yield pd.DataFrame({"node": pd.array(node, "Int64"), "size": pd.array(size, "Int32"), "print": list(prints), "anchors": list(anchors)})

    made = docs.select("doc_id", F.xxhash64("text").alias("key"), make("text").alias("s"))
    return made.select("doc_id", "key", "s.node", "s.size", "s.print", "s.anchors")


def block_groups(rows: DataFrame, sizes: DataFrame, most: int, *keep: str) -> DataFrame:
    """``rows`` of buckets dealt to groups ``g``, in which every two blocks of a bucket meet.

    ``sizes(part, bucket, n, size)`` has each bucket's rows and their total size; a bucket is cut
    by node into as many blocks as ``most`` goes into its size.
    """
    facts = cut(sizes.select("part", "bucket", "n", F.ceil(F.col("size") / most).cast("int").alias("blocks")))
    total = facts.agg(F.sum("n")).first()[0] or 0
    joined = join_facts(rows, facts, ["part", "bucket"], total).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")),
    )
    return joined.select("part", "bucket", *keep, F.explode(others).alias("g"))


def candidates(nodes: DataFrame, settings: SimilarSettings) -> DataFrame:
    """``part, bucket, node, size`` of the nodes that have a close print in a bucket which is the first that both are in.

    Buckets of up to ``block`` prints are compared at once. A larger one is cut into blocks by
    node, and every pair of its blocks is compared in a group of its own, so no group outgrows
    two blocks and no pair of the bucket is left out.
    """
    radius, words = settings.radius, settings.words
    dealt = nodes.select("node", "size", "print", F.posexplode("anchors").alias("part", "bucket"), "anchors").withColumn("anchors", F.expr("slice(anchors, 1, part)"))
    counts = dealt.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("size", F.col("n"))
    groups = block_groups(dealt, counts, settings.block, "node", "size", "print", "anchors").groupBy("part", "bucket", "g")
    rows = groups.agg(F.collect_list(F.struct("node", "size", "print", "anchors")).alias("rows")).where(F.size("rows") > 1)
    rows = rows.select("part", "bucket", F.col("rows.node").alias("nodes"), F.col("rows.size").alias("sizes"), F.flatten("rows.print").alias("prints"), F.flatten("rows.anchors").alias("earlier"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def members(held: list[tuple]) -> pd.DataFrame:
            places = close_members([h[3:] for h in held], radius)
            return pd.DataFrame({
                "part": np.repeat([h[0] for h in held], [len(p) for p in places]),
                "bucket": np.repeat(np.array([h[1] for h in held], np.int64), [len(p) for p in places]),
                "node": np.concatenate([h[5][p] for h, p in zip(held, places)]),
                "size": np.concatenate([h[2][p] for h, p in zip(held, places)]),
            })

        for batch in batches:
            held, rows_held = [], 0
            for part, bucket, own, sizes, prints, earlier in batch.itertuples(index=False):
                values = np.asarray(prints, np.int64).view(np.uint64).reshape(-1, words)
                before = np.asarray(earlier, np.int64).reshape(len(own), -1)
                held.append((part, bucket, np.asarray(sizes, np.int64), values, before, np.asarray(own, np.int64)))
                rows_held += len(own)
                if rows_held >= 8192:
                    yield members(held)
                    held, rows_held = [], 0
            if held:
                yield members(held)

    return rows.mapInPandas(compare, "part int, bucket bigint, node bigint, size int").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, settings: SimilarSettings) -> DataFrame:
    """``node, hashes``: the shingle hashes of ``wanted`` (node, key, doc_id), made anew from the texts."""

    @F.pandas_udf("array<bigint>")
    def make(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingle_hashes(t, settings).view(np.int64) for t in batch], dtype=object)

    few = wanted.count() <= settings.broadcast_texts
    named = wanted.select("node", F.col("key").alias("__key"), F.col("doc_id").alias("__id"))
    same = (F.xxhash64("text") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    found = docs.select("doc_id", "text").join(F.broadcast(named) if few else named, same)
    return found.select("node", make("text").alias("hashes")).groupBy("node").agg(F.first("hashes").alias("hashes"))


def similar_links(docs: DataFrame, nodes: DataFrame, settings: SimilarSettings) -> DataFrame:
    """``(a, b)`` links of Jaccard ``similarity`` or more, from distinct ``(node, size, print, anchors, key, doc_id)``.

    The links' components are those of all such pairs that share an anchor and are close in
    print. Buckets whose candidates hold many hashes are compared in pairs of blocks too.
    """
    members = cut(candidates(nodes, settings))
    sets = sets_of(docs, cut(members.select("node").distinct().join(nodes.select("node", "key", "doc_id"), "node")), settings)
    counts = members.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    groups = block_groups(members.select("part", "bucket", "node"), counts, settings.set_hashes, "node").join(sets, "node").groupBy("part", "bucket", "g")
    rows = groups.agg(F.collect_list(F.struct("node", "hashes")).alias("rows")).where(F.size("rows") > 1)
    rows = rows.select(F.col("rows.node").alias("nodes"), F.transform("rows.hashes", lambda h: F.size(h)).alias("sizes"), F.flatten("rows.hashes").alias("hashes"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, sizes, flat in batch.itertuples(index=False):
                found = exact_links(np.asarray(own, np.int64), np.asarray(sizes, np.int64), np.asarray(flat, np.int64), settings.similarity)
                if found:
                    yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.mapInPandas(compare, "a bigint, b bigint").distinct()


def marked_nodes(docs: DataFrame, settings: SimilarSettings) -> tuple[DataFrame, DataFrame]:
    """The sketches of ``docs``, and ``node, root, n, last, doc_id, key`` of each shingle set.

    ``root`` tells components apart and ``n`` counts the set's rows. ``doc_id`` and ``key`` name
    its first row, by doc_id and then by the text's hash; rows without a doc_id come last.
    """
    made = cut(sketches(docs, settings))
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("pick")
    # equal nodes have equal sets, so any of their prints and anchors will do
    sets = made.where("node is not null").groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "print", "anchors")], F.count(F.lit(1)).alias("n"), pick)
    nodes = cut(sets.select("node", "size", "print", "anchors", "n", "pick.last", "pick.doc_id", "pick.key"))
    linked = components(similar_links(docs, nodes, settings), "a", "b")
    met = nodes.drop("size", "print", "anchors").join(linked, "node", "left")
    return made, cut(met.withColumn("root", F.coalesce("root", "node")))


def similar_groups(docs: DataFrame, settings: SimilarSettings = SimilarSettings()) -> DataFrame:
    """``(doc_id, component_id)``: documents whose shingle sets are similar, and what that reaches.

    ``component_id`` is the smallest doc_id of the component. A text without words (null too) is
    alone: such rows are their own components. Rows without a doc_id have no component of their
    own to name. An empty table gives no rows.
    """
    made, nodes = marked_nodes(docs, settings)
    lowest = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    facts = cut(nodes.select("node", "root", "n").join(lowest, "root").drop("root"))
    found = join_facts(made.where("node is not null").select("doc_id", "node"), facts, "node", made.count()).select("doc_id", "component_id")
    return found.unionByName(made.where("node is null").select("doc_id", F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, settings: SimilarSettings = SimilarSettings()) -> DataFrame:
    """``docs`` with one row of each component, with their columns.

    The row of the smallest doc_id stays, of those that share it the one whose text has the
    smallest hash, of rows equal in both any one; rows without a doc_id come last. Membership is
    by row: texts that share a doc_id and aren't similar are in components of their own. Rows
    without words are in none and all stay.
    """
    made, nodes = marked_nodes(docs, settings)
    firsts = nodes.groupBy("root").agg(F.min(F.struct("last", "doc_id", "key")).alias("pick")).select(F.col("pick.doc_id").alias("__id"), F.col("pick.key").alias("__key"))
    rows = cut(made.where("node is not null").groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("n")))
    lost = rows.alias("r").join(firsts.alias("f"), F.col("r.__id").eqNullSafe(F.col("f.__id")) & (F.col("r.__key") == F.col("f.__key")), "left_anti")
    left = without_rows(docs, lost.select("__id", "__key"), settings.broadcast_texts)
    again = rows.where("n > 1").select("__id", "__key")
    if again.isEmpty():
        return left
    # rows that come several times: one of them, found where they are; the others go on as they are
    same = (F.xxhash64("text") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    repeated = left.select(F.struct("*").alias("__doc"), "doc_id", "text").join(F.broadcast(again) if again.count() <= settings.broadcast_texts else again, same)
    once = repeated.withColumn("__place", F.row_number().over(Window.partitionBy("__id", "__key").orderBy("__key"))).where("__place = 1")
    return without_rows(left, again, settings.broadcast_texts).unionByName(once.select("__doc.*"))

"""Ranked lexical search by hashed max-sketches.

A document's *impact* for a term grows with the term's share of the document; a term's *weight* falls
with the number of documents that hold it. A score sums weight times impact over an item's terms.

A document's sketch hashes its terms to coordinates and holds of each coordinate the largest
impact, so weight times the coordinate of each of an item's terms, summed, is no less than the
score. The items of a search are looked up in the sketches of a block of documents at once; each
item's documents are then scored exactly in descending order of that bound, until it falls below
the score of the last place that the item has filled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_type

from .terms import blocks, intern, split_words, xxh64


@dataclass(frozen=True)
class RankSettings:
    best: int = 10  # documents per item
    coordinates: int = 1 << 13  # of a sketch
    slab: int = 16  # documents per item that are scored between two looks at the bounds
    items_at_once: int = 20_000  # sent to the tasks; more are searched in further passes over the documents
    block_bytes: int = 1 << 21  # texts that are sketched at once
    block_cells: int = 1 << 22  # bounds that are held at once: documents times items
    merge_groups: int = 64  # of an item's candidates from all tasks


class Items(NamedTuple):
    """Items that are searched at once; ``first`` and ``count`` tell where an item's terms lie in ``term`` and ``factor``."""

    ids: list
    names: dict[bytes, int]  # of the terms
    first: np.ndarray
    count: np.ndarray
    term: np.ndarray
    factor: np.ndarray  # occurrences in the item; times the term's weight once it is known


class Stats(NamedTuple):
    docs: int  # with a term at least
    terms: int  # of all documents, repeats included
    df: np.ndarray  # documents that hold each of the items' terms


def read_items(rows: list) -> Items:
    """Items of ``(item_id, text)``."""
    words = split_words(pa.array([text or "" for _, text in rows], pa.large_string()))
    raw, names, counts = words.data.tobytes(), {}, [{} for _ in rows]
    for a, b, r in zip(words.start.tolist(), words.end.tolist(), words.row.tolist()):
        t = names.setdefault(raw[a:b], len(names))
        counts[r][t] = counts[r].get(t, 0) + 1
    count = np.array([len(c) for c in counts], np.int64)
    flat = [(t, n) for c in counts for t, n in c.items()]
    return Items([i for i, _ in rows], names, np.cumsum(count) - count, count, np.array([t for t, _ in flat], np.int64), np.array([n for _, n in flat], np.int64))


class Postings(NamedTuple):
    """What a block of texts holds: sorted pairs of text and slot with their counts, and the items' term of each slot."""

    row: np.ndarray
    slot: np.ndarray
    tf: np.ndarray
    size: np.ndarray  # terms of each text
    term: np.ndarray  # of each slot, -1 if no item has it
    key: np.ndarray  # hash of each slot's term


def postings(texts: pa.Array, names: dict[bytes, int]) -> Postings:
    words = split_words(texts)
    key = xxh64(words.data, words.start, words.end)
    table = intern(words.data, words.start, words.end, key)
    pair, tf = np.unique(words.row * len(table.owner) + table.slot, return_counts=True)
    used = table.used()
    first, raw = table.owner[used], words.data.tobytes()
    term, hashed = np.full(len(table.owner), -1), np.zeros(len(table.owner), np.uint64)
    term[used] = [names.get(raw[a:b], -1) for a, b in zip(words.start[first].tolist(), words.end[first].tolist())]
    hashed[used] = key[first]
    return Postings(pair // len(table.owner), pair % len(table.owner), tf, np.bincount(words.row, minlength=len(texts)), term, hashed)


def collect_stats(docs: DataFrame, items: Items, settings: RankSettings = RankSettings()) -> Stats:
    """Counts over all ``docs(text)``; a task sends one row per term of the items at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(items.names) + 2, np.int64)  # the last two: documents and terms
        for batch in batches:
            for _, texts in blocks(batch, "text", settings.block_bytes):
                p = postings(texts, items.names)
                met = p.term[p.slot]
                found[:-2] += np.bincount(met[met >= 0], minlength=len(items.names))
                found[-2:] += np.count_nonzero(p.size), p.size.sum()
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"term": some, "n": found[some]})

    total = np.zeros(len(items.names) + 2, np.int64)
    for term, n in docs.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect():
        total[term] = n
    return Stats(int(total[-2]), int(total[-1]), total[:-2])


def weights(stats: Stats) -> np.ndarray:
    """``floor(1000 ln((2 N + 2) / (2 df + 1)))``, never negative."""
    return np.array([math.floor(1000 * math.log((2 * stats.docs + 2) / (2 * n + 1))) for n in stats.df.tolist()], np.int64)


def impacts(p: Postings, stats: Stats) -> np.ndarray:
    """``(10^9 tf) div (1000 tf + 8 m)`` of each pair, ``m = 25 + (75 n N) div L`` from a text's size ``n``."""
    sizes, which = np.unique(p.size, return_inverse=True)
    norm = np.array([25 + 75 * n * stats.docs // max(1, stats.terms) for n in sizes.tolist()], np.int64)[which]
    return 1_000_000_000 * p.tf // (1000 * p.tf + 8 * norm[p.row])


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs ``first .. first + count``: the run of each place, and the place."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


def sketch(row: np.ndarray, coordinate: np.ndarray, impact: np.ndarray, settings: RankSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, coordinate, largest impact`` of the coordinates that a text fills."""
    place = row * settings.coordinates + coordinate
    order = np.argsort(place, kind="stable")
    first = np.flatnonzero(np.diff(place[order], prepend=-1))
    top = np.maximum.reduceat(impact[order], first) if len(first) else impact[:0]
    return place[order][first] // settings.coordinates, place[order][first] % settings.coordinates, top


class Searcher:
    """Searches blocks of documents for all of ``items`` and holds each item's best ones."""

    def __init__(self, items: Items, stats: Stats, settings: RankSettings = RankSettings()) -> None:
        self.items, self.stats, self.settings = items, stats, settings
        self.factor = items.factor * weights(stats)[items.term] if len(items.term) else items.factor
        names = pa.array(list(items.names), pa.large_binary())
        offsets = np.frombuffer(names.buffers()[1], np.int64, len(names) + 1)
        held = np.frombuffer(names.buffers()[2] or b"", np.uint8)
        hashed = xxh64(np.concatenate([held, np.zeros(8, np.uint8)]), offsets[:-1], offsets[1:])
        # by coordinate: the items with a term there and the sum of its factors
        owner, _ = spread(items.first, items.count)
        place = self.coordinate(hashed)[items.term] * max(1, len(items.ids)) + owner
        met, which = np.unique(place, return_inverse=True)
        self.lookup_item, self.lookup_factor = met % max(1, len(items.ids)), np.zeros(len(met), np.int64)
        np.add.at(self.lookup_factor, which, self.factor)
        self.lookup_count = np.bincount(met // max(1, len(items.ids)), minlength=settings.coordinates)
        self.lookup_first = np.cumsum(self.lookup_count) - self.lookup_count
        self.least = np.ones(len(items.ids), np.int64)  # a document needs as much to matter
        self.held = pd.DataFrame({"item": np.empty(0, np.int64), "doc_id": [], "score": np.empty(0, np.int64)})
        self.bounded = self.scored = 0

    def coordinate(self, hashed: np.ndarray) -> np.ndarray:
        return (hashed % np.uint64(self.settings.coordinates)).astype(np.int64)

    def bounds(self, p: Postings, impact: np.ndarray) -> np.ndarray:
        """``texts x items``: no score is above its bound."""
        n, width = len(p.size), len(self.items.ids)
        row, coordinate, top = sketch(p.row, self.coordinate(p.key[p.slot]), impact, self.settings)
        which, at = spread(self.lookup_first[coordinate], self.lookup_count[coordinate])
        found = np.zeros(n * width, np.int64)
        np.add.at(found, row[which] * width + self.lookup_item[at], top[which] * self.lookup_factor[at])
        return found.reshape(n, width)

    def exact(self, row: np.ndarray, item: np.ndarray, known: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Scores of pairs of a text and an item; ``known`` are sorted places ``text * terms + term`` with their impacts."""
        which, at = spread(self.items.first[item], self.items.count[item])
        wanted = row[which] * len(self.items.names) + self.items.term[at]
        place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        total = np.zeros(len(row), np.int64)
        np.add.at(total, which, np.where(known[place] == wanted, impact[place], 0) * self.factor[at])
        return total

    def take(self, ids: pd.Series, texts: pa.Array) -> None:
        """Searches a block of documents."""
        p = postings(texts, self.items.names)
        impact = impacts(p, self.stats)
        mine = np.flatnonzero(p.term[p.slot] >= 0)
        if not len(mine):
            return
        known = p.row[mine] * len(self.items.names) + p.term[p.slot[mine]]
        order = np.argsort(known)
        known, worth = known[order], impact[mine][order]
        bound = self.bounds(p, impact)
        best_first = np.argsort(-bound, axis=0, kind="stable")
        self.bounded += int(np.count_nonzero(bound))
        for at in range(0, len(bound), self.settings.slab):
            rows = best_first[at : at + self.settings.slab]
            reach = np.take_along_axis(bound, rows, 0) >= self.least
            if not reach.any():
                break
            row, item = rows[reach], np.nonzero(reach)[1]
            self.scored += len(row)
            score = self.exact(row, item, known, worth)
            good = score >= self.least[item]
            self.keep(item[good], ids.iloc[row[good]], score[good])

    def keep(self, item: np.ndarray, ids: pd.Series, score: np.ndarray) -> None:
        """Merges scored documents into the best ones; what is below an item's last place no longer matters."""
        if not len(item):
            return
        new = pd.DataFrame({"item": item, "doc_id": ids.reset_index(drop=True), "score": score})
        rows = pd.concat([self.held, new], ignore_index=True) if len(self.held) else new
        rows = rows.sort_values(["item", "score", "doc_id"], ascending=[True, False, True], kind="stable", na_position="last")
        self.held = rows.groupby("item", sort=False).head(self.settings.best)
        full = self.held.groupby("item")["score"].agg(["size", "min"])
        full = full[full["size"] == self.settings.best]
        self.least[full.index.to_numpy()] = np.maximum(full["min"].to_numpy(), 1)


def search(docs: DataFrame, items: DataFrame, settings: RankSettings = RankSettings()) -> DataFrame:
    """``item_id, rank, doc_id, score``: of each row of ``items(item_id, text)`` the best rows of ``docs(doc_id, text)``.

    Only scores above 0 count; equal ones go by ascending doc_id, null ids last; repeated rows of a
    document take a place each, and repeated items are answered each. Null and empty texts have no
    terms: such documents are found by nothing, such items find nothing. Empty tables give no rows.
    Other columns play no part.

    Of a task's documents each item's best ones leave it; they meet in two steps, so that no task
    gets all candidates of an item.
    """
    kinds, total = dict(docs.dtypes), items.count()
    passes, out, done = max(1, -(-total // settings.items_at_once)), None, 0
    schema = f"item bigint, item_id {dict(items.dtypes)['item_id']}, doc_id {kinds['doc_id']}, score bigint"
    id_kind = to_arrow_type(items.schema["item_id"].dataType)
    for n in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n)
        asked = read_items([(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()])  # about items_at_once
        stats, start = collect_stats(docs, asked, settings), done

        def best(batches: Iterator[pa.RecordBatch], asked: Items = asked, stats: Stats = stats, start: int = start) -> Iterator[pd.DataFrame]:
            searcher = Searcher(asked, stats, settings)
            step, kind = max(1, settings.block_cells // max(1, len(asked.ids))), None
            for batch in batches:
                kind = batch.schema.field("doc_id").type
                for block, texts in blocks(batch, "text", settings.block_bytes):
                    ids = block.column("doc_id").to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)
                    for i in range(0, len(texts), step):
                        searcher.take(ids.iloc[i : i + step], texts.slice(i, step))
            if kind is not None and len(searcher.held):
                held = searcher.held
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held["item"] + start, pa.int64()), pa.array([asked.ids[i] for i in held["item"]], id_kind), pa.Array.from_pandas(held["doc_id"], type=kind), pa.array(held["score"], pa.int64())],
                    names=["item", "item_id", "doc_id", "score"],
                )

        found = docs.select("doc_id", "text").mapInArrow(best, schema)
        out, done = found if out is None else out.unionByName(found), done + len(asked.ids)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    group = F.pmod(F.xxhash64("doc_id", "score"), F.lit(settings.merge_groups))
    some = out.withColumn("r", F.row_number().over(Window.partitionBy("item", group).orderBy(*order))).where(F.col("r") <= settings.best)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= settings.best)
    return last.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

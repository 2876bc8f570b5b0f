"""What a task of a search does: scores of a block of chunks for all questions, their filters, and the best of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

FACETS = (("statuses", "doc_status"), ("kinds", "doc_kind"), ("departments", "department"), ("doc_ids", "doc_id"))
PIECE = 1 << 18  # tokens, and products of them, that a task holds at once


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose sizes sum to ``most`` or less; a larger row is a run of its own."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


class Best:
    """The ``k`` best keys of each question; ties go to the smaller key, scores of ``least`` or less don't count."""

    def __init__(self, questions: int, k: int, least: float) -> None:
        self.k, self.least = k, least
        self.floor = np.full(questions, least)
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.size = 0

    def add(self, keys: pa.Array, scores: np.ndarray, which: np.ndarray | None = None) -> None:
        """Keys and their scores, ``keys x questions`` (all, or those of ``which``); only what can still be among the best is held."""
        k, floor = self.k, self.floor if which is None else self.floor[which]
        low = np.maximum(floor, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]) if len(scores) > k else floor
        inside, most = (scores >= low) & (scores > self.least), 4 * k * len(self.floor)
        for at, to in runs(np.count_nonzero(inside, axis=1), most):  # equal scores can be far more than the best
            row, question = np.nonzero(inside[at:to])
            row += at
            self.held.append((question if which is None else which[question], keys.take(pa.array(row)), scores[row, question]))
            self.size += len(row)
            if self.size > most:
                self.shorten(keys.type)

    def shorten(self, kind: pa.DataType) -> None:
        rows = self.rows()
        self.held, self.size = [(rows["q"].to_numpy(), pa.array(rows["key"], kind), rows["score"].to_numpy())], len(rows)
        full = rows.groupby("q")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()

    def rows(self) -> pd.DataFrame:
        """``q, key, score``."""
        if not self.held:
            return pd.DataFrame({"q": np.empty(0, np.int64), "key": [], "score": np.empty(0)})
        question, keys, score = np.concatenate([h[0] for h in self.held]), pa.concat_arrays([h[1] for h in self.held]), np.concatenate([h[2] for h in self.held])
        table = pd.DataFrame({"q": question, "key": keys.to_pandas(), "score": score}).sort_values(["q", "score", "key"], ascending=[True, False, True])
        return table.groupby("q", sort=False).head(self.k)


def list_sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column, scaled to length 1; zeros for null and empty ones."""
    sizes, x = list_sizes(column), np.zeros((len(column), width))
    full = sizes == width
    if (~full & (sizes > 0)).any():
        raise ValueError("vectors of chunks and questions differ in length")
    if width:
        x[full] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class DenseScorer:
    """Cosine of questions and chunks, rounded to six digits; null, empty and zero vectors score 0."""

    least = -np.inf

    def __init__(self, vectors: list) -> None:
        width = max((len(v) for v in vectors if v is not None), default=0)
        matrix = np.array([v if v is not None and len(v) else [0.0] * width for v in vectors], np.float64).reshape(len(vectors), width)
        self.unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def scores(self, column: pa.Array) -> np.ndarray:
        found = unit_rows(column, self.unit.shape[1]) @ self.unit.T
        return np.round(found, 6, out=found)


def pooled(row: np.ndarray, token: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by row and token, the largest weight of each."""
    order = np.lexsort((-weight, token, row))
    row, token, weight = row[order], token[order], weight[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    return row[first], token[first], weight[first]


class SparseScorer:
    """Products of the weights of shared tokens, rounded to six digits, by posting lists of the questions' tokens."""

    least = 0.0

    def __init__(self, vectors: list) -> None:
        sizes = [0 if v is None else len(v) for v in vectors]
        flat = [(e["token"], e["weight"]) for v in vectors if v is not None for e in v]
        token, weight = np.array([t for t, _ in flat], np.int64), np.array([w for _, w in flat], np.float64)
        row, token, weight = pooled(np.repeat(np.arange(len(vectors)), sizes), token, weight)
        order = np.argsort(token, kind="stable")
        self.known, self.start, self.count = np.unique(token[order], return_index=True, return_counts=True)
        self.owner, self.worth, self.width = row[order], weight[order], len(vectors)

    def products(self, sizes: np.ndarray, token: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """``at, to, row, question, product`` of the rows from ``at`` to ``to``: each token that a row shares with a question, by row and token.

        ``sizes`` are the rows' numbers of tokens. Rows are taken a few at a time, so that their
        tokens and products stay within ``PIECE`` however long they are; a row's come together.
        """
        ends = np.cumsum(np.append(0, sizes))
        for first, last in runs(sizes, PIECE):
            inside = slice(ends[first], ends[last])
            held, mine = np.repeat(np.arange(first, last), sizes[first:last]), token[inside].astype(np.int64)
            place = np.minimum(np.searchsorted(self.known, mine), max(0, len(self.known) - 1))
            met = self.known[place] == mine if len(self.known) else np.zeros(len(mine), bool)
            held, place, worth = pooled(held[met], place[met], weight[inside][met].astype(np.float64))
            lengths = self.count[place]
            for a, b in runs(np.bincount(held - first, lengths, last - first), PIECE):
                part = slice(*np.searchsorted(held, (first + a, first + b)))
                count = lengths[part]
                which = np.repeat(np.arange(len(count)), count)
                at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count - self.start[place[part]], count)
                yield first + a, first + b, held[part][which], self.owner[at], worth[part][which] * self.worth[at]

    def scores(self, column: pa.Array) -> np.ndarray:
        flat, found = column.flatten(), np.zeros((len(column), self.width))
        number = lambda f: flat.field(f).to_numpy(zero_copy_only=False)
        for at, to, row, owner, product in self.products(list_sizes(column), number("token"), number("weight")):
            found[at:to] = np.bincount((row - at) * self.width + owner, product, (to - at) * self.width).reshape(to - at, self.width)
        return np.round(found, 6, out=found)


class FilterMasks:
    """Which chunks each question's filter admits, by bit masks: a bit per distinct filter.

    Each value that a filter asks for has the mask of the filters that admit it, values that none
    asks for share one. A chunk's mask is the conjunction of its facets' masks and of its date's.
    """

    def __init__(self, filters: list[dict], default_statuses: tuple[str, ...]) -> None:
        wanted = [tuple(tuple(f[name] or (default_statuses if name == "statuses" else ())) for name, _ in FACETS) + (f["since"], f["until"]) for f in filters]
        places: dict[tuple, int] = {}
        self.which = np.array([places.setdefault(w, len(places)) for w in wanted], np.int64)  # the filter of each question
        distinct, self.count = list(places), len(places)
        self.facets = []
        for at, (_, column) in enumerate(FACETS):
            values = list(dict.fromkeys(v for w in distinct for v in w[at] if v is not None))
            code = {v: i + 1 for i, v in enumerate(values)}
            admitted = np.zeros((len(values) + 1, len(distinct)), bool)
            for n, w in enumerate(distinct):
                if w[at]:
                    admitted[[code[v] for v in w[at] if v is not None], n] = True
                else:
                    admitted[:, n] = True
            self.facets.append((column, values, np.packbits(admitted, axis=1)))
        bound = lambda at, open_: np.array([open_ if w[at] is None else w[at] for w in distinct], np.float64)
        self.since, self.until = bound(-2, -np.inf), bound(-1, np.inf)
        self.dated = np.isfinite(self.since) | np.isfinite(self.until)

    def admitted(self, block: pa.RecordBatch) -> np.ndarray:
        """``chunks x questions``."""
        mask = None
        for column, values, bits in self.facets:
            if not values:
                continue
            held = block.column(column)
            code = pc.index_in(held, value_set=pa.array(values, held.type))
            own = bits[pc.fill_null(pc.add(code, 1), 0).to_numpy(zero_copy_only=False)]
            mask = own if mask is None else mask & own
        if self.dated.any():
            at = block.column("doc_date_ts").cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)[:, None]
            inside = np.packbits(~self.dated | ((at >= self.since) & (at < self.until)), axis=1)  # a null date is NaN, which lies in no bounds
            mask = inside if mask is None else mask & inside
        if mask is None:
            return np.ones((block.num_rows, len(self.which)), bool)
        return np.unpackbits(mask, axis=1, count=self.count).astype(bool)[:, self.which]


class Lists:
    """The best chunks of all questions by each of several scorers, in one pass over a task's chunks."""

    def __init__(self, scorers: dict[str, object], questions: int, k: int, cells: int, masks: FilterMasks | None) -> None:
        self.scorers, self.questions, self.masks = scorers, questions, masks
        self.k, self.step = k, max(1, cells // max(1, questions))

    def run(self, batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[str, pd.DataFrame, pa.DataType]]:
        """``list, rows(q, key, score), type of keys``."""
        best = {name: Best(self.questions, self.k, scorer.least) for name, scorer in self.scorers.items()}
        kind = None
        for batch in batches:
            kind = batch.schema.field(key).type
            for at in range(0, batch.num_rows if self.questions else 0, self.step):
                block = batch.slice(at, self.step)
                mask = self.masks.admitted(block) if self.masks else None
                for name, scorer in self.scorers.items():
                    scores = scorer.scores(block.column(name))
                    best[name].add(block.column(key), scores if mask is None else np.where(mask, scores, -np.inf))
        if kind is not None:
            for name, found in best.items():
                yield name, found.rows(), kind

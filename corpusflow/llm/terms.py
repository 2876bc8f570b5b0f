"""Words of a batch of texts as NumPy arrays, and an open-addressed table that interns runs of them.

A word is a maximal run of ASCII digits and letters and of all characters beyond ASCII; of letters
only A to Z are lower-cased. Since every byte of a character beyond ASCII is 128 or more, words are
found on the bytes of a batch, without a Python string for any of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = 32
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_WORD = np.array([b >= 128 or chr(b).isdigit() or "a" <= chr(b) <= "z" for b in range(256)])

# The primes of XXH64
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


class Words(NamedTuple):
    """Words of some texts: all their bytes, each word followed by one space, and where each lies."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # number of its text


class Interned(NamedTuple):
    """Spans by the slots of a table: equal spans share a slot."""

    slot: np.ndarray  # of each span
    owner: np.ndarray  # of each slot a span in it, -1 if it is empty
    key: np.ndarray  # XXH64 of each span

    def used(self) -> np.ndarray:
        return np.flatnonzero(self.owner >= 0)

    def counts(self) -> np.ndarray:
        """How many spans each slot holds."""
        return np.bincount(self.slot, minlength=len(self.owner))


def blocks(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """A batch in runs of whole rows of about ``limit`` bytes of text, with their texts; null texts are empty."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, stop - at), texts.slice(at, stop - at)
        at = stop


def split_words(texts: pa.Array) -> Words:
    """The words of ``texts`` (a large string array without nulls)."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    held = texts.buffers()[2]
    raw = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.empty(0, np.uint8)
    first = offsets[:-1] - offsets[0] + np.arange(n)
    spaced = np.full(len(raw) + n, SPACE, np.uint8)  # a space after each text, so that no word spans two
    spaced[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(offsets))] = LOWER[raw]
    inside = IS_WORD[spaced]
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    opens, closes = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
    keep = inside.copy()
    keep[closes] = True
    spaced[closes] = SPACE
    sizes = closes - opens
    start = np.cumsum(sizes + 1) - sizes - 1
    return Words(np.concatenate([spaced[keep], np.zeros(8, np.uint8)]), start, start + sizes, np.searchsorted(first, opens, "right") - 1)


def runs(words: Words, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, row`` of all runs of 1 to ``longest`` consecutive words of a text."""
    parts = []
    for n in range(1, longest + 1):
        last = np.arange(n - 1, len(words.row))
        first = last - n + 1
        same = words.row[first] == words.row[last]
        parts.append((words.start[first[same]], words.end[last[same]], words.row[first[same]]))
    return tuple(np.concatenate(p) for p in zip(*parts))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number; ``data`` ends with eight bytes of padding."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each span; spans of 32 bytes or more go one by one."""
    turned = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    eight, at, left = lanes(data), start.copy(), end - start
    large = np.flatnonzero(left >= 32)
    h = P5 + left.astype(np.uint64)
    left[large] = 0
    while len(m := np.flatnonzero(left >= 8)):
        h[m] = turned(h[m] ^ (turned(eight[at[m]] * P2, 31) * P1), 27) * P1 + P4
        at[m] += 8
        left[m] -= 8
    m = np.flatnonzero(left >= 4)
    h[m] = turned(h[m] ^ ((eight[at[m]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at[m] += 4
    left[m] -= 4
    while len(m := np.flatnonzero(left > 0)):
        h[m] = turned(h[m] ^ (data[at[m]].astype(np.uint64) * P5), 11) * P1
        at[m] += 1
        left[m] -= 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for i in large:
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return h


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether spans ``a`` and ``b`` hold the same bytes."""
    same = end[a] - start[a] == end[b] - start[b]
    eight, open_ = lanes(data), np.flatnonzero(same & (a != b))
    at, to, left = start[a[open_]], start[b[open_]], (end - start)[a[open_]]
    while len(open_):
        apart = eight[at] ^ eight[to]
        short = left < 8
        apart[short] <<= (64 - 8 * left[short]).astype(np.uint64)
        same[open_[apart != 0]] = False
        more = (apart == 0) & (left > 8)
        open_, at, to, left = open_[more], at[more] + 8, to[more] + 8, left[more] - 8
    return same


def intern(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray | None = None) -> Interned:
    """Slots of spans in a table with open addresses: the hash picks a slot, equal hashes are verified byte by byte.

    All spans probe at once. Those that find a slot empty write themselves into it, one stays;
    whoever meets other bytes there goes on to the next slot. Spans of equal bytes make the same
    steps, so they end in one slot. At most half of the slots are used.
    """
    key = xxh64(data, start, end) if key is None else key
    size = 1 << max(4, int(2 * len(key)).bit_length())
    owner, slot = np.full(size, -1), np.empty(len(key), np.int64)
    place, todo = (key & np.uint64(size - 1)).astype(np.int64), np.arange(len(key))
    while len(todo):
        at = place[todo]
        free = owner[at] < 0
        owner[at[free]] = todo[free]
        held = owner[at]
        same = np.flatnonzero(key[held] == key[todo])
        same = same[same_bytes(data, held[same], todo[same], start, end)]
        slot[todo[same]] = at[same]
        todo = np.delete(todo, same)
        place[todo] = (place[todo] + 1) & (size - 1)
    return Interned(slot, owner, key)

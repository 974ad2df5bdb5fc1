"""Vectorised 64-bit hashes of words, windows and byte strings of whole texts, for use inside Arrow tasks.

All hashes are polynomials modulo 2**64 with an odd base, taken from prefix sums and then mixed, so the hash of any run
costs two look-ups. Equal texts have equal hashes; different ones collide with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in portions of about so many bytes, one text at least, which bounds a task's memory and keeps its arrays
#: in the processor's cache.
PORTION = 1 << 17
U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse, at least n of each."""
    if base not in _TABLES or len(_TABLES[base][0]) < n:
        size = max(n, 2 * PORTION)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, U)
            row[0] = 1
            out.append(np.multiply.accumulate(row))
        _TABLES[base] = tuple(out)
    return _TABLES[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the word."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Sums:
    """Prefix sums of a sequence, from which the hash of any run follows."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = _powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values.astype(U) * up[: len(values)], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of [start, end); its length counts."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U) * U(0xA0761D6478BD642F))

    def windows(self, k: int) -> np.ndarray:
        """Hash of every window of k."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, U)


def byte_sums(data: np.ndarray) -> Sums:
    return Sums(data.astype(U) + U(1), _BYTE_BASE)


def word_sums(hashes: np.ndarray) -> Sums:
    return Sums(hashes, _WORD_BASE)


def portions(column: pa.Array, size: int = PORTION) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a text column, some rows at a time; null counts as empty. No copy is made."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, first): byte range and hash of every word, and per text the number of words before it."""
    if lower:
        data = LOWER[data]
    inside = table[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, byte_sums(data).runs(start, end), np.searchsorted(start, offsets)


def owners(first: np.ndarray) -> np.ndarray:
    """Text number of every word (or byte), from the number of those before each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def fitting(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of k that lie within one text, ascending."""
    size = np.maximum(np.diff(first) - k + 1, 0)
    total = int(size.sum())
    return np.repeat(first[:-1] - (np.cumsum(size) - size), size) + np.arange(total)


_SPAN = 1 << 23


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of every ``width`` consecutive values, by their upper 40 bits, the first on ties."""
    n = len(values)
    if n < width:
        return np.empty(0, np.int64)
    if n > _SPAN + width:
        return np.concatenate([at + _least(values[at:at + _SPAN + width - 1], width) for at in range(0, n - width + 1, _SPAN)])
    key = np.full(-(-n // width) * width, np.iinfo(U).max, U)
    key[:n] = (values & ~U((1 << 24) - 1)) | np.arange(n, dtype=U)
    rows = key.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - width + 1], ahead[width - 1:n]) & U((1 << 24) - 1)).astype(np.int64)


def anchored_runs(sums: Sums, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows grouped by anchor: (start of the first window, number of windows, anchor hash, hash of all they cover).

    A window's anchor is its ``gram``-gram of least hash, the leftmost on ties: it depends on the window alone, so equal
    windows have equal anchors. Consecutive windows of a text with the same anchor position form one run.
    """
    at = fitting(first, window)
    if not len(at):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, U),) * 2
    grams = sums.windows(gram)
    place = _least(grams, window - gram + 1)[at]
    cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    count = np.diff(np.r_[cut, len(at)])
    start = at[cut]
    return start, count, grams[place[cut]], sums.runs(start, start + count + (window - 1))

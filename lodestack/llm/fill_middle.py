"""Fill-in-the-middle: texts cut at token boundaries that a learned rank index finds, and put together in another order.

The index of a text maps the rank of a token boundary to its offset. It is a piecewise-linear function: every segment is a
line, fitted so that no boundary is further than ERROR code points from it, and the small difference of every boundary is
stored in one byte. A cut predicts the offset of its rank from one segment and corrects it with the stored difference, which
is exact. Segments are fitted to all boundaries of a portion of texts at once: those that miss the bound are halved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm import hashing as H
from lodestack.llm.spans import sliced

#: Largest distance of a boundary from its line; a signed byte holds it. Boundaries of the first, longest segments.
ERROR, LONGEST = 127, 4096
#: Shares of plain texts and, of the others, of those that begin with the suffix, in per cent.
PLAIN, SUFFIX_FIRST = 10, 20
PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


class Index(NamedTuple):
    """Segments of all texts of a portion: first boundary, its offset and the slope; one difference per boundary."""

    start: np.ndarray
    offset: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, at: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.start, at, "right") - 1
        return _line(self.offset[segment], self.slope[segment], at - self.start[segment])

    def offsets(self, at: np.ndarray) -> np.ndarray:
        """Exact offsets of boundaries, given by their number within the portion."""
        return self.predict(at) + self.residual[at]


def _line(offset: np.ndarray, slope: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return offset + np.floor(slope * steps).astype(np.int64)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets in code points of all token boundaries, first boundary of every text and the end).

    A token is a run of A-Z and a-z or one other code point; a text of n tokens has n + 1 boundaries.
    """
    point = (data & 0xC0) != 0x80
    letter = _LETTERS[data]
    inner = np.zeros(len(data), bool)
    inner[1:] = letter[1:] & letter[:-1]
    inner[offsets[:-1][offsets[:-1] < len(data)]] = False
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(point, out=before[1:])
    token = np.flatnonzero(point & ~inner)
    tokens = np.searchsorted(token, offsets)
    first = tokens + np.arange(len(offsets))
    found = np.empty(first[-1], np.int64)
    texts = np.arange(len(offsets) - 1)
    own = np.repeat(texts, np.diff(tokens))
    found[np.arange(len(token)) + own] = before[token] - before[offsets[own]]
    found[first[1:] - 1] = before[offsets[1:]] - before[offsets[:-1]]
    return found, first


def fit(found: np.ndarray, first: np.ndarray, error: int = ERROR, longest: int = LONGEST) -> Index:
    """Error-bounded segments through the boundaries of every text; a segment never leaves its text."""
    counts = -(-np.diff(first) // longest)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(first[:-1], counts) + within * longest
    end = np.minimum(start + longest, np.repeat(first[1:], counts))
    residual = np.zeros(len(found), np.int8)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(start):
        slope = (found[end - 1] - found[start]) / np.maximum(end - 1 - start, 1)
        size = end - start
        head = np.cumsum(size) - size
        steps = np.arange(size.sum()) - np.repeat(head, size)
        at = np.repeat(start, size) + steps
        miss = found[at] - _line(np.repeat(found[start], size), np.repeat(slope, size), steps)
        good = np.maximum.reduceat(np.abs(miss), head) <= error
        inside = np.repeat(good, size)
        residual[at[inside]] = miss[inside]
        done.append((start[good], slope[good]))
        middle = (start + end) // 2
        start, end = np.concatenate([start[~good], middle[~good]]), np.concatenate([middle[~good], end[~good]])
    starts = np.concatenate([s for s, _ in done]) if done else start
    order = np.argsort(starts)
    starts = starts[order]
    return Index(starts, found[starts], np.concatenate([s for _, s in done])[order] if done else np.empty(0), residual)


def seeds(id_col: str) -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits of the sha256 of ``1:`` and the id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def restore(output: str, form: str) -> str:
    """The text behind an output. Its parts hold no marker, so the first marker after each part ends it."""
    if form == "plain":
        return output
    if form == "psm":
        prefix, rest = output[len(PREFIX):].split(SUFFIX, 1)
        suffix, middle = rest.split(MIDDLE, 1)
    else:
        suffix, rest = output[len(SUFFIX):].split(PREFIX, 1)
        prefix, middle = rest.split(MIDDLE, 1)
    return prefix + middle + suffix


def _transform(text: str, a: int, b: int, form: str) -> str:
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *seeds(id_col))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output (text), output_sha256, restored_sha256 of every row.

    Cuts and form depend on the id and the text alone: the prefix ends after the smaller and the middle after the larger of
    h1 % (n + 1) and h2 % (n + 1) tokens (equal cuts give an empty middle). ``plain`` texts, the output of which is the text
    and the parts of which have no length, are empty ones, those that hold a marker, and those with h3 % 100 >= 100 - plain.
    Of the others h4 % 100 < suffix_first are spm, the rest psm. A null text counts as empty; a null id as empty text in the
    hash. Repeated rows each give the same row; an empty table gives none. Other columns of ``docs`` take no part.
    A task holds one portion of texts (``hashing.PORTION`` bytes, or one longer text) at a time.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, h = batch.column("doc_id"), [batch.column(f"h{i}").to_numpy() for i in range(1, 5)]
            for lo, hi, data, offsets in H.portions(batch.column("text")):
                found, first = boundaries(data, offsets)
                index, n = fit(found, first), np.diff(first) - 1
                cuts = [first[:-1] + x[lo:hi] % (n + 1) for x in h[:2]]
                a, b = index.offsets(np.minimum(*cuts)), index.offsets(np.maximum(*cuts))
                out = []
                for i, text in enumerate(batch.column("text").slice(lo, hi - lo).to_pylist()):
                    if not text or any(m in text for m in MARKS) or h[2][lo + i] % 100 >= 100 - plain:
                        out.append(("plain", None, None, text, text))
                    else:
                        form = "spm" if h[3][lo + i] % 100 < suffix_first else "psm"
                        put = _transform(text, a[i], b[i], form)
                        out.append((form, a[i], b[i] - a[i], put, restore(put, form)))
                form, prefix, middle, output, restored = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo), pa.array(n), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                        pa.array(output, pa.string()), pa.array(map(_digest, output), pa.string()), pa.array(map(_digest, restored), pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"],
                )

    kind = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"
    return _keyed(docs, id_col, text_col).mapInArrow(apply, kind)


def rank_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error: int = ERROR) -> DataFrame:
    """doc_id, segments (rank, offset, slope; ascending) and residuals (a signed byte per boundary): the index itself, for
    callers that cut the same texts again. The offset of rank r is offset + floor(slope * (r - rank)) + residuals[r], with
    the last segment whose rank is at most r."""
    kind = pa.list_(pa.struct([("rank", pa.int64()), ("offset", pa.int64()), ("slope", pa.float64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for lo, hi, data, offsets in H.portions(batch.column("text")):
                found, first = boundaries(data, offsets)
                index = fit(found, first, error)
                cut = np.searchsorted(index.start, first)
                segments = [
                    [{"rank": r - first[i], "offset": o, "slope": s} for r, o, s in zip(index.start[x:y].tolist(), index.offset[x:y].tolist(), index.slope[x:y].tolist())]
                    for i, (x, y) in enumerate(zip(cut[:-1], cut[1:]))
                ]
                residuals = [index.residual[x:y].tobytes() for x, y in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(segments, kind), pa.array(residuals, pa.binary())], ["doc_id", "segments", "residuals"])

    return _keyed(docs, id_col, text_col).select("doc_id", "text").mapInArrow(apply, "doc_id long, segments array<struct<rank:long,offset:long,slope:double>>, residuals binary")

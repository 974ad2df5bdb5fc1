"""Removal of byte strings of LENGTH that occur more than once: suffix order, Burrows-Wheeler transform, interval expansion.

Only texts that can hold a repeat reach the suffix array, and they reach it in pieces:

1. Every LENGTH-byte window has an anchor, a GRAM-gram chosen from the window's content (see ``hashing``), so equal windows
   have equal anchors. Consecutive windows with one anchor are a run. A run whose anchor occurs once repeats nowhere; one
   that occurs again as a whole repeats in all its windows. Both are settled by grouping hashes, in DataFrame operations.
2. Runs that share an anchor and differ - the places where copies begin, end or were edited - are compared byte by byte.
   One holder of each run is cut out, and runs with equal anchors meet in one bucket. There the suffixes are sorted, the
   Burrows-Wheeler transform is taken, and intervals of suffixes with a common prefix are expanded backwards, breadth
   first, from short prefixes to long ones. A level sets the boundaries whose common prefix has just its length; levels stop
   at LENGTH. Boundaries that are then still unset join windows that are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import hashing as H
from lodestack.llm.common import only_known, small_or_shuffled
from lodestack.llm.spans import keyed, packed, per_row, sliced, with_ranges
from lodestack.session import stage_table

LENGTH, GRAM = 400, 200
#: Bytes of differing runs of one anchor that are compared at once. Anchors with more (very common passages in ever other
#: surroundings) are not put into one task; their windows are grouped by hash instead. The others fill buckets of a quarter,
#: as the arrays of a bucket take some hundred times its bytes.
BUCKET = 1_000_000


def _expand(lows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the intervals [low, low + size), with the number of their interval."""
    group = np.repeat(np.arange(len(lows)), sizes)
    at = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return lows[group] + at, group


#: Symbols (0 to 256) that fit into one sort key.
HEAD = 7


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, place of each, first HEAD symbols of each as a number) by ``length`` symbols at least.

    Prefix doubling. A text ends at symbol 0 and counts as 0 behind its end, so texts do not run into one another.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    left = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(n)  # symbols up to the end of the own text
    head, padded = np.zeros(n, np.int64), np.r_[text, np.zeros(HEAD, np.int64)]
    for i in range(HEAD):
        head = head * 257 + np.where(left >= i, padded[i:i + n], 0)
    key, depth = head, HEAD
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.r_[0, np.cumsum(sorted_key[1:] != sorted_key[:-1])]
        if depth >= length or new[-1] == n - 1:
            break
        rank = np.empty(n + depth, np.int64)
        rank[order] = new
        rank[n:] = 0
        key = (rank[:n] + 1) * (n + 2) + np.where(left >= depth, rank[depth:] + 1, 0)
        depth *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place, head


def open_boundaries(text: np.ndarray, order: np.ndarray, place: np.ndarray, head: np.ndarray, length: int) -> np.ndarray:
    """For each place in the suffix order: whether the common prefix with the suffix before has ``length`` symbols or more.

    Level l holds intervals of suffixes that start with one string of l symbols; a step to the left by each symbol of the
    transform gives the strings of l + 1. The boundary behind a string's interval is set by the first level that finds it,
    and strings whose boundary was known before are not followed. The search starts at the strings of HEAD symbols, whose
    boundaries show in the sort keys.
    """
    n = len(text)
    before = np.where(order > 0, text[order - 1], 0)  # the transform; 0 in front of a text
    step = np.where(before > 0, place[order - 1], -1)
    known = head[order]
    level = min(HEAD, length)
    known //= 257 ** (HEAD - level)
    low = np.flatnonzero(np.r_[True, known[1:] != known[:-1]])
    size = np.diff(np.r_[low, n])
    shared = np.ones(n + 1, bool)  # no level has set it
    shared[low] = shared[n] = False
    bits = int(n).bit_length()
    for _ in range(level, length):
        if not len(low):
            break
        member, group = _expand(low, size)
        to = step[member]
        inside = to >= 0
        # Members of one interval with one symbol before them lie together, at the places ``to``.
        by = np.sort((group[inside] * 257 + before[member[inside]]) << bits | to[inside])
        to, mark = by & ((1 << bits) - 1), by >> bits
        cut = np.flatnonzero(np.r_[len(mark) > 0, mark[1:] != mark[:-1]])
        low, size = to[cut], np.diff(np.r_[cut, len(to)])
        fresh = shared[low + size]
        low, size = low[fresh], size[fresh]
        shared[low + size] = False
    return shared[:n]


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text the starts of its ``length``-byte strings that also start elsewhere in these texts."""
    if not texts:
        return []
    sizes = np.array([len(t) + 1 for t in texts])
    text = np.zeros(int(sizes.sum()), np.int64)
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    inner = np.ones(len(text), bool)
    inner[np.cumsum(sizes) - 1] = False
    text[inner] = data[inner].astype(np.int64) + 1
    order, place, head = suffix_order(text, length)
    shared = open_boundaries(text, order, place, head, length)
    first = np.cumsum(sizes) - sizes
    left = np.repeat(first + sizes - 1, sizes) - np.arange(len(text))  # bytes up to the end of the text
    # A window is repeated if its suffix shares ``length`` bytes with a neighbour in the order.
    joined = shared.copy()
    joined[:-1] |= shared[1:]
    hit = np.zeros(len(text), bool)
    hit[order[joined]] = True
    hit &= left >= length
    return [np.flatnonzero(hit[a:a + s]) for a, s in zip(first, sizes)]


def _ranges(starts: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Merged byte ranges of windows at ascending starts."""
    if len(starts):
        cut = np.flatnonzero(np.diff(starts) > length)
        for a, b in zip(starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]]):
            yield int(a), int(b) + length


def _all_runs(rows: DataFrame, length: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("row").to_numpy()
            for lo, _, data, offsets in H.portions(batch.column("text")):
                start, count, anchors, runs = H.anchored_runs(H.byte_sums(data), offsets, length, max(1, length // 2))
                own = np.searchsorted(offsets, start, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (key[lo + own], start - offsets[own], count, anchors.view(np.int64), runs.view(np.int64))], ["row", "start", "n", "anchor", "run"]
                )

    return rows.select("row", "text").mapInArrow(find, "row long, start long, n long, anchor long, run long")


def _cut_out(rows: DataFrame, length: int) -> DataFrame:
    """The bytes of the ranges (anchor, run, times, start, n) of each row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for key, text, ranges in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("ranges")):
                data, own = (text.as_py() or "").encode(), ranges.as_py()
                columns = [pa.array([key] * len(own), pa.int64())]
                columns += [pa.array([r[c] for r in own], pa.int64()) for c in ("start", "anchor", "times")]
                columns.append(pa.array([data[r["start"]:r["start"] + r["n"] + length - 1] for r in own], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["row", "start", "anchor", "times", "piece"])

    return rows.select("row", "text", "ranges").mapInArrow(cut, "row long, start long, anchor long, times long, piece binary")


def _by_hash(pieces: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated windows of pieces whose anchor is too common for a bucket: windows grouped by hash."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, start, piece in zip(batch.column("row").to_pylist(), batch.column("start").to_pylist(), batch.column("piece").to_pylist()):
                every = H.byte_sums(np.frombuffer(piece, np.uint8)).windows(length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.full(len(every), key)), pa.array(start + np.arange(len(every)))], ["h", "row", "start"])

    windows = pieces.select("row", "start", "piece").mapInArrow(emit, "h long, row long, start long")
    again = windows.groupBy("h").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("h")
    return windows.join(again, "h").select("row", "start", (F.col("start") + length).alias("end"))


def repeated_ranges(rows: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """(row, start, end): byte ranges that cover every ``length``-byte string of ``rows`` (row, text) that starts twice or more."""
    runs = stage_table(_all_runs(rows, length), "runs")
    often = stage_table(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor"), "anchors")
    # Runs of other anchors may stay: they are alone in their group, which settles them as unique.
    runs = stage_table(only_known(runs, often, "anchor", exact=False), "repeated")
    exact = stage_table(runs.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "start", "n")).alias("one")), "groups")
    whole = runs.join(exact.filter("times > 1").select("anchor", "run"), ["anchor", "run"], "left_semi").select("row", "start", (F.col("start") + F.col("n") + (length - 1)).alias("end"))
    # Anchors whose runs differ. Those with one run in all copies are settled.
    mixed = exact.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("one.n") + length).alias("bytes")).filter("kinds > 1")
    holders = exact.join(mixed.select("anchor"), "anchor").select("one.*", "anchor", "times")
    pieces = stage_table(_cut_out(with_ranges(rows, per_row(holders, "anchor", "times", "start", "n"), "inner"), length), "pieces")
    crowded = mixed.filter(F.col("bytes") > bucket).select("anchor")
    crowded = small_or_shuffled(stage_table(crowded, "crowded"))
    total = pieces.agg(F.sum(F.length("piece"))).first()[0] or 0
    buckets = max(1, -(-4 * total // bucket))

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        found = []
        for key, start, times, hits in zip(df["row"], df["start"], df["times"], repeated_windows(list(df["piece"]), length)):
            if times == 1:  # the others are covered as a whole
                found += [(key, start + a, start + b) for a, b in _ranges(hits, length)]
        return pd.DataFrame(found, columns=["row", "start", "end"], dtype="int64")

    quiet = pieces.join(crowded, "anchor", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    inside = quiet.groupBy("bucket").applyInPandas(compare, "row long, start long, end long")
    return whole.unionAll(inside).unionAll(_by_hash(pieces.join(crowded, "anchor", "left_semi"), length))


def _kept(data: bytes, ranges: pa.Scalar) -> tuple[bytes, int]:
    """What the ranges leave, and the number of maximal runs they remove. Ranges that touch are one run."""
    if not ranges.is_valid:
        return data, 0
    kept, spans, end = [], 0, None
    for a, b in sorted((r["start"], r["end"]) for r in ranges.as_py()):
        if end is None or a > end:
            kept.append(data[end or 0:a])
            spans, end = spans + 1, b
        else:
            end = max(end, b)
    return b"".join([*kept, data[end or 0:]]), spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256 of every row.

    Texts are UTF-8 bytes. A byte goes if a ``length``-byte string covers it that also starts at another place of this or
    any other row, overlapping ones too; strings are judged on the input and never cross rows. Null and empty texts have no
    bytes; shorter texts than ``length`` keep all. Of repeated rows all lose what they share, as others do; an empty table
    gives no rows. Ids only travel along: null and repeated ones are allowed.
    """
    rows = keyed(docs, id_col, text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text, ranges in zip(batch.column("text"), batch.column("ranges")):
                data = (text.as_py() or "").encode()
                kept, spans = _kept(data, ranges)
                out.append((len(data), len(data) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest()))
            n, gone, spans, kept, digest = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(digest, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    cut = with_ranges(rows, per_row(repeated_ranges(rows, length), "start", "end"), "left")
    return cut.select("doc_id", "text", "ranges").mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text_col``; bytes of a character that was cut in two go with it. Null
    stays null, and rows whose text is used up stay with an empty one."""
    names = docs.columns
    ranges = repeated_ranges(keyed(docs, id_col, text_col), length)
    joined = with_ranges(packed(docs, id_col, text_col), per_row(ranges, "start", "end"), "left").select("all", "ranges")
    at = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns, texts = batch.column("all").flatten(), []
            for text, ranges in zip(columns[at], batch.column("ranges")):
                own = text.as_py()
                texts.append(own if own is None or not ranges.is_valid else _kept(own.encode(), ranges)[0].decode("utf-8", "ignore"))
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, docs.schema)

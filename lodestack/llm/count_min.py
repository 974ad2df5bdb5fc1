"""Substring removal on words: windows that also start in a document with a smaller id go, after a count-min prefilter.

1. Every window of WINDOW words has an anchor, a word GRAM-gram chosen from the window's content (see ``hashing``). Tasks
   count anchors in count-min sketches; merged sketches overestimate how often an anchor, and so any window behind it,
   occurs in the corpus.
2. A second pass drops the windows whose anchor is estimated to occur once, which loses none that repeats, and groups the
   others exactly: first as whole runs, then, where runs with one anchor differ, window by window.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import hashing as H
from lodestack.llm.spans import keyed, per_row, sliced, with_ranges
from lodestack.session import stage_table

WINDOW, GRAM = 50, 25
#: Sketch rows and cells per row. The size is fixed, whatever the input: a corpus that fills it makes the prefilter weaker,
#: never the result wrong. BLOCK cells are merged at a time.
DEPTH, BITS, BLOCK = 3, 24, 1 << 16
_LAST = 2**63 - 1


def _cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(H.mix(anchors ^ np.uint64(0xA24BAED4963EE407 * (d + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - bits)).astype(np.int64) for d in range(DEPTH)]


def _runs(column: pa.Array, window: int) -> Iterator[tuple]:
    """(first row, word numbers before each row, start, count, anchor, run hash) of a portion of the texts."""
    for lo, _, data, offsets in H.portions(column):
        _, _, hashes, first = H.words(data, offsets, H.SPACED, lower=False)
        yield lo, first, *H.anchored_runs(H.word_sums(hashes), first, window, max(1, window // 2))


def sketch(docs: DataFrame, text_col: str = "text", window: int = WINDOW, bits: int = BITS) -> DataFrame:
    """depth, block, cells: which cells of the merged sketch count two or more, as packed bits. At most DEPTH * 2**bits / BLOCK rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((DEPTH, 1 << bits), np.uint8)
        for batch in batches:
            for *_, anchors, _ in _runs(batch.column(0), window):
                for row, at in zip(cells, _cells(anchors, bits)):
                    at, n = np.unique(at, return_counts=True)
                    row[at] = np.minimum(row[at] + n, 255)
        blocks = cells.reshape(DEPTH, -1, BLOCK)
        full = np.argwhere(blocks.any(axis=2))
        for part in np.array_split(full, max(1, len(full) // 64)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[:, 0], pa.int32()), pa.array(part[:, 1], pa.int32()), pa.array([zlib.compress(blocks[d, b].tobytes(), 1) for d, b in part], pa.binary())],
                ["depth", "block", "cells"],
            )

    def merge(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.uint8)
        for cells in df["cells"]:
            other = np.frombuffer(zlib.decompress(cells), np.uint8)
            total = np.minimum(255 - other, total) + other
        return pd.DataFrame([(key[0], key[1], np.packbits(total >= 2).tobytes())], columns=["depth", "block", "cells"])

    kind = "depth int, block int, cells binary"
    return docs.select(text_col).mapInArrow(count, kind).groupBy("depth", "block").applyInPandas(merge, kind)


def _suspects(rows: DataFrame, repeated: np.ndarray, window: int, bits: int) -> DataFrame:
    """Runs (row, doc_id, start, n, anchor, run) whose anchor is estimated to occur more than once."""
    shared = rows.sparkSession.sparkContext.broadcast(repeated)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, ids = batch.column("row").to_numpy(), batch.column("doc_id").to_numpy()
            for lo, first, start, count, anchors, runs in _runs(batch.column("text"), window):
                keep = np.ones(len(anchors), bool)
                for row, at in zip(shared.value, _cells(anchors, bits)):
                    keep &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                start, count = start[keep], count[keep]
                own = np.searchsorted(first, start, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (key[lo + own], ids[lo + own], start - first[own], count, anchors[keep].view(np.int64), runs[keep].view(np.int64))],
                    ["row", "doc_id", "start", "n", "anchor", "run"],
                )

    return rows.mapInArrow(find, "row long, doc_id long, start long, n long, anchor long, run long")


def _window_hashes(rows: DataFrame, window: int) -> DataFrame:
    """One row (h, row, doc_id, start) for each window of the ranges of a row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, ids, ranges = batch.column("row").to_numpy(), batch.column("doc_id").to_numpy(), batch.column("ranges").to_pylist()
            for lo, _, data, offsets in H.portions(batch.column("text")):
                _, _, hashes, first = H.words(data, offsets, H.SPACED, lower=False)
                every = H.word_sums(hashes).windows(window)
                for i in range(len(first) - 1):
                    at = np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in ranges[lo + i]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(every[first[i] + at].view(np.int64)), pa.array(np.full(len(at), key[lo + i])), pa.array(np.full(len(at), ids[lo + i])), pa.array(at)],
                        ["h", "row", "doc_id", "start"],
                    )

    return rows.mapInArrow(emit, "h long, row long, doc_id long, start long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bits: int = BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text), kept_sha256 of every row.

    A word goes if a window of ``window`` words of one text covers it whose word sequence also starts in a row with a
    smaller id; windows are judged on the input. Words are runs of bytes other than space and \\t to \\r. Null and empty
    texts have no words. Rows with equal ids do not act on one another; null ids count as larger than all. Texts with
    fewer words than a window keep all. Repeated rows each give a row; an empty table gives none.
    """
    rows = keyed(docs, id_col, text_col)
    ranked = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(_LAST)))
    repeated = np.zeros((DEPTH, (1 << bits) // 8), np.uint8)
    for block in sketch(docs, text_col, window, bits).collect():  # at most 6 MB
        at = block["block"] * BLOCK // 8
        repeated[block["depth"], at:at + BLOCK // 8] = np.frombuffer(block["cells"], np.uint8)
    runs = stage_table(_suspects(ranked, repeated, window, bits), "runs")
    exact = stage_table(runs.groupBy("anchor", "run").agg(F.min("doc_id").alias("least")), "groups")
    mixed = exact.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    # One join brings to each run what its group says; a run that holds most rows is split by the skew join.
    groups = stage_table(exact.join(mixed, "anchor", "left"), "kinds")
    owned = runs.join(groups, ["anchor", "run"])
    whole = owned.filter("doc_id > least").select("row", "start", (F.col("start") + F.col("n") + window - 1).alias("end"))
    # Where runs with one anchor differ, a window may still be in both: look at the first holders of each run.
    first = owned.filter("doc_id = least and kinds is not null")
    windows = stage_table(_window_hashes(with_ranges(ranked, per_row(first, "start", "n"), "inner"), window), "windows")
    least = windows.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("most > least").select("h", "least")
    single = windows.join(least, "h").filter("doc_id > least").select("row", "start", (F.col("start") + window).alias("end"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text, ranges in zip(batch.column("text"), batch.column("ranges")):
                word = (text.as_py() or "").encode().split()
                n = len(word)
                if ranges.is_valid:
                    depth = np.zeros(n + 1, np.int64)
                    for r in ranges.as_py():
                        depth[r["start"]] += 1
                        depth[r["end"]] -= 1
                    word = [w for w, d in zip(word, np.cumsum(depth)) if not d]
                kept = b" ".join(word)
                out.append((n, n - len(word), kept.decode(), hashlib.sha256(kept).hexdigest()))
            n, gone, kept, digest = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    cut = with_ranges(rows, per_row(whole.unionAll(single), "start", "end"), "left")
    return cut.select("doc_id", "text", "ranges").mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")

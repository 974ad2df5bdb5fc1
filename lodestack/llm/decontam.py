"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by document: each shard holds whole documents of about SHARD words, and per term the sorted positions of its
postings. Positions run through the shard, so a document is a range of positions. A benchmark window asks every shard;
there the list of its rarest term is taken first and intersected with the lists of the others, moved by their offsets, in
order of their length. Nothing is shuffled, and no term's postings meet in one task, however common it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import hashing as H
from lodestack.llm.common import small_or_shuffled
from lodestack.llm.spans import keyed, packed
from lodestack.session import stage_table

WINDOW = 10
#: Words of a shard (one document at least), and benchmark items that are asked in one pass over the index.
SHARD, PASS = 1 << 18, 20_000
_INDEX = "ids array<bigint>, rows array<bigint>, firsts binary, terms binary, sizes binary, positions binary"


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words before each row), portion by portion."""
    for lo, _, data, offsets in H.portions(column):
        _, _, hashes, first = H.words(data, offsets, H.ALNUM)
        yield lo, hashes, first


class Phrases:
    """Windows of the benchmark items of one pass: ``window`` consecutive words, or the whole item if it has fewer."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        seen: dict[tuple, set[int]] = {}
        for item, text in items:
            data = np.frombuffer(text.encode(), np.uint8)
            hashes = H.words(data, np.array([0, len(data)]), H.ALNUM)[2].tolist()
            size = min(window, len(hashes))
            for i in range(len(hashes) - size + 1 if size else 0):
                seen.setdefault(tuple(hashes[i:i + size]), set()).add(number[item])
        self.words = [np.array(w, np.uint64) for w in seen]
        self.of = [np.array(sorted(x)) for x in seen.values()]
        self.terms = np.unique(np.concatenate([np.empty(0, np.uint64), *self.words]))
        self.width = window
        #: Term numbers per window, -1 behind the end of a short one.
        self.codes = np.full((len(self.words), window), -1, np.int64)
        for row, w in zip(self.codes, self.words):
            row[: len(w)] = np.searchsorted(self.terms, w)


def build_index(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """One row per shard: its documents, and for each of ``terms`` (sorted hashes) that occurs the positions where it does.

    Terms that no query asks for have no list; every document is there. Lists are of 32-bit positions, or of 64 if a
    document alone is longer than that.
    """
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def row(ids: list, keys: list, counts: list, codes: list, at: list, base: int) -> pa.RecordBatch:
        code, place = np.concatenate(codes), np.concatenate(at)
        order = np.argsort(code, kind="stable")
        own, sizes = np.unique(code[order], return_counts=True)
        kind = np.uint32 if base < 2**32 else np.uint64
        first = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int64)
        cells = [[np.concatenate(ids).tolist()], [np.concatenate(keys).tolist()], [first.tobytes()], [shared.value[own].tobytes()], [sizes.astype(np.int64).tobytes()], [place[order].astype(kind).tobytes()]]
        kinds = [*[pa.list_(pa.int64())] * 2, *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], ["ids", "rows", "firsts", "terms", "sizes", "positions"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, none = shared.value, np.empty(0, np.int64)
        ids, keys, counts, codes, at, base = [], [], [], [], [], 0
        for batch in batches:
            id_of, key_of = np.array(batch.column("doc_id").to_pylist(), object), batch.column("row").to_numpy()
            for lo, hashes, first in _texts(batch.column("text")):
                ids.append(id_of[lo:lo + len(first) - 1])
                keys.append(key_of[lo:lo + len(first) - 1])
                counts.append(np.diff(first))
                if len(known):
                    code = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    hit = np.flatnonzero(known[code] == hashes)
                    codes.append(code[hit])
                    at.append(base + hit)
                base += len(hashes)
                if base >= shard:
                    yield row(ids, keys, counts, [none, *codes], [none, *at], base)
                    ids, keys, counts, codes, at, base = [], [], [], [], [], 0
        if ids:
            yield row(ids, keys, counts, [none, *codes], [none, *at], base)

    return keyed(docs, id_col, text_col).mapInArrow(build, _INDEX)


class _Shard:
    def __init__(self, row: dict, terms: np.ndarray):
        self.ids, self.rows, self.first = row["ids"], row["rows"], np.frombuffer(row["firsts"], np.int64)
        own, sizes = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["sizes"], np.int64)
        self.positions = np.frombuffer(row["positions"], np.uint32 if self.first[-1] < 2**32 else np.uint64).astype(np.int64)
        ends = np.cumsum(sizes)
        code = np.searchsorted(terms, own)
        self.start, self.size = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        self.start[code], self.size[code] = ends - sizes, sizes

    def list_of(self, code: int) -> np.ndarray:
        return self.positions[self.start[code]:self.start[code] + self.size[code]]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


def _exact(shard: _Shard, phrases: Phrases) -> Iterator[tuple[int, np.ndarray]]:
    """(window, start positions of its occurrences)."""
    sizes = np.where(phrases.codes >= 0, shard.size[phrases.codes], np.iinfo(np.int64).max)
    for w in np.flatnonzero(sizes.min(axis=1) > 0) if len(sizes) else []:
        length = len(phrases.words[w])
        order = np.argsort(sizes[w, :length])
        found = shard.list_of(phrases.codes[w, order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            other = shard.list_of(phrases.codes[w, k])
            at = np.minimum(np.searchsorted(other, found + k), len(other) - 1)
            found = found[other[at] == found + k]
        found = found[found >= 0]
        if len(found):  # no match runs into the next document
            found = found[shard.doc_of(found) == shard.doc_of(found + length - 1)]
        if len(found):
            yield w, found


def _near(shard: _Shard, phrases: Phrases, slop: int) -> Iterator[tuple[int, np.ndarray]]:
    """(window, positions of its rarest term that have all its terms within the window's length plus ``slop``, same document)."""
    sizes = np.where(phrases.codes >= 0, shard.size[phrases.codes], np.iinfo(np.int64).max)
    for w in np.flatnonzero(sizes.min(axis=1) > 0) if len(sizes) else []:
        length = len(phrases.words[w])
        order = np.argsort(sizes[w, :length])
        found = shard.list_of(phrases.codes[w, order[0]])
        doc = shard.doc_of(found)
        reach = length - 1 + slop
        for k in order[1:]:
            other = shard.list_of(phrases.codes[w, k])
            low = np.maximum(found - reach, shard.first[doc])
            high = np.minimum(found + reach, shard.first[doc + 1] - 1)
            keep = np.searchsorted(other, low) < np.searchsorted(other, high, "right")
            found, doc = found[keep], doc[keep]
        if len(found):
            yield w, found


def _spans(shard: _Shard, hit: np.ndarray) -> dict[int, list]:
    """Per document the ranges of hit words. A run of hit words may go on into the next document and is cut there."""
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False]))
    starts, ends = edge[::2], edge[1::2]
    spans: dict[int, list] = {}
    for a, b, d, e in zip(starts.tolist(), ends.tolist(), shard.doc_of(starts).tolist(), shard.doc_of(ends - 1).tolist()):
        for x in range(d, e + 1):
            low, high = int(shard.first[x]), int(shard.first[x + 1])
            if max(a, low) < min(b, high):
                spans.setdefault(x, []).append({"start": max(a, low) - low, "end": min(b, high) - low})
    return spans


_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ANSWER = "row long, doc_id long, n_words long, items array<string>, hits array<struct<start: long, end: long>>"


def _ask(index: DataFrame, phrases: Phrases, slop: int | None) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for i in range(len(batch)):
                shard = _Shard(batch.slice(i, 1).to_pylist()[0], own.terms)
                n = len(shard.ids)
                depth, met = np.zeros(int(shard.first[-1]) + 1, np.int64), {}
                for w, found in _exact(shard, own) if slop is None else _near(shard, own, slop):
                    np.add.at(depth, found, 1)
                    np.add.at(depth, found + (len(own.words[w]) if slop is None else 1), -1)
                    for d in np.unique(shard.doc_of(found)).tolist():
                        met.setdefault(d, set()).update(own.of[w].tolist())
                spans = _spans(shard, np.cumsum(depth[:-1]) > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.rows, pa.int64()), pa.array(shard.ids, pa.int64()), pa.array(np.diff(shard.first), pa.int64()),
                        pa.array([[own.items[k] for k in sorted(met.get(d, ()))] for d in range(n)], pa.list_(pa.string())),
                        pa.array([spans.get(d, []) for d in range(n)], _HITS),
                    ],
                    ["row", "doc_id", "n_words", "items", "hits"],
                )

    return index.mapInArrow(ask, _ANSWER)


def _passes(items: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """Items in blocks of about PASS, by a hash of the id. Only one block at a time is on the driver and broadcast."""
    rows = items.filter(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    blocks = max(1, -(-rows.count() // PASS))
    return [rows.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) for b in range(blocks)]


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int | None = None
) -> DataFrame:
    """row, doc_id, n_words, items (ids of the items that occur, as sorted strings), hits (disjoint ranges of hit words).

    Words are runs of a-z (A-Z lower-cased), 0-9 and bytes from 0x80. A window is ``window`` consecutive words of an item; an
    item with fewer words, but not none, is one window. With ``slop`` None a window occurs where its words stand one after
    another. Otherwise it occurs near its rarest word if all its words are within its length plus ``slop`` of it, in any
    order; that word is the hit. Items with a null id or text and items without words ask nothing; of repeated items each
    text asks. Every document gives a row: null and empty texts have no words; repeated rows and null ids have one each. An
    empty benchmark leaves every document clean; no documents give no rows.
    """
    answers = []
    for block in _passes(items, item_col, item_text):
        phrases = Phrases([tuple(r) for r in block.collect()], window)
        index = stage_table(build_index(docs, phrases.terms, id_col, text_col), "postings")
        answers.append(_ask(index, phrases, slop))
    if len(answers) == 1:
        return answers[0]
    # Rows with one key have equal texts, so one of them speaks for all.
    found = [a.filter(F.size("items") > 0).dropDuplicates(["row"]).select("row", "items", "hits") for a in answers]
    union = found[0]
    for more in found[1:]:
        union = union.unionAll(more)
    merged = union.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("_all"))
    start = F.col("_all")[0]
    joined = F.aggregate(
        F.slice("_all", 2, F.size("_all")), F.array(start),
        lambda acc, r: F.when(
            r["start"] <= F.element_at(acc, -1)["end"],
            F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], r["end"]).alias("end"))),
        ).otherwise(F.array_append(acc, r)),
    )
    rows = answers[0].select("row", "doc_id", "n_words").join(merged.select("row", "items", joined.alias("hits")), "row", "left")
    return rows.select("row", "doc_id", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("hits", F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("hits"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs."""
    bad = find_contamination(docs, items, id_col, text_col).filter(F.size("hits") > 0).select("row").distinct()
    bad = small_or_shuffled(stage_table(bad, "contaminated"))
    return packed(docs, id_col, text_col).join(bad, "row", "left_anti").select("all.*")


def digest(found: DataFrame) -> DataFrame:
    """The columns that state a result in numbers: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )

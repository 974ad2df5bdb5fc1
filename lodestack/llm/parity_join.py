"""Near duplicates by Jaccard similarity of word shingles: a parity-sketch join.

A text's shingles are tossed into 2**(level - 1) parts by their hash, one or two to a part on average. Inside a part every shingle toggles one bit of a wide, sparse
sketch, which is kept as its key (the XOR of the bits' keys). One shingle in only one of two sets changes at most one part, so
the number of parts that differ is a lower bound of the symmetric difference, as is the Hamming distance of dense sketches.

Sets with a Jaccard similarity of p / q or more differ in at most (q - p) / (q + p) of their summed sizes: D. By the
pigeonhole principle they agree in all but D parts, so in any one order of part keys each has a common key among its first
D + 1. The order puts keys that the corpus repeats last, the commonest at the end (estimated by a merged map of hash cells; any
estimate gives right results), and among equals those of parts with several shingles first, as chance hardly repeats them. So
neither passages that many texts share nor single common shingles produce candidates. Sizes fall into bands of one level each;
a set also joins the next band if a partner may lie there.

Among the first D + 1 + t keys of each, such sets even have 1 + t keys in common. So pairs of keys that a few sets hold are
counted, and only those with 1 + t are candidates: texts that share a passage or some shingle by chance have fewer, and the
components of candidates stay those of similar texts however large the corpus is and whatever the map can tell. Keys that more
sets hold give stars around one member, never pairs of a group, and these count at once. The components are verified: dense sketches
sort out most pairs, exact intersections decide, and pairs that are already connected are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import hashing as H
from lodestack.llm.common import components, only_known, small_or_shuffled
from lodestack.llm.spans import keyed, packed, with_ranges
from lodestack.session import stage_table

SHINGLE, P, Q = 5, 3, 4
#: Smallest level; entries sorted at once and per bucket; sets of a cluster compared at once, and their shingles.
LEVEL, FLUSH, BUCKET, CLUSTER, WEIGHT = 6, 500_000, 1_000_000, 2_048, 1_000_000
#: Sets of a key whose pairs are counted; more are a star.
FEW = 8
#: Bits of the dense sketches.
DENSE = 2048
#: The map of repeated cells has at most 2**MAP places of two bits (32 MB), which go to every executor.
MAP = 27
U = np.uint64


def shingle_portions(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sets, sizes) of some texts at a time: their sorted distinct shingle hashes one after the other, and how many
    each text has. A text with fewer words than a shingle is one shingle, one without words none."""
    for lo, _, data, offsets in H.portions(column):
        _, _, hashes, first = H.words(data, offsets, H.SPACED)
        sums = H.word_sums(hashes)
        n = np.diff(first)
        size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        end = np.cumsum(size)
        own = np.repeat(np.arange(len(n)), size)
        out = np.empty(len(own), U)
        out[n[own] >= k] = sums.windows(k)[H.fitting(first, k)]
        short = np.flatnonzero((n > 0) & (n < k))
        out[end[short] - 1] = sums.runs(first[short], first[short] + n[short])
        for a, b in zip((end - size).tolist(), end.tolist()):
            out[a:b].sort()
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != out[:-1]) | (own[1:] != own[:-1])
        yield lo, out[keep], np.bincount(own[keep], minlength=len(n))


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for lo, flat, sizes in shingle_portions(column, k):
        for i, s in enumerate(_split(flat, sizes)):
            yield lo + i, s


def _split(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    end = np.cumsum(sizes)
    return [flat[a:b] for a, b in zip((end - sizes).tolist(), end.tolist())]


def set_keys(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit keys of sets, as signed integers: equal sets have equal keys, an empty one 0."""
    out, some = np.zeros(len(sizes), np.int64), sizes > 0
    if some.any():
        at = (np.cumsum(sizes) - sizes)[some]
        spread = H.mix(flat + U(0x632BE59BD9B4E019))
        both = np.add.reduceat(spread, at) ^ np.bitwise_xor.reduceat(spread, at) * U(0x9FB21C651E98DF25) ^ sizes[some].astype(U)
        out[some] = H.mix(both).view(np.int64)
    return out


def differing(a: int, b: int, p: int = P, q: int = Q) -> int:
    """Largest symmetric difference of sets of sizes a and b whose Jaccard similarity is at least p / q."""
    return (q - p) * (a + b) // (q + p)


def _asked(n: int) -> int:
    """Keys, 1 + t, that a set of n emits beyond D: similar sets have as many in common as the lesser of theirs. Few enough that
    parts which are not empty suffice."""
    return 1 + min(254, n // (24 if n > 1 << LEVEL else 32))


def _bands(n: int) -> list[tuple[int, int]]:
    """(level, number of part keys) to emit for a set of n."""
    level, most = max(LEVEL, (n - 1).bit_length()), Q * n // P
    out = [(level, differing(n, min(most, 1 << level)) + _asked(n))]
    if most > 1 << level:
        out.append((level + 1, differing(n, most) + _asked(n)))
    return out


def part_key_lists(flat: np.ndarray, sizes: np.ndarray, levels: np.ndarray, needs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, how many each set has) of sets that are not empty: keys of the parts that are not empty; of empty ones too, if
    those are fewer than needed. The lowest bit of a key is 0 if its part holds several shingles."""
    if not len(sizes):
        return np.empty(0, U), np.empty(0, np.int64)
    own, level = np.repeat(np.arange(len(sizes)), sizes), levels.astype(U)
    part = flat >> (U(65) - level)[own]
    cut = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (own[1:] != own[:-1])])
    alone = np.diff(np.r_[cut, len(part)]) == 1
    toggled, part, own = np.bitwise_xor.reduceat(H.mix(flat), cut), part[cut], own[cut]
    keys = H.mix(toggled ^ H.mix((part << U(8)) + level[own])) & ~U(1) | alone.astype(U)
    counts = np.bincount(own, minlength=len(sizes))
    few = np.flatnonzero(counts < needs)
    if len(few):
        lists, parts = _split(keys, counts), _split(part, counts)
        for i in few.tolist():
            empty = np.setdiff1d(np.arange(1 << int(levels[i]) - 1).astype(U), parts[i])
            more = H.mix(H.mix((empty << U(8)) + level[i]) ^ U(0xE7037ED1A0B428DB)) | U(1)
            lists[i] = np.concatenate([lists[i], np.sort(more)[: needs[i] - counts[i]]])
        keys, counts = np.concatenate(lists), np.array([len(x) for x in lists])
    return keys, counts


def part_keys(s: np.ndarray, level: int, need: int) -> np.ndarray:
    """The part keys of one set."""
    return part_key_lists(s, np.array([len(s)]), np.array([level]), np.array([need]))[0]


def banded_keys(flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(sets, needed, keys, how many each has) of the first and of the second bands of sets."""
    bands = [_bands(n) if n else [] for n in sizes.tolist()]
    for turn in (0, 1):
        here = np.array([len(b) > turn for b in bands], bool)
        which = np.flatnonzero(here)
        if len(which):
            levels, needs = np.array([bands[i][turn] for i in which.tolist()]).T
            yield which, needs, *part_key_lists(flat[np.repeat(here, sizes)], sizes[which], levels, needs)


_WIDTHS = [(w, (1 << 8 * w) - 1) for w in (1, 2, 4)]


def _gaps(keys: np.ndarray, bits: int, shard_bits: int) -> list[tuple[int, bytes]]:
    """(shard, cells) of part keys: the upper ``bits`` of each, ascending, as distances in numbers of the width that needs least
    bytes. The greatest number adds to the next one."""
    cell = np.sort(keys >> U(64 - bits)).astype(np.int64)
    shard = cell >> (bits - shard_bits)
    cut = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(cell)]
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        gap = np.diff(cell[a:b], prepend=int(shard[a]) << (bits - shard_bits))
        more, width, most = min(((gap // m, w, m) for w, m in _WIDTHS), key=lambda x: x[1] * (len(gap) + int(x[0].sum())))
        line = np.full(len(gap) + int(more.sum()), most, f"u{width}")
        line[np.cumsum(more + 1) - 1] = gap % most
        out.append((int(shard[a]), bytes([width]) + line.tobytes()))
    return out


def _ungapped(cells: bytes) -> np.ndarray:
    """The cells of a shard, from its first one, of one line of ``_gaps``."""
    line = np.frombuffer(cells, f"u{cells[0]}", offset=1)
    return np.cumsum(line.astype(np.int64))[line != np.iinfo(line.dtype).max]


def _measure(rows: DataFrame, bits: int, shard_bits: int) -> DataFrame:
    """Rows (row, doc_id, n, node, emits: how many part keys), and the cells of all part keys as (shard, cells)."""
    names = ["row", "doc_id", "n", "node", "emits", "shard", "cells"]
    kinds = [pa.int64()] * 6 + [pa.binary()]

    def told(keys: list) -> pa.RecordBatch:
        shards, cells = zip(*_gaps(np.concatenate(keys), bits, shard_bits))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((*[[None] * len(shards)] * 5, shards, cells), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            sizes, nodes, emits = [], [], []
            for _, flat, size in shingle_portions(batch.column("text")):
                emit = np.zeros(len(size), np.int64)
                for which, needs, keys, _ in banded_keys(flat, size):
                    held.append(keys)
                    n += len(keys)
                    emit[which] += needs
                sizes.append(size)
                nodes.append(set_keys(flat, size))
                emits.append(emit)
                if n >= 2 * FLUSH:  # more at once lie closer together
                    yield told(held)
                    held, n = [], 0
            sizes, nodes, emits = (np.concatenate([np.empty(0, np.int64), *x]) for x in (sizes, nodes, emits))
            none = [None] * len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((batch.column("row"), batch.column("doc_id"), sizes, nodes, emits, none, none), kinds)], names)
        if n:
            yield told(held)

    return rows.mapInArrow(run, "row long, doc_id long, n long, node long, emits long, shard long, cells binary")


def _classes(measured: DataFrame, bits: int, shard_bits: int) -> np.ndarray:
    """How often the corpus repeats each cell, in four classes packed by two bits: below a least count, and from that count,
    eight and sixty-four times it. The least count is the smallest power of two that leaves three of four places of the map
    free, so the map of fixed size tells keys apart however large the corpus is, and the commonest always stand out."""
    width, fold = 1 << (bits - shard_bits), max(0, bits - MAP)

    def merge(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        times = np.bincount(np.concatenate([_ungapped(x) for x in df["cells"]]), minlength=width)
        at = np.flatnonzero(times > 1)
        order = np.int64(key[0]) * width + at >> fold
        power = np.frexp(times[at].astype(np.float64))[1] - 1
        out = [(p, int((power == p).sum()), order[power == p].astype(np.uint32).tobytes()) for p in np.unique(power).tolist()]
        return pd.DataFrame(out, columns=["power", "n", "places"])

    cells = measured.filter("cells is not null").select("shard", "cells")
    found = stage_table(cells.groupBy("shard").applyInPandas(merge, "power int, n long, places binary"), "repeated")
    counts = {r["power"]: r["n"] for r in found.groupBy("power").agg(F.sum("n").alias("n")).collect()}
    least, left = max(counts, default=1) + 1, (1 << MAP) // 4
    while least > 1 and counts.get(least - 1, 0) <= left:
        least -= 1
        left -= counts.get(least, 0)
    out = np.zeros(1 << min(bits, MAP) - 2, np.uint8)
    for r in found.filter(F.col("power") >= least).select("power", "places").toLocalIterator():
        # Places that several cells share get the union of their bits, which is no less than the greatest class.
        at = np.frombuffer(r["places"], np.uint32)
        np.bitwise_or.at(out, at >> 2, np.uint8(min(3, 1 + (r["power"] - least) // 3)) << (at & 3).astype(np.uint8) * np.uint8(2))
    return out


def _sharing(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first of its key, number of nodes with its key, place among them) of every entry; keys sorted."""
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.r_[cut, len(key)])
    lead = np.repeat(cut, size)
    return lead, np.repeat(size, size), np.arange(len(key)) - lead


def _star(node: np.ndarray, lead: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Distinct (member, leader) of nodes that share a key with more than a few, the leader being the smallest."""
    own = (size > FEW) & (lead != np.arange(len(node)))
    return np.unique(np.stack([node[own], node[lead[own]]], 1), axis=0)


def _pairs(key: np.ndarray, node: np.ndarray, asked: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(smaller, greater, how many keys, how many are asked) of pairs of nodes that share a key with a few only."""
    few = size <= FEW
    key, node, asked = key[few], node[few], asked[few]
    a, b = zip(*[(at, at + k) for k in range(1, FEW) for at in [np.flatnonzero(key[k:] == key[:-k])]])
    a, b = np.concatenate(a), np.concatenate(b)
    by = np.lexsort((node[b], node[a]))
    a, b = a[by], b[by]
    cut = np.flatnonzero(np.r_[True, (node[a][1:] != node[a][:-1]) | (node[b][1:] != node[b][:-1])]) if len(a) else np.empty(0, np.int64)
    times = np.diff(np.r_[cut, len(a)])
    a, b = a[cut], b[cut]
    return np.stack([node[a], node[b], times, np.minimum(asked[a], asked[b])], 1)


def _candidates(rows: DataFrame, repeated: np.ndarray, bits: int, buckets: int) -> DataFrame:
    """Edges (a, b) between nodes such that nodes with as many common prefix keys as are asked of them are connected. They
    are staged, which ends the use of the map."""
    shared = rows.sparkSession.sparkContext.broadcast(repeated)
    blob = "bucket long, nodes binary, asked binary, sizes binary, keys binary, edges binary"

    def flush(keys: list, nodes: list, asked: list) -> Iterator[pa.RecordBatch]:
        """Nodes of one task that share a key with more than a few are joined here; only as many go on under that key as make
        it one of more than a few."""
        sizes = np.array([len(k) for k in keys])
        key, node, ask = np.concatenate(keys), np.repeat(np.array(nodes, np.int64), sizes), np.repeat(np.array(asked, np.uint8), sizes)
        by = np.lexsort((node, key))
        key, node, ask = key[by], node[by], ask[by]
        lead, size, place = _sharing(key)
        edges, on = _star(node, lead, size), place <= FEW
        key, node, ask = key[on], node[on], ask[on]
        bucket = ((key >> U(40)) % U(buckets)).astype(np.int64)
        by = np.lexsort((node, bucket))
        key, node, ask, bucket = key[by], node[by], ask[by], bucket[by]
        cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
        out = []
        for low, high in zip(cut[:-1], cut[1:]):
            own, first, n = np.unique(node[low:high], return_index=True, return_counts=True)
            low40 = key[low:high]
            packed = (low40 & U(0xFFFFFFFF)).astype(np.uint32).tobytes() + (low40 >> U(32)).astype(np.uint8).tobytes()
            out.append((int(bucket[low]), own.tobytes(), ask[low:high][first].tobytes(), n.astype(np.min_scalar_type(n.max())).tobytes(), packed, b""))
        for i, at in enumerate(range(0, len(edges), 100_000)):
            out.append((i % buckets, b"", b"", b"", b"", edges[at:at + 100_000].tobytes()))
        kinds = [pa.int64()] + [pa.binary()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["bucket", "nodes", "asked", "sizes", "keys", "edges"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, seen, keys, nodes, asked, held = shared.value, set(), [], [], [], 0
        for batch in batches:
            for _, flat, sizes in shingle_portions(batch.column("text")):
                ids, fresh = set_keys(flat, sizes), np.zeros(len(sizes), bool)
                for i, (node, n) in enumerate(zip(ids.tolist(), sizes.tolist())):
                    if n and node not in seen:
                        seen.add(node)
                        fresh[i] = True
                flat, sizes, ids = flat[np.repeat(fresh, sizes)], sizes[fresh], ids[fresh]
                least = [_asked(n) for n in sizes.tolist()]
                for which, needs, every, counts in banded_keys(flat, sizes):
                    cell = (every >> U(64 - min(bits, MAP))).astype(np.int64)
                    often = repeated[cell >> 2] >> (cell & 3).astype(np.uint8) * np.uint8(2) & np.uint8(3)
                    rank = every >> U(3) | often.astype(U) << U(62) | (every & U(1)) << U(61)
                    for own, order, need in zip(_split(every, counts), _split(rank, counts), needs.tolist()):
                        keys.append(own[np.argpartition(order, need - 1)[:need]] if len(own) > need else own)
                    nodes += ids[which].tolist()
                    asked += [least[i] for i in which.tolist()]
                    held += int(np.minimum(counts, needs).sum())
                if held >= FLUSH:
                    yield from flush(keys, nodes, asked)
                    seen, keys, nodes, asked, held = set(), [], [], [], 0
        if keys:
            yield from flush(keys, nodes, asked)

    def join(df: pd.DataFrame) -> pd.DataFrame:
        keys, nodes, asks, edges = [np.empty(0, U)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)], [np.empty((0, 2), np.int64)]
        for own, asked, sizes, packed, pairs in zip(df["nodes"], df["asked"], df["sizes"], df["keys"], df["edges"]):
            n, times = len(packed) // 5, np.frombuffer(sizes, f"u{len(sizes) // len(asked)}" if asked else np.uint8)
            keys.append(np.frombuffer(packed, np.uint32, n).astype(U) | np.frombuffer(packed, np.uint8, n, 4 * n).astype(U) << U(32))
            nodes.append(np.repeat(np.frombuffer(own, np.int64), times))
            asks.append(np.repeat(np.frombuffer(asked, np.uint8), times))
            edges.append(np.frombuffer(pairs, np.int64).reshape(-1, 2))
        key, node, ask = np.concatenate(keys), np.concatenate(nodes), np.concatenate(asks)
        by = np.argsort(key)
        key, node, ask = key[by], node[by], ask[by]
        same = np.r_[False, key[1:] == key[:-1]] if len(key) else np.empty(0, bool)
        same[:-1] |= same[1:]
        key, node, ask = key[same], node[same], ask[same]
        by = np.lexsort((node, key))
        key, node, ask = key[by], node[by], ask[by]
        # Copies of a set come from several tasks.
        once = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(key) else np.empty(0, bool)
        key, node, ask = key[once], node[once], ask[once]
        lead, size, _ = _sharing(key)
        star = np.unique(np.concatenate([*edges, _star(node, lead, size)]), axis=0)
        star = np.concatenate([star, np.zeros_like(star)], 1)
        return pd.DataFrame(np.concatenate([star, _pairs(key, node, ask.astype(np.int64), size)]), columns=["a", "b", "times", "asked"])

    edges = stage_table(rows.select("text").mapInArrow(emit, blob).groupBy("bucket").applyInPandas(join, "a long, b long, times long, asked long"), "edges")
    shared.destroy()
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("times").alias("times"), F.min("asked").alias("asked")).filter("times >= asked").select("a", "b")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x


def linked(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets which a chain of similar pairs connects; with ``side``, of pairs with different sides only."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    tokens, code = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    codes = [code[e - n:e] for e, n in zip(ends, sizes)]
    dense = np.zeros((len(sets), DENSE), np.uint8)
    bit = ((H.mix(tokens) >> U(32)).astype(np.int64) % DENSE)[code]
    np.add.at(dense.reshape(-1), np.repeat(np.arange(len(sets)), sizes) * DENSE + bit, np.uint8(1))  # a byte keeps the parity
    dense &= 1
    dense = np.packbits(dense, axis=1).view(U)
    forest, mark, found = _Forest(len(sets)), np.zeros(len(tokens), bool), []
    ranked, packed = sizes[order], dense[order]
    for place, x in enumerate(order.tolist()):
        low = np.searchsorted(ranked, -(-P * sizes[x] // Q))
        if low >= place:
            continue
        apart = np.bitwise_count(packed[low:place] ^ dense[x]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(apart <= (Q - P) * (ranked[low:place] + sizes[x]) // (Q + P))
        if not len(near):
            continue
        mark[codes[x]] = True
        for y in order[low + near[np.argsort(apart[near], kind="stable")]].tolist():
            if (side is not None and side[x] == side[y]) or forest.find(x) == forest.find(y):
                continue
            common = int(np.count_nonzero(mark[codes[y]]))
            if Q * common >= P * (sizes[x] + sizes[y] - common):
                forest.up[forest.find(x)] = forest.find(y)
                found.append((x, y))
        mark[codes[x]] = False
    return found


def _verified(members: DataFrame) -> DataFrame:
    """Edges (a, b) that connect, within each cluster of ``members`` (root, node, i, j, half, task, text), what is linked."""

    def verify(df: pd.DataFrame) -> pd.DataFrame:
        # Repeated rows bring their text more than once.
        df = df.drop_duplicates(["root", "i", "j", "node"]).sort_values(["root", "i", "j"], kind="stable")
        sets = [s for _, s in shingle_sets(pa.array(df["text"], pa.large_string()))]
        root, i, j, nodes, side = (df[c].to_numpy() for c in ("root", "i", "j", "node", "half"))
        cut = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        out = []
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(df)]):
            out += [(nodes[lo + a], nodes[lo + b]) for a, b in linked(sets[lo:hi], None if i[lo] == j[lo] else side[lo:hi])]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return members.groupBy("task").applyInPandas(verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_shingles, component_id, component of every row.

    Words are runs of bytes other than space and \\t to \\r, A-Z lower-cased. A set holds the distinct 5-word shingles of a
    text, or its whole word sequence if that is shorter. Two rows link if their sets have a Jaccard similarity of 0.75 or
    more; equal sets do. ``component_id`` is the smallest id that links reach, ``component`` a key of all that links reach. Null texts and texts without words have an
    empty set and link with nothing, so they are components of their own. Repeated rows link; null ids are never the
    smallest, and a component of null ids only is null. An empty table gives no rows.
    """
    rows = keyed(docs, id_col, text_col)
    # Some ten cells for each key, and a shard for each two million cells; a shard has at least a byte of the map.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(16, int(2 * size).bit_length())
    shard_bits = min(max(0, bits - 21), MAP - 3)
    measured = stage_table(_measure(rows, bits, shard_bits), "sets")
    sets = measured.filter("cells is null").select("row", "doc_id", "n", "node")
    total = measured.agg(F.sum("emits")).first()[0] or 0
    edges = _candidates(rows, _classes(measured, bits, shard_bits), bits, max(1, -(-total // BUCKET)))
    clusters = components(edges).withColumnRenamed("id", "node")
    holders = sets.filter("n > 0").groupBy("node").agg(F.min("row").alias("row"), F.max("n").alias("n"))
    members = stage_table(clusters.join(holders, "node"), "members")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / CLUSTER, F.sum("n") / WEIGHT)).alias("blocks")
    crowds = members.groupBy("root").agg(blocks)
    # A cluster of several blocks is compared block against block.
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = members.join(crowds, "root").withColumn("block", block).withColumn("other", other)
    placed = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    tasks = max(1, members.agg(blocks).first()[0] or 0)
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.xxhash64("root", "i", "j"))
    placed = placed.select("row", "root", "node", "i", "j", (F.col("block") == F.col("i")).alias("half"), task.alias("task"))
    # Where the places are too many to be sent to all, only texts of candidates are shuffled.
    texts = only_known(rows.select("row", "text"), members.select("row"), "row", exact=False)
    links = _verified(with_ranges(texts, placed, "inner"))
    roots = components(links).select(F.col("id").alias("node"), "root")
    joined = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = joined.join(least, "root", "left")
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("root")).alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near duplicates: the one of the smallest id, ids before null. Rows without
    words stay. Of rows that agree in id and text one stays."""
    found = stage_table(near_duplicates(docs, id_col, text_col).filter("component is not null"), "components")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("first"))
    gone = small_or_shuffled(stage_table(found.join(first, "component").filter("row <> first").select("row").distinct(), "gone"))
    again = stage_table(found.groupBy("row").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("row"), "repeated")
    rows = packed(docs, id_col, text_col).join(gone, "row", "left_anti")
    if not again.isEmpty():
        again = small_or_shuffled(again)
        rows = rows.join(again, "row", "left_anti").unionAll(rows.join(again, "row", "left_semi").dropDuplicates(["row"]))
    return rows.select("all.*")

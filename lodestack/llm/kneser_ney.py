"""Language-model scores: an interpolated modified Kneser-Ney model of word pairs, counted in Spark, read as mapped arrays.

Counting. Tasks sum the tokens of their texts locally and deal sorted blocks of hashes to buckets. Word counts come first;
pairs are then dealt by their first word, and those of words that would fill a bucket alone by their second. A bucket of pairs
knows their exact counts, and tells the word buckets how many different followers (with count 1, 2, 3 or more) a word has and
how many different words precede it.

Storage. Each bucket becomes sorted hash arrays in the shared folder, counts in as few bytes as they need. With ``single`` pairs
counted once are kept like all others. Without it they are left out of the arrays, and their whole mass goes to the lower
order, so every distribution still sums to one.

Scoring. Workers map the arrays, look the sorted hashes of a portion of texts up, and sum log10 probabilities by text.
"""

from __future__ import annotations

import io
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import hashing as H
from lodestack.llm.common import fold
from lodestack.session import scratch_path, stage_table

U = np.uint64
BEGIN, END, PAIR = U(0x1B873593CC9E2D51), U(0x85EBCA6BC2B2AE35), U(0xA0761D6478BD642F)
#: Tokens summed in a task before they are dealt; text bytes behind one bucket of pairs, and of words.
FLUSH, PAIR_BYTES, WORD_BYTES = 1_500_000, 4 << 20, 16 << 20
_BLOB = "bucket long, kind int, keys binary, more binary, sizes binary, values binary"


def tokens(column: pa.Array, size: int = H.PORTION) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes, tokens before each row): lower-cased words and one end for every text."""
    for lo, _, data, offsets in H.portions(column, size):
        _, _, hashes, first = H.words(data, offsets, H.SPACED)
        out = np.full(len(hashes) + len(first) - 1, END, U)
        out[np.arange(len(hashes)) + H.owners(first)] = hashes
        yield lo, out, first + np.arange(len(first))


def _before(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.r_[BEGIN, token[:-1]]
    out[first[:-1]] = BEGIN
    return out


def _pairs(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return H.mix(before * PAIR ^ H.mix(token))


def _bucket(word: np.ndarray, bits: int) -> np.ndarray:
    return (word >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(word), np.int64)


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in the sorted keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == x, at, -1)


def _cuts(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), len(x)] if len(x) else np.zeros(1, np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "kind", "keys", "more", "sizes", "values"])


def _by_bucket(keys: np.ndarray, values: np.ndarray, kind: int, bits: int) -> list[tuple]:
    """Sorted word keys and their values as one row per word bucket."""
    cut = _cuts(_bucket(keys, bits))
    return [(int(keys[a] >> U(64 - bits)) if bits else 0, kind, keys[a:b].tobytes(), b"", b"", values[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]


class Folder:
    """Files of arrays in the shared folder. Local ones are mapped in place; of others a worker fetches a copy once."""

    def __init__(self, uri: str):
        self.uri = uri

    def _at(self, name: str) -> tuple[pafs.FileSystem, str]:
        system, path = pafs.FileSystem.from_uri(self.uri)
        return system, f"{path}/{name}"

    def save(self, name: str, array: np.ndarray) -> None:
        """A file appears whole or not at all; a task that runs again writes the same."""
        system, path = self._at(name)
        system.create_dir(os.path.dirname(path), recursive=True)
        data = io.BytesIO()
        np.save(data, array)
        trial = f"{path}.{os.getpid()}-{os.urandom(6).hex()}"
        with system.open_output_stream(trial) as out:
            out.write(data.getbuffer())
        system.move(trial, path)

    def load(self, name: str) -> np.ndarray | None:
        system, path = self._at(name)
        if isinstance(system, pafs.LocalFileSystem):
            return np.load(path, mmap_mode="r") if os.path.exists(path) else None
        if system.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        own = f"{_COPIES.setdefault(self.uri, tempfile.mkdtemp())}/{name}"
        if not os.path.exists(own):
            pafs.copy_files(path, own, source_filesystem=system, destination_filesystem=pafs.LocalFileSystem())
        return np.load(own, mmap_mode="r")


_COPIES: dict[str, str] = {}
_OPEN: dict[tuple[str, str], np.ndarray | None] = {}


@dataclass
class Model:
    folder: Folder
    word_bits: int
    pair_bits: int
    #: Words whose pairs are spread over all buckets, ascending.
    heavy: np.ndarray
    tokens: int
    words: int
    #: Numbers of pairs with count 1 to 4, of words with 1 to 4 predecessors, and of different pairs.
    pair_counts: np.ndarray
    word_counts: np.ndarray
    kinds: int
    #: Whether pairs counted once are stored.
    single: bool = False
    discounts: tuple[np.ndarray, np.ndarray] = field(init=False)

    def __post_init__(self):
        self.discounts = _discounts(self.pair_counts), _discounts(self.word_counts)

    def _open(self, name: str) -> np.ndarray | None:
        if (self.folder.uri, name) not in _OPEN:
            _OPEN[self.folder.uri, name] = self.folder.load(name)
        return _OPEN[self.folder.uri, name]

    def look_up_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, [followers with count 1, 2, 3 or more, predecessors]) of ascending words."""
        count, more = np.zeros(len(words), np.int64), np.zeros((len(words), 4), np.int64)
        cut = _cuts(_bucket(words, self.word_bits))
        for a, b in zip(cut[:-1], cut[1:]):
            shard = int(words[a] >> U(64 - self.word_bits)) if self.word_bits else 0
            keys = self._open(f"word-{shard}.keys.npy")
            if keys is not None:
                at = _member(keys, words[a:b])
                hit = np.flatnonzero(at >= 0)
                count[a + hit] = self._open(f"word-{shard}.count.npy")[at[hit]]
                more[a + hit] = self._open(f"word-{shard}.more.npy")[at[hit]]
        return count, more

    def look_up_pairs(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Count of each pair, 0 if it is not stored."""
        key, out = _pairs(before, token), np.zeros(len(token), np.int64)
        bucket = np.where(_member(self.heavy, before) >= 0, _bucket(token, self.pair_bits), _bucket(before, self.pair_bits))
        order = np.lexsort((key, bucket))
        cut = _cuts(bucket[order])
        for a, b in zip(cut[:-1], cut[1:]):
            shard, own = int(bucket[order[a]]), order[a:b]
            keys = self._open(f"pair-{shard}.keys.npy")
            if keys is not None:
                at = _member(keys, key[own])
                hit = at >= 0
                out[own[hit]] = self._open(f"pair-{shard}.count.npy")[at[hit]]
        return out

    def score(self, token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base log10 probability, log10 probability) of each text."""
        before = _before(token, first)
        words = np.unique(np.r_[token, BEGIN])
        count, more = self.look_up_words(words)
        count_at, ahead = count.copy(), np.searchsorted(words, token)
        back = np.searchsorted(words, before)
        # Every word is followed by one token, the beginning by one in each text.
        total = count
        total[words == END] = 0
        ends = int(count_at[np.searchsorted(words, END)])
        total[words == BEGIN] = ends
        pair, low = self.discounts
        kept = more[:, 3] - low[np.minimum(more[:, 3], 3)]
        spread = float(low[1:] @ np.r_[self.word_counts[:2], self.words - self.word_counts[:2].sum()]) if self.kinds else 1.0
        unigram = (np.maximum(kept, 0) + spread / (self.words + 1)) / max(self.kinds, 1)
        # All mass of pairs that are not stored is the lower order's.
        rest = np.where(total > 0, ((pair[1] if self.single else 1) * more[:, 0] + pair[2] * more[:, 1] + pair[3] * more[:, 2]) / np.maximum(total, 1), 1.0)
        seen = self.look_up_pairs(before, token)
        own = np.where(seen > 0, seen - pair[np.minimum(seen, 3)], 0) / np.maximum(total[back], 1)
        value = np.log10(own + rest[back] * unigram[ahead])
        base = np.log10((count_at + 0.1) / (self.tokens + 0.1 * (self.words + 1)))[ahead]
        at = first[:-1]
        return np.add.reduceat((count_at > 0)[ahead].astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(value, at)


def _discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from the numbers of counts 1 to 4; k / 2 where those do not give one."""
    out, y = np.array([0.0, 0.5, 1.0, 1.5]), n[0] / max(n[0] + 2 * n[1], 1)
    for k in (1, 2, 3):
        if n[k - 1] > 0:
            d = k - (k + 1) * y * n[k] / n[k - 1]
            out[k] = d if 0 < d < k else out[k]
    return out


def _word_counts(rows: DataFrame, bits: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, token, _ in tokens(batch.column(0)):
                held.append(token)
                n += len(token)
                if n >= FLUSH:
                    keys, count = np.unique(np.concatenate(held), return_counts=True)
                    yield _batch(_by_bucket(keys, count, 0, bits))
                    held, n = [], 0
        if n:
            keys, count = np.unique(np.concatenate(held), return_counts=True)
            yield _batch(_by_bucket(keys, count, 0, bits))

    def merge(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        words = np.concatenate([np.frombuffer(x, U) for x in df["keys"]])
        count = np.concatenate([np.frombuffer(x, np.int64) for x in df["values"]])
        order = np.argsort(words)
        cut = _cuts(words[order])
        return pd.DataFrame([(key[0], 0, words[order][cut[:-1]].tobytes(), b"", b"", np.add.reduceat(count[order], cut[:-1]).tobytes())], columns=["bucket", "kind", "keys", "more", "sizes", "values"])

    return rows.select("text").mapInArrow(emit, _BLOB).groupBy("bucket").applyInPandas(merge, _BLOB)


def _pair_counts(rows: DataFrame, heavy: np.ndarray, bits: int, word_bits: int, folder: Folder, single: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(heavy)

    def deal(before: np.ndarray, token: np.ndarray) -> pa.RecordBatch:
        _, at, count = np.unique(_pairs(before, token), return_index=True, return_counts=True)
        before, token = before[at], token[at]
        bucket = np.where(_member(shared.value, before) >= 0, _bucket(token, bits), _bucket(before, bits))
        order = np.lexsort((before, bucket))
        before, token, bucket, count = before[order], token[order], bucket[order], count[order].astype(np.uint32)
        cut, rows = _cuts(bucket), []
        for a, b in zip(cut[:-1], cut[1:]):
            own = _cuts(before[a:b])
            rows.append((int(bucket[a]), 1, before[a:b][own[:-1]].tobytes(), token[a:b].tobytes(), np.diff(own).astype(np.uint32).tobytes(), count[a:b].tobytes()))
        return _batch(rows)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, token, n = [], [], 0
        for batch in batches:
            for _, own, first in tokens(batch.column(0)):
                before.append(_before(own, first))
                token.append(own)
                n += len(own)
                if n >= FLUSH:
                    yield deal(np.concatenate(before), np.concatenate(token))
                    before, token, n = [], [], 0
        if n:
            yield deal(np.concatenate(before), np.concatenate(token))

    def count(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        before = np.concatenate([np.repeat(np.frombuffer(k, U), np.frombuffer(s, np.uint32)) for k, s in zip(df["keys"], df["sizes"])])
        token = np.concatenate([np.frombuffer(x, U) for x in df["more"]])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in df["values"]]).astype(np.int64)
        pair = _pairs(before, token)
        order = np.argsort(pair)
        pair = pair[order]
        cut = _cuts(pair)
        at = order[cut[:-1]]
        n, before, token, pair = np.add.reduceat(n[order], cut[:-1]), before[at], token[at], pair[cut[:-1]]
        stored = n > (0 if single else 1)
        folder.save(f"pair-{key[0]}.keys.npy", pair[stored])
        folder.save(f"pair-{key[0]}.count.npy", n[stored].astype(np.min_scalar_type(int(n.max()))))
        order = np.argsort(before)
        cut = _cuts(before[order])
        followers = np.stack([np.add.reduceat(low(n[order]).astype(np.int64), cut[:-1]).astype(np.uint32) for low in (lambda x: x == 1, lambda x: x == 2, lambda x: x > 2)], 1)
        rows = _by_bucket(before[order][cut[:-1]], followers, 1, word_bits)
        later, times = np.unique(token, return_counts=True)
        rows += _by_bucket(later, times.astype(np.uint32), 2, word_bits)
        rows.append((0, 3, b"", b"", b"", np.array([(n == k).sum() for k in (1, 2, 3, 4)] + [len(n)], np.int64).tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "kind", "keys", "more", "sizes", "values"])

    return rows.select("text").mapInArrow(emit, _BLOB).groupBy("bucket").applyInPandas(count, _BLOB)


def _save_words(parts: DataFrame, folder: Folder) -> DataFrame:
    """Word arrays from word counts and what the pair buckets tell; (pairs, words) numbers for the discounts as blobs."""

    def save(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        words = np.unique(np.concatenate([np.frombuffer(x, U) for x in df["keys"]]))
        count, more, pairs = np.zeros(len(words), np.int64), np.zeros((len(words), 4), np.uint32), np.zeros(5, np.int64)
        for kind, keys, values in zip(df["kind"], df["keys"], df["values"]):
            at = np.searchsorted(words, np.frombuffer(keys, U))
            if kind == 0:
                count[at] += np.frombuffer(values, np.int64)
            elif kind == 1:
                more[at, :3] += np.frombuffer(values, np.uint32).reshape(-1, 3)
            elif kind == 2:
                more[at, 3] += np.frombuffer(values, np.uint32)
            else:
                pairs += np.frombuffer(values, np.int64)
        for name, array in (("keys", words), ("count", count), ("more", more)):
            folder.save(f"word-{key[0]}.{name}.npy", array)
        return pd.DataFrame([(pairs.tolist(), [int((more[:, 3] == k).sum()) for k in (1, 2, 3, 4)])], columns=["pairs", "words"])

    return parts.groupBy("bucket").applyInPandas(save, "pairs array<long>, words array<long>")


def train(rows: DataFrame, single: bool = False) -> Model:
    """Model of the texts of ``rows`` (text); with ``single`` pairs counted once are part of it. What the driver gets has a fixed size, but for the words that are spread over all
    buckets because they hold more than a quarter of a bucket's share: at most four for each bucket."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pair_bits, word_bits = (max(0, int(size // each).bit_length()) for each in (PAIR_BYTES, WORD_BYTES))
    folder = Folder(scratch_path(spark, "kneser-ney"))
    counts = stage_table(_word_counts(rows, word_bits), "words")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.frombuffer(x, np.int64) for x in batch.column("values").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in n], pa.int64()), pa.array([len(x) for x in n], pa.int64())], ["tokens", "words"])

    total = counts.mapInArrow(sums, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    n, words = total[0] or 0, total[1] or 0
    limit = n // (4 << pair_bits)

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, values in zip(batch.column("keys").to_pylist(), batch.column("values").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, U)[np.frombuffer(values, np.int64) > limit].view(np.int64))], ["word"])

    heavy = [r["word"] for r in counts.mapInArrow(crowded, "word long").collect()]
    heavy = np.sort(np.array([*heavy, int(np.array(BEGIN).view(np.int64))], np.int64).view(U))
    parts = counts.unionAll(_pair_counts(rows, heavy, pair_bits, word_bits, folder, single))
    told = stage_table(_save_words(parts, folder), "counts")
    sums_of = lambda c, k: [F.coalesce(F.sum(F.col(c)[i]), F.lit(0)) for i in range(k)]
    found = told.agg(*sums_of("pairs", 5), *sums_of("words", 4)).first()
    return Model(folder, word_bits, pair_bits, heavy, n, words, np.array(found[:4]), np.array(found[5:9]), found[4], single)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, single: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row.

    Tokens are words (runs of bytes other than space and \\t to \\r, A-Z lower-cased) and one end for each text; null counts as
    empty and is its end alone. The model learns from rows whose crc32(id as text) mod ``modulus`` is not 0, and scores all. A
    word it has not seen has the probability of one unknown word. Without training rows there are no known words, and each
    token's probability is one. ``single`` keeps the pairs that were counted once. Repeated rows and null ids (empty text for the fold) give a row each; an empty table none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, modulus) == 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(rows.filter(~F.col("held_out")).select("text"), single))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            size, known, base, value = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0)]
            for _, token, first in tokens(batch.column("text"), 2 * H.PORTION):
                size.append(np.diff(first))
                for out, x in zip((known, base, value), model.score(token, first)):
                    out.append(x)
            size, known, base, value = map(np.concatenate, (size, known, base, value))
            total = np.full(len(batch), model.tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *map(pa.array, (size, known, total, base, value, 10 ** (-value / np.maximum(size, 1))))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")

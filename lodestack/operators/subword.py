"""Subword vocabulary by byte-pair merges, and encoding to fixed-length id arrays.

Learning takes many merges in a round. Let lo be the count of some pair in the ranking. A merge changes only counts of pairs
beside it, and a new pair is at most as frequent as the one it replaces, so pairs with a count of at most lo cannot rise above
it. All words can therefore be cut at such pairs; what lies between, the segments, are few and short, and merging one pair at
a time within them is merging one pair at a time in the corpus, down to lo. One task does that for the segments of a round,
whose number is bounded, with an inverted index from pairs to segments and count changes; all words are then rewritten in
parallel. The driver sees the head of the ranking and the merges.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import SPACE_MARK, tokens
from lodestack.operators.skew import lookup_join, own_rows
from lodestack.session import stage_table

PAD, BOS, EOS, UNK = 0, 1, 2, 3
SPECIALS = ["<pad>", "<s>", "</s>", "<unk>"]
VOCAB_SIZE = 50_000
# Pairs of the ranking that reach the driver in a round, and segments that one task works on.
RANKED, SEGMENTS = 100_000, 250_000
# Segmented words that a task remembers.
KNOWN = 300_000
_JOIN = "\u0002"


class Model(NamedTuple):
    """Piece to id, and the merges in order. Both are bounded by the vocabulary size."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]]


def word_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct words with their counts, each preceded by the space mark; counting combines map-side."""
    words = df.select(F.explode(tokens(F.col(column))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("freq"))
    return words.select(F.concat(F.lit(SPACE_MARK), "w").alias("word"), "freq")


# --- learning ---------------------------------------------------------------------------------------------------


def _in_order(merges: list[tuple[str, str]]) -> dict[tuple[str, str], list[int]]:
    ranks: dict[tuple[str, str], list[int]] = defaultdict(list)
    for i, pair in enumerate(merges):
        ranks[pair].append(i)
    return dict(ranks)


def apply_merges(symbols: list[str], ranks: dict[tuple[str, str], list[int]]) -> list[str]:
    """What the merges make of a word when each is applied to all of it, from left to right, in their order.

    A heap of (rank, position) over a linked list: n log n in the symbols.
    """
    n = len(symbols)
    symbols, right, left = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, str, str]] = []

    def push(i: int, after: int) -> None:
        if i >= 0 and right[i] < n:
            for rank in ranks.get((symbols[i], symbols[right[i]]), ()):
                if rank > after:
                    heapq.heappush(heap, (rank, i, symbols[i], symbols[right[i]]))
                    break

    for i in range(n - 1):
        push(i, -1)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = right[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j], right[i] = a + b, None, right[j]
        if right[j] < n:
            left[right[j]] = i
        push(left[i], rank)
        push(i, rank)
    return [s for s in symbols if s is not None]


def merge_down(segments: list[list[str]], freqs: list[int], lo: int, limit: int, known: set[str], below: dict[tuple[str, str], int], last: int, bound: tuple[str, str] | None = None) -> list[tuple[str, str, int]]:
    """Merges (left, right, count) of these segments one at a time, most frequent first and ties by text, while counts exceed
    ``lo``. Pairs lead to their segments, and a merge changes the counts of the pairs in those only.

    A merge may make a piece that some words hold already (``known``) at places that were cut off. Pairs with it may be more
    frequent than the segments show, by what ``below`` says (or ``last``); the round ends where such a pair could be next, and
    where the next pair comes after ``bound`` in the order of texts.
    """
    counts: dict[tuple[str, str], int] = defaultdict(int)
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for k, symbols in enumerate(segments):
        for pair in zip(symbols, symbols[1:]):
            counts[pair] += freqs[k]
            where[pair].add(k)
    inside = set(counts)
    most = lambda p: counts[p] + (min(lo, below.get(p, last)) if p[0] in known and p[1] in known and p not in inside else 0)
    heap = [(-n, p) for p, n in counts.items()]
    heapq.heapify(heap)
    out: list[tuple[str, str, int]] = []
    while heap and len(out) < limit:
        n, pair = heapq.heappop(heap)
        if not counts.get(pair) or -n != most(pair):
            if counts.get(pair) and most(pair) > lo:
                heapq.heappush(heap, (-most(pair), pair))
            continue
        if -n <= lo or -n != counts[pair] or (bound is not None and pair > bound):
            break
        out.append((*pair, -n))
        piece = pair[0] + pair[1]
        changes: dict[tuple[str, str], int] = defaultdict(int)
        for k in where.pop(pair):
            old, freq = segments[k], freqs[k]
            new, i, end = [], 0, len(old) - 1
            while i <= end:
                if i < end and old[i] == pair[0] and old[i + 1] == pair[1]:
                    new.append(piece)
                    i += 2
                else:
                    new.append(old[i])
                    i += 1
            if len(new) > end:
                continue
            for p in zip(old, old[1:]):
                changes[p] -= freq
            for p in zip(new, new[1:]):
                changes[p] += freq
                if p[0] == piece or p[1] == piece:
                    where[p].add(k)
            segments[k] = new
        for p, change in changes.items():
            counts[p] += change
            if change > 0 and most(p) > lo:  # what fell is found out when it comes up
                heapq.heappush(heap, (-most(p), p))
        counts.pop(pair, None)
    return out


def _ranking(state: DataFrame, ranked: int) -> list[tuple[str, str, int]]:
    """Head of the ranking of neighbouring symbols, by count and text."""
    at = F.sequence(F.lit(1), F.size("symbols") - 1)
    pairs = state.select("freq", F.explode(F.transform(at, lambda i: F.struct(F.get("symbols", i - 1).alias("a"), F.get("symbols", i).alias("b")))).alias("p"))
    counted = pairs.groupBy("p.a", "p.b").agg(F.sum("freq").alias("n"))
    return [tuple(r) for r in counted.orderBy(F.desc("n"), "a", "b").limit(ranked).select("a", "b", "n").collect()]


def _pair_columns(pairs: Iterable[tuple[str, str]]) -> tuple[pa.Array, pa.Array]:
    left, right = zip(*pairs) if pairs else ((), ())
    return pa.array(left, pa.string()), pa.array(right, pa.string())


def _joints(words: pa.ListArray, left: pa.Array, right: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(symbols, first, joint) of words that have symbols: all symbols one after the other, where each word begins and, at the
    end, where the last one stops, and for each symbol whether it makes one of the pairs with the next one of its word."""
    flat = words.flatten().cast(pa.string())
    first = np.r_[0, np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]
    coded = flat.dictionary_encode()
    code, k = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    a, b = (pc.fill_null(pc.index_in(side, value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64) for side in (left, right))
    known = np.unique((a * k + b)[(a >= 0) & (b >= 0)])
    joint = np.zeros(len(code), bool)
    if len(known):
        here = code[:-1] * k + code[1:]
        joint[:-1] = known[np.minimum(np.searchsorted(known, here), len(known) - 1)] == here
        joint[first[1:] - 1] = False
    return flat.to_numpy(zero_copy_only=False).tolist(), first, joint


def _cut(state: DataFrame, kept: set[tuple[str, str]], whole: bool = False) -> DataFrame:
    """segment, freq: the distinct runs of symbols whose neighbours are all ``kept`` pairs, with their counts; or the ``whole``
    words that hold such a pair."""
    shared = state.sparkSession.sparkContext.broadcast(kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pair_columns(shared.value)
        for batch in batches:
            if not len(batch):
                continue
            symbols, first, joint = _joints(batch.column("symbols"), *pairs)
            if whole:
                own = np.flatnonzero(np.logical_or.reduceat(joint, first[:-1]))
                low, high = first[own], first[own + 1]
            else:
                low = np.flatnonzero(joint & ~np.r_[False, joint[:-1]])
                high = np.flatnonzero(joint & ~np.r_[joint[1:], False]) + 2
                own = np.searchsorted(first, low, "right") - 1
            sums: dict[str, int] = defaultdict(int)
            for a, b, freq in zip(low.tolist(), high.tolist(), batch.column("freq").to_numpy()[own].tolist()):
                sums[_JOIN.join(symbols[a:b])] += freq
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["segment", "freq"])

    return state.mapInArrow(cut, "segment string, freq long").groupBy("segment").agg(F.sum("freq").alias("freq"))


def _rewritten(state: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """Words after the merges; those that are one symbol now have no pair and go. Words without any of the pairs stay as they are."""
    shared = state.sparkSession.sparkContext.broadcast(merges)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, ranks = _pair_columns(shared.value), _in_order(shared.value)
        for batch in batches:
            if not len(batch):
                continue
            symbols, first, joint = _joints(batch.column("symbols"), *pairs)
            touched, ends = np.logical_or.reduceat(joint, first[:-1]).tolist(), first.tolist()
            words = [apply_merges(symbols[a:b], ranks) if t else symbols[a:b] for a, b, t in zip(ends, ends[1:], touched)]
            yield pa.RecordBatch.from_arrays([batch.column("freq"), pa.array(words, pa.list_(pa.string()))], ["freq", "symbols"])

    return state.mapInArrow(rewrite, "freq long, symbols array<string>").filter(F.size("symbols") > 1)


def learn(words: DataFrame, n_merges: int, ranked: int = RANKED, segments: int = SEGMENTS) -> DataFrame:
    """rank, left, right, freq, round: the merges in order, equal to merging one pair at a time (ties by text).

    ``words`` is (word, freq). At most ``ranked`` pairs reach the driver in a round and at most ``segments`` segments a task;
    lo is lowered as far as that allows, doubling the number of pairs from round to round. Where more pairs than that have one
    count, a round takes those up to a text; where not even the first pair's segments fit, it takes that pair alone.
    """
    spark = words.sparkSession
    kind = "rank int, left string, right string, freq long, round int"
    symbols = F.filter(F.split("word", ""), lambda c: c != "")
    state = stage_table(words.select("freq", symbols.alias("symbols")).filter(F.size("symbols") > 1), "words")
    known = {r.c for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()}
    tables, done, step, tries = [], 0, 0, 4096
    while done < n_merges:
        top = _ranking(state, ranked)
        if not top:
            break
        whole = len(top) < ranked
        tries = min(tries, len(top))
        while True:
            # All pairs above the count of the first one that is left out.
            lo = top[tries][2] if tries < len(top) else (0 if whole else top[-1][2])
            kept = {(a, b) for a, b, n in top if n > lo}
            bound = None
            if not kept:
                # Pairs of one count go in the order of their texts. Those up to a bound, and what becomes of them, are known
                # from the words that hold one of them: a new pair that comes before the bound arises in such a word.
                bound, lo = top[tries - 1][:2], top[0][2] - 1
                kept = {(a, b) for a, b, n in top[:tries]}
            found = stage_table(_cut(state, kept, bound is not None), "segments")
            size = found.count()
            if size <= segments or tries == 1:
                break
            tries = max(1, tries // 2)
        if size <= segments:
            below = {(a, b): n for a, b, n in top if n <= lo}
            at = (lo, n_merges - done, frozenset(known), below, 0 if whole else top[-1][2], bound)
            shared = spark.sparkContext.broadcast(at)

            def merged(df: pd.DataFrame) -> pd.DataFrame:
                out = merge_down([s.split(_JOIN) for s in df["segment"]], df["freq"].tolist(), *shared.value)
                return pd.DataFrame([(i, *m, 0) for i, m in enumerate(out)], columns=["rank", "left", "right", "freq", "round"])

            made = found.groupBy(F.lit(0).alias("_g")).applyInPandas(lambda df: merged(df), kind)
        else:
            made = spark.createDataFrame([(0, *top[0], 0)], kind)
        made = stage_table(made.withColumn("rank", (F.col("rank") + done).cast("int")).withColumn("round", F.lit(step)), "merges")
        new = [(r.left, r.right) for r in made.orderBy("rank").collect()]
        if not new:  # an uncertain pair came first: take the first of the exact ranking alone
            made = stage_table(spark.createDataFrame([(done, *top[0], step)], kind), "merges")
            new = [top[0][:2]]
        tables.append(made)
        done, step = done + len(new), step + 1
        known |= {a + b for a, b in new}
        tries *= 2
        if done < n_merges:
            state = stage_table(_rewritten(state, new), "words")
    return reduce(DataFrame.unionAll, tables) if tables else spark.createDataFrame([], kind)


def learn_merges(words: DataFrame, n_merges: int, ranked: int = RANKED, segments: int = SEGMENTS) -> list[tuple[str, str]]:
    """Merge list in order; bounded by the vocabulary size."""
    return [(r.left, r.right) for r in learn(words, n_merges, ranked, segments).orderBy("rank").collect()]


def vocabulary(words: DataFrame, merges: list[tuple[str, str]]) -> dict[str, int]:
    """Piece to id: specials, merged pieces by rank, then all single characters (full coverage).

    Characters are a closed set (Unicode), merges are bounded by the vocabulary size.
    """
    chars = words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().orderBy("c").collect()
    pieces = SPECIALS + list(dict.fromkeys([a + b for a, b in merges] + [r.c for r in chars]))
    return {p: i for i, p in enumerate(pieces)}


def learn_bpe(df: DataFrame, column: str, vocab_size: int = VOCAB_SIZE) -> Model:
    words = stage_table(word_counts(df, column), "word-counts")
    n_chars = words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().count()
    merges = learn_merges(words, max(vocab_size - len(SPECIALS) - n_chars, 0))
    return Model(vocabulary(words, merges), merges)


# --- encoding ---------------------------------------------------------------------------------------------------


def word_table(words: DataFrame, model: Model) -> DataFrame:
    """w, ids of distinct words ``w`` (without the mark). Every word is segmented once; the model is broadcast, being bounded."""
    shared = words.sparkSession.sparkContext.broadcast((model.vocab, _in_order(model.merges)))

    def segment(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, ranks = shared.value
        for df in frames:
            ids = [[vocab.get(p, UNK) for p in apply_merges(list(SPACE_MARK + w), ranks)] for w in df["w"]]
            yield pd.DataFrame({"w": df["w"], "ids": ids}, columns=["w", "ids"])

    return words.select("w").mapInPandas(segment, "w string, ids array<int>")


def _placed(df: DataFrame, key: str, columns: dict[str, tuple[Column, int | None]], model: Model) -> DataFrame:
    """_key, slot, pos, ids: one row for each word of each text, with the ids that the word table holds for it.

    A text that is cut to max_len ids needs its first max_len - 1 words only, since a word has at least one id.
    """
    texts = [tokens(c) if most is None else F.slice(tokens(c), F.lit(1), F.lit(max(most - 1, 1))) for c, most in columns.values()]
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), words.alias("words")) for i, words in enumerate(texts)])
    spread = df.select(F.col(key).alias("_key"), F.inline(slots)).select("_key", "slot", F.posexplode("words").alias("pos", "w"))
    rows = stage_table(spread.withColumn("_at", F.xxhash64("_key", "slot", "pos")), "text-words")
    table = stage_table(word_table(rows.select("w").distinct(), model), "word-ids")
    return lookup_join(rows, table, ["w"], "_at", "inner").select("_key", "slot", "pos", "ids")


def _task_words(model: Model) -> Callable[[str], np.ndarray]:
    """Ids of a word; a task segments a word once as long as it remembers it."""
    vocab, ranks = model.vocab, _in_order(model.merges)
    known: dict[str, np.ndarray] = {}

    def ids(word: str) -> np.ndarray:
        found = known.get(word)
        if found is None:
            if len(known) >= KNOWN:
                known.clear()
            found = known[word] = np.array([vocab.get(p, UNK) for p in apply_merges(list(SPACE_MARK + word), ranks)], np.int32)
        return found

    return ids


def _text_ids(df: DataFrame, model: Model) -> Callable[[Column, int | None], Column]:
    """Ids of a text, of its first max_len - 1 words only if it is cut to max_len ids, since a word has at least one id.

    Python cuts at the same blanks as ``tokens``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def of(text: Column, most: int | None) -> Column:
        def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            ids, first, none = _task_words(shared.value), None if most is None else max(most - 1, 1), np.zeros(0, np.int32)
            for texts in parts:
                words = [[] if t is None else t.split() if first is None else t.split(None, first)[:first] for t in texts]
                yield pd.Series([np.concatenate([ids(w) for w in own]) if own else none for own in words], dtype=object)

        return F.pandas_udf(encode, "array<int>", F.PandasUDFType.SCALAR_ITER)(text)

    return of


def with_ids(df: DataFrame, key: str, columns: dict[str, tuple[Column, int | None]], model: Model, pad: bool = True) -> DataFrame:
    """``df`` with an id array for every entry of ``columns`` (name to text and length): see ``frame_ids``.

    ``key`` is unique. Without a length (None) the ids come whole and without markers. Null and empty texts have no ids.
    Texts are encoded where they are; only rows that share a key after all, or have none, go through the word table.
    """
    alone, shared = own_rows(df, key)
    encode = _text_ids(df, model)
    ids = {name: (encode(c, most), most) for name, (c, most) in columns.items()}
    out = alone.select(*alone.columns, *[x.alias(name) for name, (x, _) in ids.items()])
    out = out.select(*df.columns, *[(F.col(name) if most is None else frame_ids(F.col(name), most, pad)).alias(name) for name, (_, most) in ids.items()])
    return out if shared is None else out.unionByName(_joined_ids(shared, key, columns, model, pad))


def _joined_ids(df: DataFrame, key: str, columns: dict[str, tuple[Column, int | None]], model: Model, pad: bool) -> DataFrame:
    lists = _placed(df, key, columns, model).groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("slot", "pos", "ids"))).alias("_ids"))

    def of(i: int, most: int | None) -> Column:
        ids = F.coalesce(F.flatten(F.transform(F.filter("_ids", lambda e: e.slot == i), lambda e: e.ids)), F.array().cast("array<int>"))
        return ids if most is None else frame_ids(ids, most, pad)

    rows = df.join(lists, df[key] == F.col("_key"), "left")
    return rows.select(*df.columns, *[of(i, most).alias(name) for i, (name, (_, most)) in enumerate(columns.items())])


def with_lengths(df: DataFrame, key: str, columns: dict[str, Column], model: Model) -> DataFrame:
    """``df`` with the number of ids of every text, without markers. ``key`` is unique; see ``with_ids`` for rows that share one."""
    alone, shared = own_rows(df, key)
    encode = _text_ids(df, model)
    out = alone.select(*alone.columns, *[encode(c, None).alias(name) for name, c in columns.items()])
    out = out.select(*df.columns, *[F.size(name).cast("long").alias(name) for name in columns])
    return out if shared is None else out.unionByName(_joined_lengths(shared, key, columns, model))


def _joined_lengths(df: DataFrame, key: str, columns: dict[str, Column], model: Model) -> DataFrame:
    placed = _placed(df, key, {name: (c, None) for name, c in columns.items()}, model)
    sums = [F.sum(F.when(F.col("slot") == i, F.size("ids"))).alias(f"_n{i}") for i in range(len(columns))]
    rows = df.join(placed.groupBy("_key").agg(*sums), df[key] == F.col("_key"), "left")
    return rows.select(*df.columns, *[F.coalesce(f"_n{i}", F.lit(0)).alias(name) for i, name in enumerate(columns)])


def frame_ids(ids: Column, max_len: int, pad: bool = True) -> Column:
    """Begin and end markers; too long arrays keep the first max_len - 1 ids and the end marker; padded right."""

    def framed(full: Column) -> Column:
        cut = F.when(
            F.size(full) > max_len, F.concat(F.slice(full, F.lit(1), F.lit(max_len - 1)), F.array(F.lit(EOS)))
        ).otherwise(full)
        if not pad:
            return cut
        return F.slice(F.concat(cut, F.array_repeat(F.lit(PAD), max_len)), F.lit(1), F.lit(max_len))

    whole = F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)))
    return F.transform(F.array(whole), framed)[0]


def decode_ids(df: DataFrame, key: str, ids: str, vocab: dict[str, int]) -> DataFrame:
    """(key, text) of id arrays without markers and padding; the broadcast table is as large as the vocabulary."""
    table = df.sparkSession.createDataFrame([(i, p) for p, i in vocab.items()], "id int, piece string")
    rows = df.select(key, F.posexplode(ids).alias("pos", "id")).filter(F.col("id") > UNK).join(F.broadcast(table), "id")
    texts = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("_p"))
    joined = F.array_join(F.transform("_p", lambda p: p.piece), "")
    text = F.ltrim(F.replace(joined, F.lit(SPACE_MARK), F.lit(" ")))
    return df.select(key).join(texts.select(key, text.alias("text")), key, "left").withColumn("text", F.coalesce("text", F.lit("")))

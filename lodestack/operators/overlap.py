"""N-gram counts per segment and the clipped overlap of a hypothesis with its references.

The text is shuffled once, by segment. Everything after that (n-gram rows, their counts, the per-segment sums) is
clustered by the segment already, so the several-times-larger n-gram rows never cross the network. The sums of a segment
that is one row need no n-gram rows at all: a task numbers the n-grams of some texts and counts the numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.text import tokens
from lodestack.operators.skew import own_rows


# One token becomes up to eight n-gram rows, so partitions are made smaller than their bytes suggest.
SPREAD = 4
# Text bytes whose n-grams are numbered together in a task; one row at least.
PORTION = 6_000_000


def spread_by(df: DataFrame, key: str, factor: int = SPREAD) -> DataFrame:
    """Hash-partition by key into a fixed multiple of the session's shuffle partitions; not merged again by AQE."""
    return df.repartition(factor * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def pad_tokens(c: Column, n: int, left: str | None = None, right: str | None = None) -> Column:
    """n-1 padding symbols at either end, as far as given."""
    parts = [F.array_repeat(F.lit(left), n - 1)] if left is not None else []
    parts.append(c)
    if right is not None:
        parts.append(F.array_repeat(F.lit(right), n - 1))
    return F.concat(*parts)


def with_grams(df: DataFrame, column: str, prefix: str, max_order: int) -> DataFrame:
    """Array columns ``{prefix}1`` .. ``{prefix}{max_order}``; tokens hold no blanks, so joined grams are exact keys."""
    df = df.withColumn(f"{prefix}1", F.col(column))
    empty = F.array().cast("array<string>")
    for n in range(2, max_order + 1):
        width = F.size(column) - (n - 1)
        longer = F.zip_with(
            F.slice(f"{prefix}{n - 1}", F.lit(1), width),
            F.slice(column, F.lit(n), width),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        df = df.withColumn(f"{prefix}{n}", F.when(width > 0, longer).otherwise(empty))
    return df


def ngram_counts(df: DataFrame, key: str, column: str, max_order: int = 4) -> DataFrame:
    """Rows (key, n, gram, cnt) for orders 1..max_order of the token array ``column``."""
    base = spread_by(df.select(key, F.col(column).alias("_tok")), key)
    grams = with_grams(base, "_tok", "_g", max_order)
    packed = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"_g{n}").alias("grams")) for n in range(1, max_order + 1)])
    packs = grams.select(key, F.explode(packed).alias("_p")).select(key, "_p.n", F.col("_p.grams").alias("_g"))
    rows = packs.select(key, "n", F.explode("_g").alias("gram"))
    return rows.groupBy(key, "n", "gram").agg(F.count(F.lit(1)).alias("cnt"))


def gram_overlap(df: DataFrame, key: str, hyp: str, ref: str, max_order: int = 4) -> DataFrame:
    """Per (key, n, gram): count in the hypothesis and in the reference text of the same row.

    ``key`` identifies a row. Texts are cut into tokens after the shuffle, where they are spread evenly. A side without any n-gram of an order leaves a null gram that counts nothing.
    """
    base = spread_by(df.select(key, F.col(hyp).alias("_h"), F.col(ref).alias("_r")), key)
    base = base.withColumn("_h", tokens(F.col("_h"))).withColumn("_r", tokens(F.col("_r")))
    base = with_grams(with_grams(base, "_h", "_h", max_order), "_r", "_r", max_order)
    packed = F.array(
        *[
            F.struct(F.lit(n).alias("n"), F.lit(is_hyp).alias("is_hyp"), F.col(f"_{side}{n}").alias("grams"))
            for side, is_hyp in (("h", 1), ("r", 0))
            for n in range(1, max_order + 1)
        ]
    )
    packs = base.select(key, F.explode(packed).alias("_p"))
    flat = packs.select(key, "_p.n", "_p.is_hyp", F.col("_p.grams").alias("_g"))
    rows = flat.select(key, "n", "is_hyp", F.explode_outer("_g").alias("gram"))
    real = F.col("gram").isNotNull()
    return rows.groupBy(key, "n", "gram").agg(
        F.sum(F.when(real, F.col("is_hyp")).otherwise(0)).alias("hyp_cnt"),
        F.sum(F.when(real, 1 - F.col("is_hyp")).otherwise(0)).alias("ref_cnt"),
    )


def clipped_matches(code: np.ndarray, text: np.ndarray, slot: np.ndarray, row: np.ndarray, max_order: int, weight: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the matches of every row: clipped by the largest count of any reference, and summed over the references.

    ``code`` numbers the tokens of all texts, ``text`` is the text of a token, ``slot`` (0: hypothesis) and ``row`` are those of
    a text. ``weight`` (by code) weighs the summed unigrams. N-grams of a row get exact numbers, order by order; one whose
    beginning matches nothing cannot match and is not followed.
    """
    rows = int(row.max()) + 1 if len(row) else 0
    end = np.cumsum(np.bincount(text, minlength=len(row)))
    width = int(code.max()) + 1 if len(code) else 1
    at, before, out = np.arange(len(code)), row[text], []
    for n in range(1, max_order + 1):
        _, first, gram = np.unique(before * width + code[at + n - 1], return_index=True, return_inverse=True)
        own, place = text[at], row[text[at[first]]]
        hyp = np.bincount(gram[slot[own] == 0], minlength=len(first))
        found = (slot[own] > 0) & (hyp[gram] > 0)
        each, count = np.unique(gram[found] * len(row) + own[found], return_counts=True)
        of = each // max(len(row), 1)
        low = np.minimum(hyp[of], count)
        best = np.zeros(len(first), np.int64)
        np.maximum.at(best, of, low)
        scale = low if n > 1 or weight is None else low * weight[code[at[first]]][of]
        out.append((np.bincount(place, best, rows).astype(np.int64), np.bincount(place[of], scale, rows).astype(float)))
        on = (best[gram] > 0) & (at + n < end[own])
        at, before = at[on], gram[on]
    return out


def _sized(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch (key, text, list of texts) in slices of about PORTION text bytes."""
    own, others = batch.column(1), batch.column(2)
    size = lambda texts: pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.r_[0, np.cumsum(size(others.flatten()))][np.r_[0, np.cumsum(_lengths(others))]]
    sizes = size(own) + np.diff(ends)
    part = (np.cumsum(sizes) - sizes) // PORTION
    cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(sizes)] if len(sizes) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1], cut[1:]):
        yield batch.slice(a, b - a)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens, as ``tokens`` cuts them (the same 29 characters are blanks), and their number in each text."""
    lists = pc.utf8_split_whitespace(texts)
    parts, size = lists.flatten(), _lengths(lists)
    empty = pc.equal(pc.binary_length(parts), 0).to_numpy(zero_copy_only=False)
    size = size - np.bincount(np.repeat(np.arange(len(size)), size)[empty], minlength=len(size))
    return parts.filter(pa.array(~empty)), size


def _row_overlap(batch: pa.RecordBatch, max_order: int, keywords: list[str] | None, other: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """(tokens of each hypothesis; references of each row; tokens and weighted tokens of each reference; matches by order) of a
    batch (key, hyp, refs) of texts and lists of texts. A missing text is empty here."""
    hyp, n_refs = batch.column(1), _lengths(batch.column(2))
    words, size = _split(pa.concat_arrays([hyp, batch.column(2).flatten()]))
    words, h, r = words.dictionary_encode(), size[:len(hyp)], size[len(hyp):]
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key_word = np.ones(len(words.dictionary), bool)
    if keywords is not None:
        key_word = pc.is_in(words.dictionary, value_set=pa.array(keywords, pa.string())).to_numpy(zero_copy_only=False)
    weight = np.where(key_word, 1.0, other)
    text = np.repeat(np.arange(len(size)), size)
    row = np.r_[np.arange(len(h)), np.repeat(np.arange(len(h)), n_refs)]
    slot = np.r_[np.zeros(len(h), np.int64), np.ones(len(r), np.int64)]
    marked = np.bincount(text, key_word[code], len(size))[len(h):]
    return h, n_refs, r, other * r + (1 - other) * marked, clipped_matches(code, text, slot, row, max_order, weight)


def segment_stats(
    df: DataFrame, key: str, hyp: str, ref: str, max_order: int = 4, keywords: list[str] | None = None, other: float = 0.2
) -> DataFrame:
    """One row per segment: hyp_len, ref_len, clipped matches m1..mN; with ``keywords`` weighted unigrams wm, wr.

    Rows that share a key are one segment, by way of its n-gram rows; all others are counted where their text is."""
    alone, shared = own_rows(df, key)
    listed = None if keywords is None else sorted(set(keywords))
    base = spread_by(alone.select(key, F.col(hyp).alias("_h"), F.col(ref).alias("_r")), key)
    base = base.withColumn("_r", F.array("_r"))
    names = ["hyp_len", "ref_len", *[f"m{n}" for n in range(1, max_order + 1)]]
    weighed = [] if keywords is None else ["wm", "wr"]
    schema = T.StructType([base.schema[0], *[T.StructField(c, T.LongType()) for c in names], *[T.StructField(c, T.DoubleType()) for c in weighed]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _sized(whole):
                h, _, r, w, found = _row_overlap(batch, max_order, listed, other)
                columns = [h, r, *[m for m, _ in found]] + ([found[0][1], w] if weighed else [])
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=[key, *names, *weighed])

    stats = base.mapInArrow(count, schema)
    return stats if shared is None else stats.unionByName(_grouped_stats(shared, key, hyp, ref, max_order, listed, other))


def _grouped_stats(df: DataFrame, key: str, hyp: str, ref: str, max_order: int, keywords: list[str] | None, other: float) -> DataFrame:
    overlap = gram_overlap(df, key, hyp, ref, max_order)
    first = F.col("n") == 1
    match = F.least("hyp_cnt", "ref_cnt")
    sums = [
        F.sum(F.when(first, F.col("hyp_cnt")).otherwise(0)).alias("hyp_len"),
        F.sum(F.when(first, F.col("ref_cnt")).otherwise(0)).alias("ref_len"),
    ]
    sums += [F.sum(F.when(F.col("n") == n, match).otherwise(0)).alias(f"m{n}") for n in range(1, max_order + 1)]
    if keywords is not None:
        weight = F.when(F.col("gram").isin(keywords), 1.0).otherwise(other)
        sums.append(F.sum(F.when(first, match * weight).otherwise(0.0)).alias("wm"))
        sums.append(F.sum(F.when(first, F.col("ref_cnt") * weight).otherwise(0.0)).alias("wr"))
    return overlap.groupBy(key).agg(*sums)


def multi_reference_stats(hyps: DataFrame, refs: DataFrame, key: str, max_order: int = 4) -> DataFrame:
    """As :func:`segment_stats` for any number of references per key, in long form.

    ``hyps`` has (key, tok), one row per key; ``refs`` has (key, ref_id, tok). Counts are keyed by the n-gram as
    well, so a key with very many references is spread over its n-grams.
    """
    hyp_counts = ngram_counts(hyps, key, "tok", max_order).withColumnRenamed("cnt", "hyp_cnt")
    wide = refs.withColumn("_rk", F.struct(key, "ref_id"))
    per_ref = ngram_counts(wide, "_rk", "tok", max_order).select(F.col(f"_rk.{key}").alias(key), "n", "gram", "cnt")
    best = per_ref.groupBy(key, "n", "gram").agg(F.max("cnt").alias("ref_cnt"))
    match = F.least("hyp_cnt", F.coalesce("ref_cnt", F.lit(0)))
    sums = [F.sum(F.when(F.col("n") == n, match).otherwise(0)).alias(f"m{n}") for n in range(1, max_order + 1)]
    matches = hyp_counts.join(best, [key, "n", "gram"], "left").groupBy(key).agg(*sums)
    lengths = refs.groupBy(key).agg(
        F.min(F.size("tok")).alias("ref_min"), F.avg(F.size("tok")).alias("ref_avg"), F.count(F.lit(1)).alias("n_refs")
    )
    base = hyps.select(key, F.size("tok").alias("hyp_len")).join(lengths, key)
    zero = [F.coalesce(f"m{n}", F.lit(0)).alias(f"m{n}") for n in range(1, max_order + 1)]
    return base.join(matches, key, "left").select(key, "hyp_len", "ref_min", "ref_avg", "n_refs", *zero)


def reference_stats(
    df: DataFrame, key: str, hyp: str, refs: str, max_order: int = 4, keywords: list[str] | None = None, other: float = 0.2
) -> DataFrame:
    """One row per segment with any number of references (``refs`` is an array of texts; ``key`` identifies a row).

    hyp_len, ref_min and ref_closest (length of the shortest reference and of the one nearest to the hypothesis, the shorter on
    ties); m1..mN, matches clipped by the largest count of any reference; r1..rN and d1..dN, matches and possible n-grams summed
    over the references one by one, the latter at least one each. With ``keywords`` r1 and d1 weigh unigrams: 1 for a keyword,
    else ``other``. Texts move once, by segment, and are counted there. A segment without references has null lengths and no
    matches. Rows that share a key take the matches of them all, by way of their n-gram rows.
    """
    alone, shared = own_rows(df, key)
    listed = None if keywords is None else sorted(set(keywords))
    base = spread_by(alone.select(key, F.col(hyp).alias("_hyp"), F.col(refs).alias("_refs")), key)
    orders = range(1, max_order + 1)
    types = {"hyp_len": T.LongType(), "ref_min": T.LongType(), "ref_closest": T.LongType(), **{f"m{n}": T.LongType() for n in orders}}
    types |= {f"{x}{n}": T.DoubleType() for x in "rd" for n in orders}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _sized(whole):
                h, n_refs, r, w, found = _row_overlap(batch, max_order, listed, other)
                known = batch.column(2).flatten().is_valid().to_numpy(zero_copy_only=False)
                row, rows = np.repeat(np.arange(len(h)), n_refs), len(h)
                # A missing reference has no length, and sorts before those that have one.
                none, far = np.bincount(row, ~known, rows) > 0, np.iinfo(np.int64).max
                short = np.full(rows, far)
                np.minimum.at(short, row[known], r[known])
                there = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
                apart = np.where(there[row], np.abs(r - h[row]), 0)
                order = np.lexsort((r, apart, known, row))
                near, starts = np.zeros(rows, np.int64), np.r_[0, np.cumsum(n_refs)][:-1]
                near[n_refs > 0] = r[order][starts[n_refs > 0]]
                least = [np.where(known, np.maximum(w if n == 1 and listed is not None else r - (n - 1), 1), 1) for n in orders]
                gone = ~batch.column(2).is_valid().to_numpy(zero_copy_only=False)
                columns = [pa.array(h, mask=~there), pa.array(short, mask=short == far), pa.array(near, mask=(n_refs == 0) | none)]
                columns += [pa.array(m) for m, _ in found] + [pa.array(s) for _, s in found] + [pa.array(np.bincount(row, x, rows).astype(float), mask=gone) for x in least]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *types])

    stats = base.mapInArrow(count, T.StructType([base.schema[0], *[T.StructField(c, t) for c, t in types.items()]]))
    stats = stats.select(key, "hyp_len", "ref_min", "ref_closest", *[f"{x}{n}" for x in "mr" for n in orders], *[f"d{n}" for n in orders])
    return stats if shared is None else stats.unionByName(_grouped_references(shared, key, hyp, refs, max_order, listed, other))


def _grouped_references(df: DataFrame, key: str, hyp: str, refs: str, max_order: int, keywords: list[str] | None, other: float) -> DataFrame:
    listed = keywords or []
    base = spread_by(df.select(key, F.col(hyp).alias("_hyp"), F.col(refs).alias("_refs")), key)
    base = base.select(key, tokens(F.col("_hyp")).alias("_hyp"), F.transform("_refs", tokens).alias("_refs"))
    size = F.size("_hyp")
    lengths = F.transform("_refs", lambda r: F.size(r))
    near = F.array_sort(F.transform(lengths, lambda n: F.struct(F.abs(n - size).alias("d"), n.alias("n"))))
    total = lambda part: F.aggregate("_refs", F.lit(0.0), lambda acc, r: acc + F.greatest(part(r), F.lit(1)).cast("double"))
    weight = lambda r: other * F.size(r) + (1 - other) * F.size(F.filter(r, lambda w: w.isin(listed)))
    possible = [total(lambda r, n=n: F.size(r) - (n - 1)).alias(f"d{n}") for n in range(1, max_order + 1)]
    if keywords is not None:
        possible[0] = total(weight).alias("d1")
    sizes = base.select(key, size.cast("long").alias("hyp_len"), F.array_min(lengths).cast("long").alias("ref_min"), F.get(near, F.lit(0)).n.cast("long").alias("ref_closest"), *possible)

    side = F.transform("_refs", lambda r, i: F.struct((i + 1).alias("slot"), r.alias("tok")))
    sides = base.select(key, F.inline(F.concat(F.array(F.struct(F.lit(0).alias("slot"), F.col("_hyp").alias("tok"))), side)))
    grams = with_grams(sides, "tok", "_g", max_order)
    packed = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"_g{n}").alias("grams")) for n in range(1, max_order + 1)])
    rows = grams.select(key, "slot", F.inline(packed)).select(key, "slot", "n", F.explode("grams").alias("gram"))
    counts = rows.groupBy(key, "n", "gram", "slot").agg(F.count(F.lit(1)).alias("c"))
    own = F.max(F.when(F.col("slot") == 0, F.col("c"))).alias("h")
    each = F.collect_list(F.when(F.col("slot") > 0, F.col("c"))).alias("cs")
    both = counts.groupBy(key, "n", "gram").agg(own, each).filter("h is not null and size(cs) > 0")
    single = F.aggregate("cs", F.lit(0).cast("long"), lambda acc, c: acc + F.least("h", c))
    scale = F.when((F.col("n") == 1) & ~F.col("gram").isin(listed), other).otherwise(1.0) if keywords is not None else F.lit(1.0)
    clipped, summed = F.least("h", F.array_max("cs")), single * scale
    sums = [F.sum(F.when(F.col("n") == n, clipped).otherwise(0)).alias(f"m{n}") for n in range(1, max_order + 1)]
    sums += [F.sum(F.when(F.col("n") == n, summed).otherwise(0.0)).alias(f"r{n}") for n in range(1, max_order + 1)]
    found = both.groupBy(key).agg(*sums)
    zero = [F.coalesce(f"{x}{n}", F.lit(0)).alias(f"{x}{n}") for x in "mr" for n in range(1, max_order + 1)]
    ends = [F.col(f"d{n}") for n in range(1, max_order + 1)]
    return sizes.join(found, key, "left").select(key, "hyp_len", "ref_min", "ref_closest", *zero, *ends)


def closest_ref_length(hyps: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Per key the reference length nearest to the hypothesis length; the shorter one on ties.

    Reference lengths are counted first, so a key joins once per distinct length, not once per reference.
    """
    lengths = refs.groupBy(key, F.size("tok").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    joined = hyps.select(key, F.size("tok").alias("hyp_len")).join(lengths, key)
    rank = F.struct(F.abs(F.col("len") - F.col("hyp_len")).alias("d"), F.col("len").alias("l"))
    return joined.groupBy(key, "hyp_len").agg(F.min_by("len", rank).alias("ref_len"))

"""Language scoring by character n-gram profiles learnt from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.overlap import spread_by

GRAM = 3
# Bytes of letters whose grams are counted together in a task; one text at least.
PORTION = 4_000_000
UNKNOWN = "unk"
KEPT_LANGUAGES = ["unk", "en", "ca", "nl"]


def letters(text: Column) -> Column:
    """The letters of the whole text, lower case, words separated by one blank, a blank at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"\P{L}+", " ")), F.lit(" "))


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, count) of the distinct grams of some texts, a gram being its code points in 21 bits each."""
    whole = texts.to_pylist()
    codes = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, sizes = np.unique(codes), np.array([len(t) for t in whole], np.int64)
    bits = max(1, len(alphabet).bit_length())
    if GRAM * bits + len(whole).bit_length() > 63 and len(whole) > 1:  # texts of very many different letters
        half = len(whole) // 2
        left, right = _counted(texts[:half]), _counted(texts[half:])
        return np.r_[left[0], right[0] + half], np.r_[left[1], right[1]], np.r_[left[2], right[2]]
    at = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.int64)
    at[alphabet] = np.arange(len(alphabet))
    n = max(len(codes) - GRAM + 1, 0)
    letter, left = at[codes], np.repeat(np.cumsum(sizes), sizes)[:n] - np.arange(n)
    packed = np.repeat(np.arange(len(whole)), sizes)[:n]
    for i in range(GRAM):
        packed = packed << bits | letter[i:i + n]
    packed, cnt = np.unique(packed[left >= GRAM], return_counts=True)
    gram = np.zeros(len(packed), np.int64)
    for i in reversed(range(GRAM)):
        gram = gram << 21 | alphabet[packed >> (i * bits) & ((1 << bits) - 1)].astype(np.int64)
    return packed >> (GRAM * bits), gram, cnt


def gram_table(df: DataFrame, key: str, text: str, *carried: str) -> DataFrame:
    """Counts (key, *carried, gram, cnt) of the overlapping grams of every row, a gram as a number: equal texts, equal numbers.

    The text moves once, so that few input splits do not mean few tasks; its grams are counted in the task and do not move. Rows
    that share a key have their counts side by side.
    """
    rows = spread_by(df.select(key, *carried, text), key).select(key, *carried, F.coalesce(letters(F.col(text)), F.lit("")).alias("_letters"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *carried))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            sizes = np.cumsum(pc.binary_length(batch.column("_letters")).to_numpy())
            while at < len(batch):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PORTION, "right")))
                part = batch.slice(at, end - at)
                own, gram, cnt = _counted(part.column("_letters"))
                own = pa.array(own)
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(own) for c in (key, *carried)], pa.array(gram), pa.array(cnt)], [key, *carried, "gram", "cnt"])
                at = end

    return rows.mapInArrow(count, f"{kinds}, gram long, cnt long")


def learn_profiles(counts: DataFrame, lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """From gram counts: add-one smoothed log probabilities (gram, lang, logp), and per language that of an unseen
    gram (lang, floor)."""
    by_lang = counts.groupBy(F.col(lang).alias("lang"), "gram").agg(F.sum("cnt").alias("cnt"))
    # One row per language.
    sizes = by_lang.groupBy("lang").agg((F.sum("cnt") + F.count(F.lit(1)) + 1).alias("size"))
    profiles = by_lang.join(F.broadcast(sizes), "lang").select("gram", "lang", F.ln((F.col("cnt") + 1) / F.col("size")).alias("logp"))
    return profiles, sizes.select("lang", F.ln(1 / F.col("size")).alias("floor"))


def score_language(df: DataFrame, counts: DataFrame, profiles: DataFrame, floors: DataFrame, key: str) -> DataFrame:
    """(key, detected): language with the largest summed log probability, ties by name; 'unk' without a letter.

    ``counts`` is the gram table of ``df`` by key. A known gram adds its gain over the floor, so unseen grams need
    no profile row: score = floor * grams + sum of gains. Profiles have one column per language (there is one row
    per language in ``floors``); how they are joined is the optimiser's choice.
    """
    known = sorted((r.lang, r.floor) for r in floors.collect())
    columns = [f"_g{i}" for i in range(len(known))]
    by_gram = profiles.groupBy("gram").agg(
        *[F.sum(F.when(F.col("lang") == lang, F.col("logp") - floor)).alias(c) for c, (lang, floor) in zip(columns, known)]
    )
    hits = counts.join(by_gram, "gram", "left")
    sums = hits.groupBy(key).agg(
        F.sum("cnt").alias("grams"), *[F.sum(F.col("cnt") * F.coalesce(c, F.lit(0.0))).alias(c) for c in columns]
    )
    scored = sums.select(key, *[F.round(F.col(c) + F.col("grams") * floor, 6).alias(c) for c, (_, floor) in zip(columns, known)])
    best = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    name = F.coalesce(*[F.when(F.col(c) == best, F.lit(lang)) for c, (lang, _) in zip(columns, known)])
    detected = scored.select(key, name.alias("detected"))
    return df.select(key).join(detected, key, "left").select(key, F.coalesce("detected", F.lit(UNKNOWN)).alias("detected"))


def filter_language(df: DataFrame, detected: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    wanted = detected.filter(F.col("detected").isin(keep or KEPT_LANGUAGES)).select(key)
    return df.join(wanted, key, "left_semi")

"""Quality rules whose thresholds come from the corpus itself, per language and source.

1. One pass computes the counts behind the rules for every whole text.
2. Quantile sketches: a measure (an integer) is cut to its BITS + 1 leading bits, and rows are counted per group, measure and
   cut value. Such a sketch errs by less than 2**-BITS of a value, holds at most 64 * 2**BITS counters however many rows it
   has seen, and two sketches merge by adding their counts, in any order and with the same result. So Spark's partial
   aggregation builds it, and a group that holds most rows reaches the shuffle as one short list per task.
3. Thresholds: the quartiles of a group give fences. A group with too few rows takes the merged sketch of its language, a
   language with too few that of all rows.
4. The thresholds are joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm import hashing as H
from lodestack.llm.common import small_or_shuffled
from lodestack.operators.skew import lookup_join
from lodestack.session import stage_table

#: Words of a repeated window; fixed rules: least number of words, and words in repeated windows in per cent.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Leading bits that a sketch keeps after the first; rows that a group needs for thresholds of its own.
BITS, LEAST_ROWS = 7, 100
#: Fences lie REACH times the distance of the quartiles outside them.
REACH = 3
#: Measures: name, value (a whole number), least distance of the quartiles, and whether low values count as well.
MEASURES = [
    ("word_length", "word_chars * 1000 div n_words", 250, True),
    ("symbols", "n_symbols * 1000000 div word_chars", 10_000, False),
    ("dup_lines", "n_dup_lines * 1000000 div n_lines", 110_000, False),
    ("repeated", "n_repeat_words * 1000000 div n_words", 100_000, False),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags of every text."""
    before = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=before[1:])
    return np.diff(before[offsets])


def _twins(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Order number of equal (text, hash) pairs: 0 for the first, in place; together with the size of each one's set."""
    order = np.lexsort((hashes, own))
    h, o = hashes[order], own[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])] if len(h) else np.empty(0, bool)
    head = np.flatnonzero(fresh)
    size = np.diff(np.r_[head, len(h)])
    out = np.empty((2, len(h)), np.int64)
    out[0, order] = np.arange(len(h)) - np.repeat(head, size)
    out[1, order] = np.repeat(size, size)
    return out


def _measure(data: np.ndarray, offsets: np.ndarray, window: int) -> list[np.ndarray]:
    """COUNTS and the number of lines with a word, of every text of a portion."""
    start, _, hashes, first = H.words(data, offsets, H.SPACED, lower=False)
    n_words = np.diff(first)
    chars = _per_text(((data & 0xC0) != 0x80) & H.SPACED[data], offsets)
    symbols = _per_text(_SYMBOLS[data], offsets)
    # Lines: cut at \n and at the ends of texts; those with a word count.
    edge = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    begin, end = edge[:-1], edge[1:].copy()
    end -= (end > begin) & (data[end - 1] == 10) if len(data) else 0
    worded = np.searchsorted(start, end) > np.searchsorted(start, begin)
    begin, end = begin[worded], end[worded]
    line_own = np.searchsorted(offsets, begin, "right") - 1
    lines = H.byte_sums(data).runs(begin, end)
    n_lines = np.bincount(line_own, minlength=len(offsets) - 1)
    again = _twins(lines, line_own)[0] > 0
    dup_lines = np.bincount(line_own[again], minlength=len(offsets) - 1)
    # Words under windows that occur twice or more in their text.
    at = H.fitting(first, window)
    every = H.word_sums(hashes).windows(window)[at] if len(at) else np.empty(0, np.uint64)
    twice = at[_twins(every, np.searchsorted(first, at, "right") - 1)[1] > 1]
    depth = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(depth, twice, 1)
    np.add.at(depth, twice + window, -1)
    return [n_words, chars, symbols, dup_lines, _per_text(np.cumsum(depth[:-1]) > 0, first), n_lines]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", window: int = WINDOW) -> DataFrame:
    """doc_id, lang, source, COUNTS, n_lines of every row; one pass, one portion of texts at a time."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in H.portions(batch.column("text")):
                found = _measure(data, offsets, window)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "lang", "source")] + [pa.array(x, pa.int64()) for x in found],
                    ["doc_id", "lang", "source", *COUNTS, "n_lines"],
                )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")
    )
    kind = ", ".join(f"{c} long" for c in [*COUNTS, "n_lines"])
    return rows.mapInArrow(apply, f"doc_id long, lang string, source string, {kind}")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _leading(value: str, bits: int) -> Column:
    return F.expr(f"{value} - ({value}) % shiftleft(1L, greatest(length(bin({value})) - {bits + 1}, 0))")


def sketch(rows: DataFrame, by: list[str], bits: int = BITS) -> DataFrame:
    """by, measure, value, n: the quantile sketches of all measures of ``rows`` (with the measures as columns)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), _leading(m, bits).alias("value")) for m, *_ in MEASURES])
    return rows.select(*by, F.inline(pairs)).groupBy(*by, "measure", "value").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of the coarser groups ``by``."""
    return sketches.groupBy(*by, "measure", "value").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by, measure, rows, low, high: the least values with at least a quarter and three quarters of the rows at or below."""
    part = Window.partitionBy(*by, "measure")
    upto = F.sum("n").over(part.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = sketches.select(*by, "measure", "value", upto.alias("upto"), F.sum("n").over(part).alias("rows"))
    return placed.groupBy(*by, "measure").agg(
        F.max("rows").alias("rows"), F.min(F.when(F.expr("4 * upto >= rows"), F.col("value"))).alias("low"), F.min(F.when(F.expr("4 * upto >= 3 * rows"), F.col("value"))).alias("high")
    )


def thresholds(rows: DataFrame, least_rows: int = LEAST_ROWS, reach: int = REACH, bits: int = BITS) -> DataFrame:
    """lang_key, source_key and the fences least_m and most_m of every measure m: one row for each group of ``rows``."""
    own = stage_table(sketch(rows, ["lang_key", "source_key"], bits), "sketch")
    lang = stage_table(merge(own, ["lang_key"]), "sketch-lang")
    whole = quartiles(merge(lang, []), [])
    # At most one row per group, language and measure from here on.
    fine = quartiles(own, ["lang_key", "source_key"])
    mid = quartiles(lang, ["lang_key"]).select("lang_key", "measure", *[F.col(c).alias(f"m_{c}") for c in ("rows", "low", "high")])
    top = F.broadcast(whole.select("measure", F.col("low").alias("t_low"), F.col("high").alias("t_high")))
    both = fine.join(mid, ["lang_key", "measure"]).join(top, "measure")
    pick = lambda c: F.when(F.col("rows") >= least_rows, F.col(c)).when(F.col("m_rows") >= least_rows, F.col(f"m_{c}")).otherwise(F.col(f"t_{c}"))
    chosen = both.select("lang_key", "source_key", "measure", pick("low").alias("low"), pick("high").alias("high"))
    of = lambda m, c: F.max(F.when(F.col("measure") == m, c))
    fences = []
    for m, _, least, both_sides in MEASURES:
        spread = reach * F.greatest(F.col("high") - F.col("low"), F.lit(least))
        fences += [of(m, F.col("low") - spread if both_sides else F.lit(0)).cast("long").alias(f"least_{m}"), of(m, F.col("high") + spread).cast("long").alias(f"most_{m}")]
    return chosen.groupBy("lang_key", "source_key").agg(*fences)


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_rows: int = LEAST_ROWS, reach: int = REACH, bits: int = BITS,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and ``failed`` (names of the
    measures outside their fences) of every row.

    A row fails the fixed rules with fewer than LEAST_WORDS words or with more than MOST_REPEATED per cent of its words under
    WINDOW-word windows that occur twice. The others are kept if every measure lies within the fences of their language and
    source (ends included). Only rows that pass the fixed rules are sketched, so short texts do not move the thresholds.
    Null languages and null sources are groups of their own. A null or empty text has no words and fails. Equal rows are
    judged alike, each on its own; ties at a fence are kept. An empty table gives no rows. Other columns take no part.
    """
    named = stage_table(
        counts(docs, id_col, text_col, lang_col, source_col)
        .withColumn("base_failed", base_failed())
        .select("*", *[F.when(~F.col("base_failed"), F.expr(e)).alias(m) for m, e, *_ in MEASURES])
        # Texts that name the group, null apart from every value.
        .withColumn("lang_key", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
        .withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn("row", F.monotonically_increasing_id()),
        "counts",
    )
    fences = stage_table(thresholds(named.filter(~F.col("base_failed")), least_rows, reach, bits), "fences")
    group, sized = ["lang_key", "source_key"], small_or_shuffled(fences)
    joined = named.join(sized, group, "left") if sized is not fences else lookup_join(named, fences, group, "row")
    outside = F.array_compact(F.array(*[F.when(~F.col(m).between(F.col(f"least_{m}"), F.col(f"most_{m}")), F.lit(m)) for m, *_ in MEASURES]))
    return joined.withColumn("failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(outside)).select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed"
    )

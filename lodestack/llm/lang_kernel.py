"""Language identification by string kernels: blended-spectrum presence kernels, Nystroem landmarks, kernel ridge regression.

A text is the set of its character n-grams, n in ORDERS, lower-cased and hashed to 2**BITS buckets; the kernel of two texts is
the size of the intersection over the geometric mean of their sizes. Landmarks are training texts; with their kernel matrix
M, the feature map of a text x is k(x, landmarks) M^(-1/2). One ridge regression for each language against the rest is solved
on these features. Texts are scored in batches: their presence matrix times that of the landmarks, block of buckets by block,
gives the kernels, and a second product the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import fold, small_or_shuffled
from lodestack.session import stage_table

ORDERS, BITS = (1, 2, 3, 4), 18
#: Bounds of the training sample: rows in all (two of a language at least) and characters of all their texts together.
SAMPLE, CHARS = 2_000, 16_000_000
#: Landmarks in all (two of a language at least).
LANDMARKS = 96
RIDGE = 1e-3
#: Texts scored at once, buckets of a block.
TEXTS, BLOCK = 128, 8_192
LETTER = regex.compile(r"\p{L}")


def buckets(text: str) -> np.ndarray:
    """Distinct n-gram buckets of a text, unordered."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    rows, power = [], np.uint64(0x9E3779B97F4A7C15)
    value = np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > len(code):
            break
        value = value[: len(code) - n + 1] * power + code[n - 1:]
        if n in ORDERS:
            mixed = value * np.uint64(0xD1342543DE82EF95)
            rows.append(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64))
    every = np.concatenate([np.empty(0, np.int64), *rows])
    # The last writer of a bucket keeps it: one linear pass instead of a sort.
    last = _SLOTS
    at = np.arange(len(every))
    last[every] = at
    return every[last[every] == at]


_SLOTS = np.empty(1 << BITS, np.int64)


@dataclass
class Model:
    langs: list[str]
    #: Row of each bucket in ``presence``; 0, a row of zeros, for buckets without a landmark.
    row: np.ndarray
    presence: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray

    def kernels(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel of every text with every landmark: products of presence matrices, TEXTS rows and BLOCK buckets at a time."""
        out = np.zeros((len(sets), len(self.sizes)), np.float32)
        for lo in range(0, len(sets), TEXTS):
            part = sets[lo:lo + TEXTS]
            column = self.row[np.concatenate(part)]
            own = np.repeat(np.arange(len(part)), [len(s) for s in part])
            by = np.argsort(column)
            column, own = column[by], own[by]
            for at in range(1, len(self.presence), BLOCK):
                a, b = np.searchsorted(column, (at, at + BLOCK))
                if a < b:
                    marks = self.presence[at:at + BLOCK].astype(np.float32)
                    texts = np.zeros((len(part), len(marks)), np.float32)
                    texts[own[a:b], column[a:b] - at] = 1
                    out[lo:lo + TEXTS] += texts @ marks
        size = np.array([len(s) for s in sets])
        return out / np.sqrt(np.maximum(size[:, None], 1) * np.maximum(self.sizes[None, :], 1))

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.kernels(sets) @ self.weights

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; 'und' and 0 for null and for texts without a letter."""
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if known and self.langs:
            raw = np.clip(self.scores([buckets(texts[i]) for i in known]), 1e-6, None)
            share = raw / raw.sum(axis=1, keepdims=True)
            for i, best, p in zip(known, share.argmax(axis=1), share.max(axis=1)):
                out[i] = self.langs[best], float(min(max(p, 0.0), 1.0))
        return out


def fit(texts: list[str], langs: list[str]) -> Model:
    """Kernel ridge regression, one language against the rest, on Nystroem features. Ties and order do not matter: the sample
    is taken in the order given."""
    names = sorted(set(langs))
    label = np.array([names.index(x) for x in langs], int)
    sets = [buckets(t) for t in texts]
    # Landmarks: as many of each language, in the order of the sample.
    each = max(2, LANDMARKS // max(1, len(names)))
    chosen = [i for k in range(len(names)) for i in np.flatnonzero(label == k)[:each]]
    every = np.unique(np.concatenate([np.empty(0, np.int64), *(sets[i] for i in chosen)]))
    row = np.zeros(1 << BITS, np.int32)
    row[every] = np.arange(1, len(every) + 1)
    presence = np.zeros((len(every) + 1, len(chosen)), np.uint8)
    for j, i in enumerate(chosen):
        presence[row[sets[i]], j] = 1
    model = Model(names, row, presence, np.array([len(sets[i]) for i in chosen]), np.empty((0, 0)))
    kernel = model.kernels(sets).astype(float) if sets else np.zeros((0, 0))
    own = kernel[chosen]
    value, vector = np.linalg.eigh((own + own.T) / 2) if len(chosen) else (np.empty(0), np.empty((0, 0)))
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    features = kernel @ root
    target = np.eye(len(names))[label]
    gram = features.T @ features
    ridge = np.linalg.solve(gram + RIDGE * max(1, len(sets)) * np.eye(len(gram)), features.T @ target) if len(sets) else np.empty((0, 0))
    model.weights = (root @ ridge).astype(np.float32)
    return model


def sample(rows: DataFrame) -> list[tuple[str, str]]:
    """(text, lang) of about SAMPLE rows (id_text, text, lang), evenly over all languages, two of each at least: the first by a
    hash of id and text, until the whole texts of a language reach its share of CHARS characters. Long texts are drawn like
    short ones; only one that exceeds CHARS alone is not; a repeated row is drawn once. The only rows that reach the driver; they grow with languages, not
    with rows."""
    usable = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= CHARS) & F.col("text").rlike(r"\p{L}"))
    usable = usable.withColumn("draw", F.pmod(F.xxhash64("id_text", "text"), F.lit(1 << 30)))
    counts = stage_table(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    langs = counts.count()
    if not langs:
        return []
    each = max(2, SAMPLE // langs)
    # About twice the share by a cut of the hash, so that the window below sees a bounded number of rows of each language.
    share = F.least(F.lit(1.0), F.lit(2.0 * each + 16) / F.col("n"))
    cut = counts.select("lang", (share * (1 << 30)).cast("long").alias("cut"))
    order = Window.partitionBy("lang").orderBy("draw", "text")
    drawn = usable.select("text", "lang", "draw").join(small_or_shuffled(cut), "lang").filter("draw < cut")
    drawn = drawn.groupBy("lang", "draw").agg(F.min("text").alias("text")).withColumn("place", F.row_number().over(order))
    drawn = drawn.withColumn("so_far", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    drawn = drawn.filter((F.col("place") <= each) & ((F.col("so_far") <= CHARS // langs) | (F.col("place") <= 2)))
    return [(r["text"], r["lang"]) for r in drawn.orderBy("draw", "lang", "text").select("text", "lang").collect()]


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    The model learns from text and non-null language of rows whose crc32(id as text) mod ``modulus`` is not 0; a prediction
    sees the whole text only. Of languages with equal scores the first by name is predicted. Null texts and texts without a letter are ``und`` with score 0, as is everything if there is
    nothing to learn from. Repeated rows and null ids (they count as empty text) give a row each; an empty table none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(id_col).cast("string").alias("id_text"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (fold(id_col, modulus) == 0).alias("held_out"))
    drawn = sample(rows.filter(~F.col("held_out")).select("id_text", "text", "lang"))
    model = fit([t for t, _ in drawn], [x for _, x in drawn])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                found = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return rows.select("doc_id", "held_out", "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")

"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE bytes. Each passage is encoded from counts of byte classes, hashed byte pairs and word
statistics by one dense layer. Gated attention, learned from document labels alone, weighs the passages; the weighted sum
of their encodings is the document, and a logistic unit scores it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm import hashing as H
from lodestack.llm.common import fold

PASSAGE, CLASSES, PAIRS = 512, 16, 64
FEATURES = CLASSES + PAIRS + 5
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 12, 30, 64, 0.01, 1e-4, 7
#: Bounds of the training sample: labelled rows, and bytes of all their texts together.
SAMPLE, BYTES = 3_000, 32_000_000
THRESHOLD = 0.3

#: Class of each byte: letters by case, digits, blanks, line ends, bytes of other scripts; marks by their code.
KIND = np.zeros(256, np.int64)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[32], KIND[10], KIND[128:] = 1, 2, 3, 4, 5, 6
for _b in (x for x in range(33, 127) if not chr(x).isalnum()):
    KIND[_b] = 7 + _b % (CLASSES - 7)


def passages(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, passages before each row, feature matrix), portion by portion. A text without bytes is one passage of zeros."""
    for lo, _, data, offsets in H.portions(column):
        size = np.diff(offsets)
        each = np.maximum(-(-size // PASSAGE), 1)
        first = np.r_[0, np.cumsum(each)]
        n = int(first[-1])
        start = np.repeat(offsets[:-1], each) + PASSAGE * (np.arange(n) - np.repeat(first[:-1], each))
        length = np.minimum(np.repeat(offsets[1:], each) - start, PASSAGE)
        of = np.repeat(np.arange(n), length)
        kinds = np.bincount(of * CLASSES + KIND[data], minlength=n * CLASSES).reshape(n, CLASSES)
        low = H.LOWER[data].astype(np.int64)
        pair = (low[:-1] * 31 + low[1:] * 17 + (low[1:] >> 3)) % PAIRS
        pairs = np.bincount((of[:-1] * PAIRS + pair)[of[:-1] == of[1:]], minlength=n * PAIRS).reshape(n, PAIRS)
        word, end, key, _ = H.words(data, offsets, H.SPACED)
        home = of[word]
        words = np.maximum(np.bincount(home, minlength=n), 1)
        marked = np.sort(home << 40 | (key >> np.uint64(24)).astype(np.int64))
        distinct = np.bincount(marked[np.r_[True, marked[1:] != marked[:-1]]] >> 40, minlength=n) if len(marked) else np.zeros(n)
        again = np.bincount(home[1:][(key[1:] == key[:-1]) & (home[1:] == home[:-1])], minlength=n)
        spread = np.bincount(home, weights=np.minimum(end - word, 40), minlength=n)
        long = np.bincount(home, weights=end - word > 20, minlength=n)
        scale = np.maximum(length, 1)[:, None]
        stats = np.stack([distinct / words, again / words, spread / words / 10, long / words, length / PASSAGE], 1)
        features = np.concatenate([np.sqrt(kinds / scale), np.sqrt(pairs / scale), stats], 1).astype(np.float32)
        features[length == 0] = 0
        yield lo, first, features


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Encoder, gated attention and classifier; ``shift`` and ``scale`` standardise the features."""

    def __init__(self, shift: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray]):
        self.shift, self.scale, self.weights = shift, scale, weights

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, at = self.weights, first[:-1]
        each = np.diff(first)
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * s) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), each))
        alpha = e / np.repeat(np.add.reduceat(e, at), each)
        z = np.add.reduceat(alpha[:, None] * h, at, axis=0)
        return {"h": h, "t": t, "s": s, "alpha": alpha, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f, at, each = self.weights, self.forward(x, first), first[:-1], np.diff(first)
        do = (f["p"] - y) / len(y)
        dz = np.repeat(do[:, None] * w["c"], each, axis=0)
        dalpha = (dz * f["h"]).sum(1)
        de = f["alpha"] * (dalpha - np.repeat(np.add.reduceat(f["alpha"] * dalpha, at), each))
        dg = de[:, None] * w["a"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = f["alpha"][:, None] * dz + dt @ w["V"].T + ds @ w["U"].T
        da = dh * (1 - f["h"] ** 2)
        return {
            "W": x.T @ da, "b": da.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ de,
            "c": f["z"].T @ do, "d": np.array([do.sum()]),
        }

    def score(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward((features - self.shift) / self.scale, first)["p"]


def fit(bags: list[np.ndarray], labels: list[int]) -> Model:
    """Adam on the cross entropy of the documents. Without rows, or with one label only, the score is that label's share."""
    rng = np.random.default_rng(SEED)
    every = np.concatenate([np.zeros((1, FEATURES)), *bags])
    shift, scale = every.mean(0), every.std(0) + 1e-3
    bags = [(b - shift) / scale for b in bags]
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = {"W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "a": init(GATE), "c": init(HIDDEN), "d": np.zeros(1)}
    y = np.array(labels, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    weights["d"][0] = np.log(share / (1 - share))
    model = Model(shift, scale, weights)
    if len(set(labels)) < 2:
        weights["c"][:] = 0
        return model
    m, v, step = {k: np.zeros_like(x) for k, x in weights.items()}, {k: np.zeros_like(x) for k, x in weights.items()}, 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            own = order[at:at + BATCH]
            first = np.r_[0, np.cumsum([len(bags[i]) for i in own])]
            step += 1
            for k, g in model.gradient(np.concatenate([bags[i] for i in own]), first, y[own]).items():
                g = g + DECAY * weights[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                weights[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, modulus: int) -> list[tuple[np.ndarray, int]]:
    """(passage features, label) of at most about SAMPLE labelled documents outside the held-out fold, drawn by a hash of
    their ids until their whole texts reach BYTES bytes; long texts are drawn like short ones. Labels other than null count
    as 1 if positive; of several labels or texts for one id the least counts."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, modulus) != 0))
    usable = usable.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("label"))
    usable = usable.withColumn("draw", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)))
    n = usable.count()
    drawn = usable.filter(F.col("draw") < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))).orderBy("draw", "doc_id").limit(SAMPLE + SAMPLE // 10)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.octet_length("text") <= BYTES)
    rows = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "draw").agg((F.min("label") > 0).cast("int").alias("label"), F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy("draw", "doc_id"))  # over the drawn rows only
    rows = rows.withColumn("so_far", so_far).filter(F.col("so_far") <= BYTES).select("draw", "label", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [features[a:b].tobytes() for _, first, features in passages(batch.column("text")) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("label"), pa.array(bags, pa.binary())], ["draw", "label", "bag"])

    found = rows.mapInArrow(encode, "draw long, label int, bag binary").collect()
    return [(np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES), r["label"]) for r in sorted(found, key=lambda r: (r["draw"], r["label"], bytes(r["bag"])))]


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 5, threshold: float = THRESHOLD
) -> DataFrame:
    """Every column of ``docs`` and held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    The model learns from labelled rows whose crc32(id as text) mod ``modulus`` is not 0; a score sees the whole text only.
    Null and empty texts are one empty passage and are scored as such. Without labels every score is 0.5. Repeated rows and
    null ids (they count as empty text and have no label) give a row each; an empty table none. Columns of ``docs`` named
    like a result are replaced.
    """
    drawn = sample(docs, labels, id_col, text_col, label_col, modulus)
    shared = docs.sparkSession.sparkContext.broadcast(fit([x for x, _ in drawn], [y for _, y in drawn]))
    rows = docs.withColumn("held_out", fold(id_col, modulus) == 0).drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.empty(0), *(shared.value.score(features, first) for _, first, features in passages(batch.column(text_col)))])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"]
            )

    kind = rows.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema
    return rows.mapInArrow(run, kind)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 5) -> DataFrame:
    """The rows of ``docs`` that ``score`` predicts as 1, with all their columns as they were, whatever their names are."""
    names = docs.columns
    key, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    marks = labels.select(F.col(id_col).alias(key), F.col(label_col).alias("label"))
    return score(plain, marks, key, text, "label", modulus).filter("predicted = 1").select(*plain.columns).toDF(*names)

"""Exact top-k search by integer inner product: tiled matrix products, a partial selection per tile, and a merge tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.session import stage_table

#: Rows of a shard tile, queries of one pass (the only thing sent to all executors), and lists merged at once.
SHARD, PASS, FAN = 4096, 4096, 16
SCALE = 1024
_LISTS = "tile long, part long, ids binary, scores binary"
_EXACT = float(2**53)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64. Floating products are exact while every partial sum stays below 2**53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < _EXACT:
        return (a @ b.T).astype(np.int64)
    exact = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
    top = 2**63 - 1
    return np.array([[max(-top - 1, min(top, sum(x * y for x, y in zip(q, v)))) for v in exact[1]] for q in exact[0]], np.int64)


def _select(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one list by (-score, id), in that order. Everything equal to the k-th score is compared by id."""
    if len(ids) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        over, tie = np.flatnonzero(scores > cut), np.flatnonzero(scores == cut)
        need = k - len(over)
        if len(tie) > need:
            tie = tie[np.argpartition(ids[tie], need - 1)[:need]]
        at = np.concatenate([over, tie])
        ids, scores = ids[at], scores[at]
    at = np.lexsort((ids, -scores))
    return ids[at], scores[at]


class _Lists:
    """One best list per query, each of at most k entries."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        self.ids[q], self.scores[q] = _select(np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores]), self.k)

    def pack(self) -> tuple[bytes, bytes]:
        """(sizes of all lists and then their ids, their scores), as one run of longs each."""
        sizes = np.array([len(x) for x in self.ids], np.int64)
        return np.concatenate([sizes, *self.ids]).tobytes(), np.concatenate([np.empty(0, np.int64), *self.scores]).tobytes()

    def merge(self, ids: bytes, scores: bytes) -> None:
        n = len(self.ids)
        flat, points = np.frombuffer(ids, np.int64), np.frombuffer(scores, np.int64)
        ends = np.cumsum(flat[:n])
        for q, (end, size) in enumerate(zip(ends, flat[:n])):
            if size:
                self.add(q, flat[n + end - size:n + end], points[end - size:end])


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and the integer components as double, of vectors that take part."""
    scaled = lambda x: x.cast("double") * SCALE
    # Doubles from 2**52 on are whole numbers already.
    part = F.transform(F.col(vec_col), lambda x: F.when(F.abs(scaled(x)) < 2.0**52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), part.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim)


def _search(batches: Iterator[pa.RecordBatch], groups: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    lists = {dim: _Lists(len(ids), k) for dim, (ids, _) in groups.items()}
    for batch in batches:
        vec, ids = batch.column("v"), batch.column("vec_id").to_numpy()
        dims = vec.value_lengths().to_numpy()
        for dim, (qids, q) in groups.items():
            rows = np.flatnonzero(dims == dim)
            for at in range(0, len(rows), SHARD):
                tile = rows[at:at + SHARD]
                own, scores = ids[tile], _product(q, _matrix(vec.take(pa.array(tile)), dim) if dim else np.zeros((len(tile), 0)))
                for j in range(len(qids)):
                    keep = own != qids[j]
                    lists[dim].add(j, *_select(own[keep], scores[j][keep], k))
    part = TaskContext.get().partitionId()
    packed = [(dim, part, *x.pack()) for dim, x in lists.items() if any(map(len, x.ids))]
    if packed:
        tiles, parts, ids, scores = zip(*packed)
        yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int64()), pa.array(parts, pa.int64()), pa.array(ids, pa.binary()), pa.array(scores, pa.binary())], ["tile", "part", "ids", "scores"])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query, exact, ties to the smaller id.

    Components are floor(1024 * x). Left out on both sides: rows with a null id or vector, and vectors with a null or
    non-finite component. Vectors are compared with those of their own length; candidates with the query's id are its
    own. Of several query rows with one id the smallest vector is asked. Repeated candidate rows each count. Fewer than k
    candidates give all; none give no row. Scores beyond 64 bits stop at the ends of the range.

    Queries go to the executors in passes of PASS at most, so what is broadcast has a fixed bound; a pass reads every
    candidate once, keeps k entries per query and task, and merges the tasks' lists FAN at a time.
    """
    spark = candidates.sparkSession
    asked = stage_table(
        _vectors(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("pass", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))), "queries"
    )
    n = asked.count()
    # Passes by hash, with room for their spread; a pass that holds more than PASS queries is cut below.
    passes = max(1, -(-n * 5 // (PASS * 4)))
    rows = _vectors(candidates, id_col, vec_col)
    found = []
    for p in range(passes):
        mine = asked.filter(F.col("pass") % passes == p).select("vec_id", "v").orderBy("vec_id").toPandas() if n else None
        if mine is None or not len(mine):
            continue
        for at in range(0, len(mine), PASS):
            block = mine.iloc[at:at + PASS]
            groups = {
                int(dim): (part["vec_id"].to_numpy(np.int64), np.array([list(v) for v in part["v"]], float).reshape(len(part), int(dim)))
                for dim, part in block.groupby(block["v"].map(len))
            }
            found.append(_one_pass(rows, groups, k))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _one_pass(rows: DataFrame, groups: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(groups)
    lists = stage_table(rows.mapInArrow(lambda batches: _search(batches, shared.value, k), _LISTS), "lists")

    def merged(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        best = _Lists(len(shared.value[key[0]][0]), k)
        for ids, scores in zip(df["ids"], df["scores"]):
            best.merge(ids, scores)
        return pd.DataFrame([(key[0], key[1], *best.pack())], columns=["tile", "part", "ids", "scores"])

    width = (lists.agg(F.max("part")).first()[0] or 0) + 1
    while width > 1:
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("tile", "part").applyInPandas(merged, _LISTS)
        width = -(-width // FAN)

    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for tile, ids, scores in zip(df["tile"], df["ids"], df["scores"]):
                qids = shared.value[tile][0]
                flat, points = np.frombuffer(ids, np.int64), np.frombuffer(scores, np.int64)
                sizes = flat[: len(qids)]
                rank = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                yield pd.DataFrame({"query_id": np.repeat(qids, sizes), "rank": rank.astype(np.int32), "vec_id": flat[len(qids):], "score": points})

    return lists.mapInPandas(rows_of, "query_id long, rank int, vec_id long, score long")

"""Hard negatives by threshold joins on an inverted index with suffix-norm bounds (after L2AP).

Anchors are dealt to blocks, all rows to groups, and a cell is one block and one group: a task reads the anchors of a cell and
then streams its rows, a tile at a time. A tile is indexed by pieces of CHUNK dimensions. Two bounds follow from norms alone
(|q . x| <= |q| |x| on any set of dimensions):

- index: the leading dimensions of a row stay out of the index while their norm is below every threshold divided by the norm
  of the anchor, since a row that meets an anchor only there can't reach its threshold;
- search: partial scores are summed from the last piece to the first, and a pair goes as soon as its partial score and the
  norms of what remains are below the threshold. What is left is completed with the dimensions that are not in the index.

An anchor's threshold starts high and is lowered until all its windows hold enough rows, or to the least score that its windows
admit; from then on it is the least score that can still enter a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import pieces
from lodestack.session import stage_table

POSITIVES, NEGATIVES, SCALE = 5, 5, 256
#: Dimensions of one piece of the index, rows of a tile, anchors searched at once.
CHUNK, TILE, ANCHORS = 8, 4096, 128
#: Bytes of the anchors of a block, rows of a group, and the number of groups of a small table.
BLOCK_BYTES, GROUP_ROWS, GROUPS = 8 << 20, 1 << 16, 16
#: Thresholds that are tried, as shares of the highest score that is possible (or asked for).
STEPS = (0.95, 0.85, 0.7, 0.5, 0.25)
_EXACT, _SLACK = float(2**53), 1e-9
#: Beyond all scores, which stop one short of them.
_MIN, _MAX = -(2**63), 2**63 - 1


class _Tile:
    """Rows of one cell: ids, labels, whole-number components, and the norms of their leading pieces."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.norms = _leading_norms(x)
        self.top = np.abs(x).max(initial=0)


def _leading_norms(x: np.ndarray) -> np.ndarray:
    """Norm of the first k pieces of every row, k from 0."""
    cuts = list(range(0, x.shape[1], CHUNK))
    out = np.zeros((len(x), len(cuts) + 1))
    if cuts and len(x):
        with np.errstate(over="ignore"):
            np.cumsum(np.add.reduceat(x * x, cuts, axis=1), axis=1, out=out[:, 1:])
    return np.sqrt(out)


def _exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of all pairs where doubles are not exact; they stop at the ends of 64 bits."""
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, _MIN + 1, _MAX - 1).astype(np.int64)


def _reaching(tile: _Tile, q: np.ndarray, norms: np.ndarray, labels: np.ndarray, low: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs of equal (or different) labels whose score is at least the anchor's ``low``."""
    allowed = (labels[:, None] == tile.labels) == same
    if not q.shape[1] or np.abs(q).max(initial=0) * tile.top * q.shape[1] >= _EXACT:
        scores = _exact_scores(q, tile.x) if q.shape[1] else np.zeros(allowed.shape, np.int64)
        a, r = np.nonzero(allowed & (scores >= low[:, None]))
        return a, r, scores[a, r]
    whole = norms[:, -1]
    least = low.astype(float) - 1e-6
    if not whole.any() or not tile.top:
        a, r = np.nonzero(allowed & (least < 0)[:, None])
        return a, r, np.zeros(len(a), np.int64)
    # Leading pieces that no threshold needs.
    need = np.where(whole > 0, least / np.where(whole > 0, whole, 1), np.where(least < 0, -np.inf, np.inf)).min()
    omitted = (tile.norms[:, 1:] < need * (1 - _SLACK)).sum(axis=1) if need > 0 else np.zeros(len(tile.x), np.int64)
    last = len(norms[0]) - 1
    live = np.flatnonzero((omitted < last) & allowed.any(axis=0))
    bound = lambda k, rows: (norms[:, k, None] * tile.norms[rows, k]) * (1 + _SLACK)
    open_pairs = allowed[:, live] & (bound(last, live) >= least[:, None])
    sums = np.zeros(open_pairs.shape)
    for k in range(last - 1, -1, -1):
        held = open_pairs.any(axis=0)
        if held.sum() < 0.7 * len(held):
            live, open_pairs, sums = live[held], open_pairs[:, held], sums[:, held]
        posted = np.flatnonzero(omitted[live] <= k)
        if not len(posted):
            break
        piece = slice(k * CHUNK, (k + 1) * CHUNK)
        every = len(posted) == len(live)
        at = slice(None) if every else posted
        sums[:, at] += q[:, piece] @ tile.x[live[at], piece].T
        open_pairs[:, at] &= sums[:, at] + bound(k, live[at]) >= least[:, None]
    a, c = np.nonzero(open_pairs)
    r, scores = live[c], sums[a, c]
    for k in np.unique(omitted[r]):
        if k:
            mine = np.flatnonzero(omitted[r] == k)
            for cut in np.array_split(mine, -(-len(mine) // 65536)):
                scores[cut] += np.einsum("ij,ij->i", q[a[cut], : k * CHUNK], tile.x[r[cut], : k * CHUNK])
    scores = np.rint(scores).astype(np.int64)
    kept = scores >= low[a]
    return a[kept], r[kept], scores[kept]


class _Block:
    """Anchors of a cell, with windows [lo, hi] of scores and the best ``k`` rows found for each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.q, self.lo, self.hi = ids[order], labels[order], q[order], lo[order], hi[order]
        self.norms, self.k, self.same = _leading_norms(self.q), k, same
        self.found = tuple(np.empty(0, np.int64) for _ in range(4))  # anchor, window, id, score
        self.need = np.where(self.lo <= self.hi, self.lo, _MAX)

    def _add(self, a: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows = [self.found]
        for w in range(self.lo.shape[1]):
            fits = (scores >= self.need[a, w]) & (scores <= self.hi[a, w]) & (self.lo[a, w] <= self.hi[a, w])
            if fits.any():
                rows.append((a[fits], np.full(fits.sum(), w), ids[fits], scores[fits]))
        if len(rows) == 1:
            return
        a, w, i, s = (np.concatenate(c) for c in zip(*rows))
        order = np.lexsort((i, -s, w, a))
        a, w, i, s = a[order], w[order], i[order], s[order]
        head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])])
        size = np.diff(np.r_[head, len(a)])
        kept = np.arange(len(a)) - np.repeat(head, size) < self.k
        full = size >= self.k
        self.need[a[head[full]], w[head[full]]] = s[head[full] + self.k - 1]
        self.found = a[kept], w[kept], i[kept], s[kept]

    def search(self, tile: _Tile) -> None:
        top = tile.norms[:, -1].max(initial=0)
        for at in range(0, len(self.ids), ANCHORS):
            mine = np.arange(at, min(at + ANCHORS, len(self.ids)))
            asked = np.where(self.lo[mine] <= self.hi[mine], self.hi[mine], _MIN).max(axis=1)
            with np.errstate(over="ignore"):
                ceiling = np.minimum(self.norms[mine, -1] * top, asked.astype(float))
            above = np.full(len(mine), _MAX)
            for share in (*STEPS, None):
                floor = self.need[mine].min(axis=1)
                # Lowered as far as the next step, never below what can still enter a window.
                step = floor if share is None else np.maximum(floor, np.where(ceiling > 0, np.minimum(ceiling, 2.0**62) * share, _MIN).astype(np.int64))
                todo = np.flatnonzero((floor < _MAX) & (floor < above) & (step < above))
                if not len(todo):
                    continue
                rows = mine[todo]
                a, r, s = _reaching(tile, self.q[rows], self.norms[rows], self.labels[rows], step[todo], self.same)
                fresh = (s < above[todo][a]) & (tile.ids[r] != self.ids[rows][a])
                above[todo] = step[todo]
                self._add(rows[a[fresh]], tile.ids[r[fresh]], s[fresh])

    def rows(self) -> pa.RecordBatch:
        a, w, i, s = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[a]), pa.array(w.astype(np.int32)), pa.array(i), pa.array(s)], ["anchor_id", "slot", "vec_id", "score"])


def _cells(batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Best rows of every anchor and window within each cell. Rows come sorted by cell, anchors first."""
    cell, block, anchors = None, None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "block", "part")], 1)
        kind = batch.column("kind").to_numpy()
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1) | (kind[1:] != kind[:-1])]) if len(keys) else []
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(keys)]):
            if tuple(keys[lo]) != cell:
                if block is not None:
                    yield block.rows()
                cell, block, anchors = tuple(keys[lo]), None, []
            if kind[lo] == 0:
                anchors.append(batch.slice(lo, hi - lo))
                continue
            if block is None:
                if not anchors:  # nobody asks in this cell
                    continue
                block, anchors = _block(pa.Table.from_batches(anchors).combine_chunks(), cell[0], k, same), []
            for at in range(lo, hi, TILE):
                part = batch.slice(at, min(TILE, hi - at))
                block.search(_Tile(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("v"), cell[0])))
    if block is not None:
        yield block.rows()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _block(rows: pa.Table, dim: int, k: int, same: bool) -> _Block:
    column = lambda c: rows.column(c).combine_chunks()
    windows = len(column("lo")[0])
    return _Block(column("vec_id").to_numpy(), column("label").to_numpy(), _matrix(column("v"), dim), _matrix(column("lo"), windows), _matrix(column("hi"), windows), k, same)


def _best(anchors: DataFrame, rows: DataFrame, groups: int, k: int, same: bool) -> DataFrame:
    """anchor_id, slot, rank, vec_id, score: the first ``k`` rows of every window of every anchor.

    ``anchors`` (vec_id, label, v, lo, hi) is sent to every group of rows once, and every row to every block of anchors: the
    tables meet in blocks, no pair of rows is ever a record, and what a cell returns is bounded by k for each window.
    """
    spark = rows.sparkSession
    asked = anchors.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0
    blocks = max(1, -(-asked // BLOCK_BYTES))
    none = F.lit(None).cast("array<long>")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), spread(groups).alias("part"), F.lit(0).alias("kind"), "vec_id", "label", "v", "lo", "hi")
    # Rows go round the groups, so that rows of one id or one vector do not meet in one.
    right = rows.withColumn("part", (F.monotonically_increasing_id() % groups).cast("int"))
    right = right.select(F.size("v").alias("dim"), spread(blocks).alias("block"), "part", F.lit(1).alias("kind"), "vec_id", "label", "v", none.alias("lo"), none.alias("hi"))
    cell = ["dim", "block", "part"]
    dealt = left.unionAll(right).repartition(pieces(spark), *cell).sortWithinPartitions(*cell, "kind")
    found = dealt.mapInArrow(lambda batches: _cells(batches, k, same), "anchor_id long, slot int, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("anchor_id", "slot", "rank", "vec_id", "score")


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (whole numbers as double) of the rows that take part."""
    part = F.transform(F.col(vec_col), lambda x: _floor(x.cast("double") * scale))
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    kept = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), part.alias("v"))


def _floor(x):
    # Doubles from 2**52 on are whole numbers already.
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` and ``anchors`` are tables of ``vectors``. A row's score is its integer inner product with the anchor; higher ones
    come first, ties by the smaller id. The positives of an anchor are the first ``positives`` rows of its label; for each, the
    first ``negatives`` rows of other labels follow whose score is at most the positive's and at least four fifths of it (so
    none if the positive's is negative).

    Rows with the anchor's id are its own and never found. Vectors meet only those of their length; empty ones score 0. Repeated
    rows each count, so a positive may appear twice and then has its negatives twice. Of several anchor rows with one id the one
    with the smallest label and vector asks. An anchor without positives, or whose positives have no negatives, gives no row, nor
    do empty tables. Scores beyond 64 bits stop one short of the ends of the range. Nothing is collected; see ``_best`` for what moves.
    """
    asking = stage_table(
        anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", F.col("s.label").alias("label"), F.col("s.v").alias("v")), "anchors"
    )
    groups = max(-(-rows.count() // GROUP_ROWS), GROUPS)
    one = lambda v: F.array(F.lit(v).cast("long"))
    near = stage_table(_best(asking.withColumn("lo", one(_MIN)).withColumn("hi", one(_MAX)), rows, groups, positives, True), "positives")
    ranked = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    # Window i is [four fifths, rounded up, of the i-th positive's score, that score]; those that are missing are empty.
    score = lambda i: F.expr(f"get(p, {i}).score")
    low = F.array(*[F.coalesce(F.when(score(i) >= 0, F.expr(f"get(p, {i}).score - get(p, {i}).score div 5")), F.lit(1).cast("long")) for i in range(positives)])
    high = F.array(*[F.coalesce(score(i), F.lit(0).cast("long")) for i in range(positives)])
    windows = asking.join(ranked, asking.vec_id == ranked.anchor_id).select("vec_id", "label", "v", low.alias("lo"), high.alias("hi"))
    far = _best(stage_table(windows, "windows"), rows, groups, negatives, False)
    pairs = near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(pairs, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


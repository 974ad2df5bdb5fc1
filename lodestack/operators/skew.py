"""Joins, prefix scans and row selection that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.session import stage_table

# Rows that one piece of a frequent key should hold, and the least number of pieces that a table is thought of as.
PIECE_ROWS, PIECES = 1_000_000, 256
# Bits of an order value that fall into one block of a prefix scan.
BLOCK_BITS = 16
# Digests among which the driver picks the wanted ranks.
FEW = 10_000


def hot_keys(df: DataFrame, on: list[str], share: int | None = None) -> DataFrame:
    """Keys that hold more than a piece, with their number of pieces.

    A table has at least PIECES pieces and otherwise pieces of PIECE_ROWS rows (``share`` fixes their number); a key with
    at least one piece's rows is hot. So there are no more hot keys than pieces, one short row for a million rows.
    """
    sizes = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_n")).scalar()
    number = F.lit(share) if share else F.greatest(F.lit(PIECES), F.ceil(total / PIECE_ROWS))
    return sizes.filter(F.col("_n") * number >= total).select(*on, F.ceil(F.col("_n") * number / total).alias("_pieces"))


def hot_pieces(df: DataFrame, on: list[str]) -> DataFrame:
    """``hot_keys`` counted once and kept, for the two sides of a join."""
    return stage_table(hot_keys(df, on), "hot-keys")


def lookup_join(
    big: DataFrame, dim: DataFrame, on: list[str], unique: str, how: str = "left", hot: DataFrame | None = None
) -> DataFrame:
    """Equi-join ``big``, whose keys may be skewed, with ``dim``, which has at most one row per key.

    Rows of a hot key are spread over its pieces by the unique column, and only the matching rows of ``dim`` are repeated.
    All other keys join once. ``hot`` (of ``hot_pieces``) saves the pass over ``big`` that finds the hot keys.
    """
    hot = F.broadcast(hot_pieces(big.select(*on), on) if hot is None else hot)
    piece = F.when(F.col("_pieces").isNotNull(), F.pmod(F.xxhash64(unique), F.col("_pieces"))).otherwise(F.lit(0).cast("long"))
    spread = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_pieces") - 1, F.lit(0)).cast("long"))
    left = big.join(hot, on, "left").withColumn("_salt", piece).drop("_pieces")
    right = dim.join(hot, on, "left").withColumn("_salt", F.explode(spread)).drop("_pieces")
    return left.join(right, on + ["_salt"], how).drop("_salt")


def own_rows(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key no other row has, and those that share theirs or have none (None if there are no such rows)."""
    counted = df.groupBy(F.col(key).alias("_shared")).agg(F.count(F.lit(1)).alias("n"))
    shared = stage_table(counted.filter("n > 1 or _shared is null").select("_shared"), "shared-keys")
    if shared.isEmpty():
        return df, None
    same = F.col(key).eqNullSafe(F.col("_shared"))
    return df.join(shared, same, "left_anti"), df.join(shared, same, "left_semi")


_COMBINE = {"min": F.min, "max": F.max, "sum": F.sum}


def _merge(kind: str, left: Column, right: Column) -> Column:
    if kind == "sum":
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return (F.least if kind == "min" else F.greatest)(left, right)


def prefix_scan(
    df: DataFrame, keys: list[str], order: str, specs: dict[str, tuple[str, Column, bool]], bits: int = BLOCK_BITS
) -> DataFrame:
    """Running min / max / sum per key in ``order`` (an integer column, unique per key).

    ``specs`` maps an output name to (kind, value, inclusive). A key is cut into blocks of 2**bits consecutive order values.
    One window runs inside the blocks; what precedes a block is the running total of block totals, found in the same way, so
    no window holds more than 2**bits rows of a key however long it is. The input is read once: the totals of a block are the
    values of its last row, and only the totals are written.
    """
    marked = df.withColumn("_block", F.shiftright(F.col(order).cast("long"), bits))
    part = Window.partitionBy(*keys, "_block").orderBy(order)
    rows = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scanned = marked
    for name, (kind, value, inclusive) in specs.items():
        frame = rows if inclusive else part.rowsBetween(Window.unboundedPreceding, -1)
        scanned = scanned.withColumn(f"_v_{name}", value).withColumn(f"_r_{name}", _COMBINE[kind](f"_v_{name}").over(frame))
        scanned = scanned.withColumn(f"_t_{name}", _COMBINE[kind](f"_v_{name}").over(whole))
    scanned = stage_table(scanned.withColumn("_first", F.row_number().over(part) == 1).drop(*[f"_v_{n}" for n in specs]), "blocks")
    totals = scanned.filter("_first").select(*keys, "_block", *[f"_t_{n}" for n in specs])
    # Blocks beside one another form larger blocks; a single one has nothing before it.
    widest = totals.agg(F.max("_block").alias("hi"), F.min("_block").alias("lo")).first()
    before = None
    if widest.hi is not None and widest.hi > widest.lo:
        exclusive = {f"_b_{n}": (kind, F.col(f"_t_{n}"), False) for n, (kind, _, _) in specs.items()}
        if (widest.hi >> bits) > (widest.lo >> bits):
            before = prefix_scan(totals.withColumnRenamed("_block", "_order"), keys, "_order", exclusive, bits).withColumnRenamed("_order", "_block")
        else:
            across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
            before = totals.select(*keys, "_block", *[_COMBINE[kind](value).over(across).alias(n) for n, (kind, value, _) in exclusive.items()])
        before = before.select(*keys, "_block", *exclusive)
    out = scanned if before is None else scanned.join(before, keys + ["_block"])
    for name, (kind, _, _) in specs.items():
        earlier = F.col(f"_r_{name}") if before is None else _merge(kind, F.col(f"_b_{name}"), F.col(f"_r_{name}"))
        out = out.withColumn(name, F.coalesce(earlier, F.lit(0)) if kind == "sum" else earlier)
    return out.select(*df.columns, *specs)


def ordered_key(seed: int, *columns: str) -> Column:
    """Deterministic pseudo-random order: depends on the seed and the row identity, not on partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def rank_cut(hashed: DataFrame, column: str, ranks: Callable[[int], list[int]]) -> list[Column]:
    """Values of ``column`` (hex digests, unique) at 1-based ranks, which may depend on the number of rows; null where there is
    no such rank.

    Radix selection: one pass counts rows per four digits (65,536 counters), a second one keeps the rows whose first four
    digits are those of a wanted rank, one in 65,536 for each; further digits are counted among those, until at most FEW
    candidates are left. All cuts go together, no table is sorted or numbered.
    """

    def counted(df: DataFrame, level: int) -> dict[str, list[tuple[str, int]]]:
        """Counts of the next four digits below each prefix, in order."""
        digits = F.substring(column, 1, 4 * (level + 1)).alias("p")
        found: dict[str, list[tuple[str, int]]] = {}
        for row in df.groupBy(digits).agg(F.count(F.lit(1)).alias("c")).orderBy("p").collect():
            found.setdefault(row.p[: 4 * level], []).append((row.p, row.c))
        return found

    counts = counted(hashed, 0)
    total = sum(c for _, c in counts.get("", []))
    places = [("", k) if 1 <= k <= total else None for k in ranks(total)]
    rows = hashed
    for level in range(8):
        for i, place in enumerate(places):
            if place is not None:
                prefix, left = place
                for p, c in counts[prefix]:
                    if left <= c:
                        places[i] = (p, left)
                        break
                    left -= c
        wanted = sorted({p[0] for p in places if p is not None})
        if level == 7 or not wanted:
            break
        kept = rows.filter(F.substring(column, 1, 4 * (level + 1)).isin(wanted)).select(column)
        if sum(c for group in counts.values() for p, c in group if p in wanted) <= FEW:
            values = sorted(r[0] for r in kept.collect())
            below = lambda prefix: [v for v in values if v.startswith(prefix)]
            places = [None if p is None else (below(p[0])[p[1] - 1], 1) for p in places]
            break
        rows = stage_table(kept, "rank") if level == 0 else kept
        counts = counted(rows, level + 1)
    return [F.lit(None).cast("string") if p is None else F.lit(p[0]) for p in places]

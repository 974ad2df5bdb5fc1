"""Exact and near duplicates. No operator here emits the pairs of a group: links go to one representative."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import tokens
from lodestack.operators.skew import lookup_join
from lodestack.session import cut_lineage, stage_table


def digest(*columns: str) -> Column:
    """256-bit key of one or more text columns; null differs from ''."""
    parts = [F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-")) for c in columns]
    return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)


def dedup_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the row with the smallest ``order`` (unique) per key: one aggregate over digests that carries the row along.

    The input is evaluated once. A key that holds a third of all rows is reduced to one row per map task before the shuffle;
    a window would send all of them to one task. Select the columns that are needed before: whole rows move.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(digest(*keys).alias("_key")).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def audit_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row: number of rows, of distinct keys, and whether they differ. Exact."""
    groups = df.groupBy(digest(*keys).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows")).select(
        F.lit(name).alias("dataset"), "rows", "distinct_rows", (F.col("rows") != F.col("distinct_rows")).alias("has_duplicates")
    )


def duplicate_groups(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """One row per group of equal values with more than one member: keeper (largest id), size and number of pairs."""
    groups = df.groupBy(digest(key).alias("key_digest")).agg(F.max(id_col).alias("keeper"), F.count(F.lit(1)).alias("size"))
    pairs = (F.col("size") * (F.col("size") - 1) / 2).cast("long")
    return groups.filter(F.col("size") > 1).withColumn("n_pairs", pairs)


def duplicate_links(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """One link (id, keeper) per redundant row: linear in the rows where all pairs would be quadratic.

    The links connect exactly the rows that the pairs connect, so they have the same components.
    """
    rows = df.select(id_col, digest(key).alias("key_digest"))
    linked = lookup_join(rows, duplicate_groups(df, key, id_col).select("key_digest", "keeper"), ["key_digest"], id_col, "inner")
    return linked.filter(F.col(id_col) != F.col("keeper")).select(F.col(id_col).alias("id"), "keeper")


def unique_ids(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """One representative per distinct value: the largest id."""
    return df.groupBy(digest(key).alias("_key")).agg(F.max(id_col).alias("id")).select("id")


def components(links: DataFrame, left: str = "id", right: str = "keeper") -> DataFrame:
    """Connected components of any link table as (id, root), root being the largest id of the component.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Every step is an aggregate and a
    skew-proof lookup; lineage is cut by a reliable checkpoint per round. Ends when nothing changes.
    """
    edges = cut_lineage(
        links.select((-F.col(left)).alias("u"), (-F.col(right)).alias("v")).filter("u <> v").distinct()
    )
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = lookup_join(both.filter("v > u"), low, ["u"], "v", "inner").filter("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        directed = cut_lineage(large.distinct())
        floor = directed.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup_join(directed, floor, ["u"], "v", "inner").filter("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        edges = cut_lineage(small.union(floor.select("u", F.col("m").alias("v"))).distinct())
        seen = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state:
            break
        state = seen
    stars = edges.select((-F.col("u")).alias("id"), (-F.col("v")).alias("root"))
    return stars.union(stars.select(F.col("root").alias("id"), "root").distinct())


# --- near duplicates --------------------------------------------------------------------------------------------

# Rows of one piece of a posting list. Shingles that a task deals out at once, and those of one part of all hashes.
PIECE = 4096
FLUSH, SHARD = 1_000_000, 2_000_000


def shingle_hashes(text: Column, width: int = 3) -> Column:
    """Distinct hashed runs of ``width`` tokens; a shorter text is one shingle."""
    words = tokens(text)

    def runs(w: Column) -> Column:
        last = F.greatest(F.size(w) - width, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, F.lit(width)), " ")))

    return F.array_distinct(F.transform(F.array(words), runs)[0])


def _arrays(column: pd.Series, kind: type) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x in column)])


def _lists(place: np.ndarray, k: np.ndarray, n: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """(place, sets, sizes, how many values of each, values) for each place, as bytes; rows are sorted by place and set, so a
    set is named once for all of its values that go to one place."""
    cut = np.flatnonzero(np.r_[len(k) > 0, (place[1:] != place[:-1]) | (k[1:] != k[:-1])])
    end = np.r_[cut[1:], len(k)]
    at = np.flatnonzero(np.r_[len(cut) > 0, place[cut][1:] != place[cut][:-1]])
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(cut)]):
        own = slice(int(cut[a]), int(end[b - 1]))
        yield int(place[own.start]), k[cut[a:b]].tobytes(), n[cut[a:b]].tobytes(), (end - cut)[a:b].astype(np.int32).tobytes(), *(v[own].tobytes() for v in values)


def _place(h: np.ndarray, places: int) -> np.ndarray:
    """Number below ``places`` by the upper bits of hashes."""
    return ((h.view(np.uint64) >> np.uint64(40)) * np.uint64(places) >> np.uint64(24)).astype(np.int64)


def _by_rarity(sets: DataFrame, permille: int) -> DataFrame:
    """k, n, r: the size of every set (k, sh) that may have a partner, and those of its shingles that another set has too, the
    rarest first.

    Every shingle moves once, in lists of one part of all hashes, where it is counted; those that occur once, most of them, move
    no further. A part holds some SHARD shingles; one that all sets have is one row of each. What is left goes back to its set. A
    set is left out if fewer of its shingles are shared than similarity asks for.
    """
    total = sets.agg(F.sum(F.size("sh"))).first()[0] or 0
    places = max(1, -(-total // SHARD))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            keys, sizes, h = (np.concatenate(x) for x in zip(*held))
            place = _place(h, places)
            by = np.argsort(place, kind="stable")
            rows = list(_lists(place[by], np.repeat(keys, sizes)[by], np.repeat(sizes, sizes)[by], h[by]))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] + [pa.binary()] * 4)], ["place", "k", "n", "m", "h"])

        held, waiting = [], 0
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, len(batch), 256)):
                sh = part.column("sh")
                held.append((part.column("k").to_numpy(), sh.value_lengths().to_numpy().astype(np.int32), sh.flatten().to_numpy()))
                waiting += len(held[-1][2])
                if waiting >= FLUSH:
                    yield told()
                    held, waiting = [], 0
        if waiting:
            yield told()

    def count(df: pd.DataFrame) -> pd.DataFrame:
        m, h = _arrays(df["m"], np.int32), _arrays(df["h"], np.int64)
        k, n = np.repeat(_arrays(df["k"], np.int64), m), np.repeat(_arrays(df["n"], np.int32), m)
        _, at, times = np.unique(h, return_inverse=True, return_counts=True)
        c = np.minimum(times[at], np.iinfo(np.int32).max).astype(np.int32)
        own = c > 1
        k, n, h, c = k[own], n[own], h[own], c[own]
        place = _place(k, places)
        by = np.lexsort((k, place))
        return pd.DataFrame(list(_lists(place[by], k[by], n[by], h[by], c[by])), columns=["place", "k", "n", "m", "h", "c"])

    def order(df: pd.DataFrame) -> pd.DataFrame:
        m, h, c = _arrays(df["m"], np.int32), _arrays(df["h"], np.int64), _arrays(df["c"], np.int32)
        k, n = np.repeat(_arrays(df["k"], np.int64), m), np.repeat(_arrays(df["n"], np.int32), m)
        by = np.lexsort((h, c, k))
        by = by[np.r_[len(k) > 0, (k[by][1:] != k[by][:-1]) | (h[by][1:] != h[by][:-1])]]  # repeated rows bring a set more than once
        k, n, h = k[by], n[by], h[by]
        cut = np.flatnonzero(np.r_[len(k) > 0, k[1:] != k[:-1]])
        rows = [(k[a], n[a], h[a:b]) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(k)]) if b - a > int(n[a]) * permille // 1000]
        return pd.DataFrame(rows, columns=["k", "n", "r"])

    dealt = sets.select("k", "sh").mapInArrow(deal, "place long, k binary, n binary, m binary, h binary")
    shared = dealt.groupBy("place").applyInPandas(count, "place long, k binary, n binary, m binary, h binary, c binary")
    return shared.groupBy("place").applyInPandas(order, "k long, n int, r array<long>")


def similar_pairs(sets: DataFrame, permille: int, piece: int = PIECE) -> DataFrame:
    """(a, b): all pairs of ``sets`` (k, sh), k being a hash, with a Jaccard similarity above ``permille`` / 1000, each once.

    Prefix filter: with shingles in one global order, by rarity, two similar sets share one of their first n - floor(t n).
    Shingles of a single set come first and cannot be the shared one, so a set with that many of them has no partner at all.
    Length filter: the smaller set has more than t times the size of the larger. Positional filter: what follows a shared
    shingle on both sides must still suffice; the first shared one of a similar pair always passes. A posting list of more
    than ``piece`` rows is cut into pieces that meet two by two, so no task holds one list. One round: each candidate is
    looked at once, by the exact intersection.
    """
    ordered = stage_table(_by_rarity(sets, permille).withColumnRenamed("k", "id"), "ordered-sets")
    alone = F.col("n") - F.size("r")
    length = F.greatest(F.size("r") - F.expr(f"(n * {permille}) div 1000"), F.lit(0)).cast("int")
    postings = ordered.select("id", "n", alone.alias("alone"), F.posexplode(F.slice("r", F.lit(1), length)).alias("at", "h"))
    postings = stage_table(postings.select("id", "n", (F.col("alone") + F.col("at")).alias("pos"), "h"), "postings")
    long_lists = postings.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > piece)
    cut = lookup_join(postings, long_lists.select("h", F.ceil(F.col("c") / piece).cast("int").alias("k")), ["h"], "id")
    own = F.pmod(F.xxhash64("id"), F.coalesce("k", F.lit(1))).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)))
    cut = cut.select("h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "n", "pos")
    left = cut.filter("own = lo").select("h", "lo", "hi", *[F.col(c).alias(f"a_{c}") for c in ("id", "n", "pos")])
    right = cut.filter("own = hi").select("h", "lo", "hi", *[F.col(c).alias(f"b_{c}") for c in ("id", "n", "pos")])
    fits = (
        "(lo < hi or a_id < b_id) and 1000 * least(a_n, b_n) > %d * greatest(a_n, b_n) "
        "and 1 + least(a_n - a_pos, b_n - b_pos) - 1 > (%d * (a_n + b_n)) div %d" % (permille, permille, 1000 + permille)
    )
    asked = left.join(right, ["h", "lo", "hi"]).filter(fits).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()
    member = lambda k, s, m: ordered.select(F.col("id").alias(k), F.col("r").alias(s), F.col("n").alias(m))
    both = asked.join(member("a", "x", "nx"), "a").join(member("b", "y", "ny"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(1000 * common > permille * (F.col("nx") + F.col("ny") - common)).select("a", "b")


def near_duplicate_links(df: DataFrame, key: str, id_col: str, threshold: float = 0.85, width: int = 3, piece: int = PIECE) -> DataFrame:
    """Links (id, other) of all texts whose shingle sets have a Jaccard similarity above ``threshold`` (to a thousandth).

    Texts with equal sets form a class, represented by its largest id: the members link to it (``other``), which is linear in
    the copies. Between representatives every similar pair is a link, the smaller id first. None is lost, so chains are whole.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(key).alias("text"))
    sh = F.sort_array(shingle_hashes(F.col("text"), width))
    # The shingles themselves are many times the text's size on disk, so they are made twice and not kept.
    whole = F.sha2(F.array_join(F.transform("sh", lambda h: h.cast("string")), ","), 256)
    keyed = stage_table(rows.withColumn("sh", sh).select("id", whole.alias("_key"), F.xxhash64("id", "sh").alias("k")), "shingles")
    classes = stage_table(keyed.groupBy("_key").agg(F.max("id").alias("other"), F.count(F.lit(1)).alias("size")), "classes")
    copies = lookup_join(keyed.select("id", "_key"), classes.filter("size > 1").select("_key", "other"), ["_key"], "id", "inner")
    sets = rows.join(classes.select(F.col("other").alias("id")), "id", "left_semi").select("id", sh.alias("sh")).filter("sh is not null")
    pairs = similar_pairs(sets.select(F.xxhash64("id", "sh").alias("k"), "sh"), round(1000 * threshold), piece)
    names = keyed.select("k", "id").distinct()
    pairs = pairs.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").filter("x <> y").select(F.least("x", "y").alias("id"), F.greatest("x", "y").alias("other"))
    return copies.filter("id <> other").select("id", "other").unionAll(pairs)

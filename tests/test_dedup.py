import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions.text import tokens
from lodestack.operators import dedup
from lodestack.operators.lookups import nearest_manifest
from lodestack.operators.skew import hot_keys, lookup_join


def test_dedup_first_is_idempotent_and_keeps_the_first(spark):
    rows = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", None), (4, None, "z"), (5, None, "w")], "i long, k string, v string")
    once = dedup.dedup_first(rows, ["k"], "i")
    assert {r.i for r in once.collect()} == {1, 2, 4}
    assert once.exceptAll(dedup.dedup_first(once, ["k"], "i")).count() == 0


def test_dedup_first_keeps_one_row_of_equal_order(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", None)], "i long, k string, `v.w` string")
    assert sorted(map(tuple, dedup.dedup_first(rows, ["k"], "i").collect()), key=repr) == [(1, "a", "x"), (1, "b", None)]


def test_hot_group(spark):
    """A third of all rows are copies of one text."""
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("t"))
    assert [r.t for r in hot_keys(rows, ["t"]).collect()] == ["hot"]
    assert dedup.dedup_first(rows, ["t"], "id").count() == 2001
    links = dedup.duplicate_links(rows, "t", "id")
    assert links.count() == 999 and {r.keeper for r in links.select("keeper").distinct().collect()} == {2997}
    dim = rows.select("t").distinct().withColumn("n", F.length("t"))
    joined = lookup_join(rows, dim, ["t"], "id")
    assert joined.count() == 3000 and joined.filter("n is null").count() == 0
    assert lookup_join(rows, dim.filter("t = 'hot'"), ["t"], "id", "inner").count() == 1000
    assert lookup_join(rows, dim.filter("t = 'hot'"), ["t"], "id", "left_semi").count() == 1000


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 60)]
    got = dedup.components(spark.createDataFrame(pairs, "id long, keeper long"))
    sizes = {r.root: r["count"] for r in got.groupBy("root").count().collect()}
    assert sizes == {60: 42, 102: 3}


def _shingles(text):
    w = text.split()
    return frozenset(" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1)))


def _links(texts, threshold):
    """All links of the contract, by comparing every pair."""
    classes = {}
    for i, t in enumerate(texts):
        classes.setdefault(_shingles(t), []).append(i)
    out = {(i, max(ids)) for ids in classes.values() for i in ids if i != max(ids)}
    reps = [(max(ids), s) for s, ids in classes.items()]
    return out | {(a, b) for a, x in reps for b, y in reps if a < b and 1000 * len(x & y) > round(1000 * threshold) * len(x | y)}


@pytest.mark.parametrize("threshold,piece", [(0.85, 4096), (0.85, 3), (0.5, 7), (0.2, 2)])
def test_near_duplicates_lose_no_link(spark, threshold, piece):
    rnd = random.Random(piece)
    texts = ["", " ", "a", "a b", "A b", "a b c", "a b c d", "a b c a b c a b c", "x " * 500]
    common = " ".join(f"c{k}" for k in range(40))
    for b in range(12):
        words = [f"{rnd.choice('pqrs')}{rnd.randrange(40)}" for _ in range(rnd.randint(30, 90))]
        texts.append(" ".join(words))
        # A chain: each text is like the one before, the ends need not be alike.
        for step in range(8):
            at = rnd.randrange(len(words))
            words = words[:at] + [f"new{b}-{step}"] + words[at + 1:]
            texts.append(" ".join(words))
        texts += [texts[-1], "  " + texts[-1], f"{common} t{b}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(5)
    found = dedup.near_duplicate_links(df, "t", "id", threshold, piece=piece).collect()
    assert len(found) == len({(r.id, r.other) for r in found})
    assert {(r.id, r.other) for r in found} == _links(texts, threshold)


def test_near_duplicates_write_no_row_for_each_shingle(spark, monkeypatch):
    rnd, rows, keep = random.Random(1), [], dedup.stage_table
    monkeypatch.setattr(dedup, "stage_table", lambda df, name: rows.append(keep(df, name)) or rows[-1])
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(300)) for _ in range(20)]
    near = texts[0].rsplit(" ", 1)[0] + " other"
    df = spark.createDataFrame(list(enumerate([*texts, near, near])), "id long, t string")
    assert sorted(tuple(r) for r in dedup.near_duplicate_links(df, "t", "id").collect()) == [(0, 21), (20, 21)]
    assert max(r.count() for r in rows) < 300


def test_shingles_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(dedup, "FLUSH", 50)
    monkeypatch.setattr(dedup, "SHARD", 20)
    sets = [(k, list(range(40)) + [1000 * k + j for j in range(4)]) for k in range(-9, 9)] + [(99, [5])]
    sets = [(k, [h * 0x9E3779B97F4A7C15 % 2**64 - 2**63 for h in s]) for k, s in sets]
    got = dedup._by_rarity(spark.createDataFrame(sets, "k long, sh array<long>").repartition(3), 850).collect()
    assert {(r.k, r.n, frozenset(r.r)) for r in got} == {(k, len(s), frozenset(s[:40])) for k, s in sets}
    assert dedup._by_rarity(spark.createDataFrame(sets, "k long, sh array<long>"), 950).count() == 1


def test_similar_sets_without_candidates(spark):
    empty = spark.createDataFrame([], "id long, t string")
    assert dedup.near_duplicate_links(empty, "t", "id").collect() == []
    one = spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j")], "id long, t string")
    assert dedup.near_duplicate_links(one, "t", "id").collect() == []


def test_nearest_manifest(spark):
    files = spark.createDataFrame([(1, "/r/a/b/c/f.rs"), (2, "/r/a/f.rs"), (3, "/r/x/y/f.rs"), (4, "/r/f.rs")], "file_id long, path string")
    manifests = spark.createDataFrame([("/r/a",), ("/r/a/b",), ("/r",)], "dir string")
    got = {r.file_id: r.manifest for r in nearest_manifest(files, manifests, "/r").collect()}
    assert got == {1: "/r/a/b", 2: "/r/a", 3: "", 4: "/r"}


def test_token_helper(spark):
    row = spark.createDataFrame([("  a\tb c\n",), ("",)], "t string").select(tokens(F.col("t")).alias("v")).collect()
    assert [r.v for r in row] == [["a", "b", "c"], []]


def test_pieces_follow_the_count_of_a_key(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, "warm").otherwise(F.col("id").cast("string")).alias("t"))
    pieces = {r.t: r._pieces for r in hot_keys(rows, ["t"]).collect()}
    assert set(pieces) == {"hot", "warm"} and pieces["hot"] == 86 and pieces["warm"] == 2

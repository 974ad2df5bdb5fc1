"""Candidates of the parity join are pairs with enough keys in common, not all that share some key."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lodestack.llm import parity_join
from lodestack.llm.spans import keyed


def _edges(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blind = np.zeros(1 << 14, np.uint8)  # a map that tells nothing, as that of a large corpus
    return parity_join._candidates(keyed(frame, "doc_id", "text"), blind, 16, 3).collect()


def test_chains_of_shared_passages_are_no_candidates(spark):
    rnd = random.Random(5)
    words = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    passages = [words(50) for _ in range(201)]
    texts = [" ".join(passages[i] + words(300) + passages[i + 1]) for i in range(200)]
    base = words(400)
    texts += [" ".join(base), " ".join(base[:200] + ["other"] + base[200:])]
    edges = _edges(spark, texts)
    assert len(edges) < 10
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in parity_join.near_duplicates(frame).collect()}
    assert got == {i: 200 if i == 201 else i for i in range(202)}


@pytest.mark.parametrize("flush", [3_000, 500_000])
def test_similar_sets_stay_connected_in_crowds_and_pairs(spark, monkeypatch, flush):
    """Groups of few and of many texts, in one portion and in several: whatever is similar is connected by candidates."""
    monkeypatch.setattr(parity_join, "FLUSH", flush)
    rnd = random.Random(6)
    texts = []
    for copies, size in ((2, 30), (3, 60), (8, 90), (9, 150), (40, 300), (5, 700)):
        base = [f"{copies}w{rnd.randrange(10**9)}" for _ in range(size)]
        for _ in range(copies):
            own = list(base)
            for _ in range(size // 80 + 1):
                own[rnd.randrange(size)] = f"x{rnd.randrange(10**9)}"
            texts += [" ".join(own)] * rnd.randrange(1, 3)
    rnd.shuffle(texts)
    edges = _edges(spark, texts)
    sets = [s for _, s in parity_join.shingle_sets(pa.array(texts, pa.large_string()))]
    nodes = parity_join.set_keys(np.concatenate(sets), np.array([len(s) for s in sets])).tolist()
    forest = {n: n for n in nodes}

    def find(x):
        while forest[x] != x:
            x = forest[x]
        return x

    for r in edges:
        forest[find(r.a)] = find(r.b)
    plain = [set(s.tolist()) for s in sets]
    similar = [(i, j) for i, j in combinations(range(len(sets)), 2) if 4 * len(plain[i] & plain[j]) >= 3 * len(plain[i] | plain[j])]
    assert len(similar) > 300
    assert all(find(nodes[i]) == find(nodes[j]) for i, j in similar)


def test_cells_are_told_by_distances_of_any_size():
    rng = np.random.default_rng(3)
    for bits, n in ((16, 2000), (28, 500), (35, 3000), (35, 3)):
        keys = rng.integers(0, 2**64, n, dtype=np.uint64)
        keys[: n // 2] = keys[n - n // 2:]
        width = 1 << bits - 4
        cells = np.concatenate([s * width + parity_join._ungapped(line) for s, line in parity_join._gaps(keys, bits, 4)])
        assert np.array_equal(np.sort(cells), np.sort(keys >> np.uint64(64 - bits)).astype(np.int64))


def test_only_texts_of_candidates_are_looked_up(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(60)]
    texts += [t + " end" for t in texts[:5]] + [None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, join = [], parity_join.with_ranges

    def counted(rows, ranges, how):
        asked.append(rows.count())
        return join(rows, ranges, how)

    monkeypatch.setattr(parity_join, "with_ranges", counted)
    got = {r.doc_id: r.component_id for r in parity_join.near_duplicates(frame).collect()}
    assert got == {i: i - 60 if 60 <= i < 65 else i for i in range(67)}
    assert asked == [10]

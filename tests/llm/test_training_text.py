"""Fill-in-the-middle, hard negatives and quality rules against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestack.llm import fill_middle, hard_negatives, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n long, form string, h1 string, row string, kept string, lang_key string"
WORD = r"[^\x20\x09-\x0D]+"


def _texts():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    plain = ["\n".join(line(rnd.randint(4, 14)) for _ in range(rnd.randint(1, 9))) for _ in range(160)]
    twice = line(12)
    odd = [None, "", " \t\r\n", "One", "x<P>y", "a <S> b", "<M>", "<", "<<P", "a" * 50, "é" * 700, "日本語 text 𝒳", "a b\n\na b\n a b\na b", "w " * 9, "w " * 30, f"{twice} {line(30)} {twice}",
           "###" * 40 + " " + line(30), "\n".join([line(9)] * 12), line(40_000), "q" * 30_000 + " " + line(20_000), "!" * 20_000]
    return plain + odd


def _rows():
    rnd = random.Random(9)
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s1", "s1", "é", None]), 1, "x", "x", "x", "x", "x") for i, t in enumerate(_texts())]
    return rows + [rows[3], rows[3], (None, "null id <S", "en", "s1", 1, "x", "x", "x", "x", "x"), (None,) * 10, (-5, "below <zero", "en", "", 1, "x", "x", "x", "x", "x"), rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(4).cache()


def _key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# --- 11 fill in the middle -------------------------------------------------------------------------------------------


def _filled(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, form, len(p), len(m), out, sha(out), sha(text)


def test_fill_middle(spark, docs):
    found = fill_middle.fill_in_middle(docs).collect()
    assert _key(found) == _key(_filled(r[0], r[1]) for r in _rows())
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    texts = {r[0]: r[1] or "" for r in _rows()}
    assert all(fill_middle.restore(r.output, r.form) == texts[r.doc_id] for r in found if r.doc_id is not None)
    assert fill_middle.fill_in_middle(docs.limit(0)).collect() == []


def test_rank_index_is_exact(docs):
    texts = {r[0]: r[1] or "" for r in _rows() if r[0] is not None}
    for r in fill_middle.rank_index(docs, error=5).filter("doc_id is not null").collect():
        offsets = [0]
        for token in re.findall(r"[A-Za-z]+|[^A-Za-z]", texts[r.doc_id]):
            offsets.append(offsets[-1] + len(token))
        residuals = np.frombuffer(r.residuals, np.int8).astype(int)
        assert len(residuals) == len(offsets) and abs(residuals).max() <= 5
        ranks = [s.rank for s in r.segments]
        assert ranks[0] == 0 and ranks == sorted(set(ranks))
        for rank in random.Random(1).sample(range(len(offsets)), min(50, len(offsets))):
            s = r.segments[np.searchsorted(ranks, rank, "right") - 1]
            assert s.offset + int(np.floor(s.slope * (rank - s.rank))) + residuals[rank] == offsets[rank]


def test_segments_are_few_where_boundaries_are_even():
    found = np.arange(0, 30_000, 3)
    assert len(fill_middle.fit(found, np.array([0, len(found)])).start) == -(-len(found) // fill_middle.LONGEST)
    empty = fill_middle.fit(np.zeros(1, np.int64), np.array([0, 1]))
    assert empty.offsets(np.array([0])).tolist() == [0]


# --- 12 hard negatives -----------------------------------------------------------------------------------------------


def _mined(rows, k=5):
    scale = lambda v: [int(np.floor(256 * x)) for x in v]
    fit = [(i, lab, scale(v)) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, lab, v in fit:
        if i % 100 == 0 and (i not in asked or (lab, v) < asked[i]):
            asked[i] = (lab, v)
    out = []
    for a, (lab, q) in asked.items():
        score = sorted((-sum(x * y for x, y in zip(q, v)), i, own) for i, own, v in fit if i != a and len(v) == len(q))
        for p, pid in [(-s, i) for s, i, own in score if own == lab][:k]:
            window = [(-s, i) for s, i, own in score if own != lab and 80 * p <= -100 * s <= 100 * p][:k]
            out += [(a, pid, r + 1, i, p, s) for r, (s, i) in enumerate(window)]
    return out


def _vectors(dim, n, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    rows = []
    for i in range(n):
        c = int(rng.integers(4))
        rows.append((i * 5, int(c if rng.random() < 0.7 else rng.integers(4)), [float(x) for x in centres[c] + spread * rng.normal(size=dim)]))
    return rows


@pytest.mark.parametrize("dim,spread,chunk", [(20, 0.3, 8), (20, 2.0, 4), (3, 0.5, 8), (1, 0.5, 1)])
def test_hard_negatives(spark, monkeypatch, dim, spread, chunk):
    rows = _vectors(dim, 700, dim, spread)
    rows += [(100, 0, None), (None, 1, rows[0][2]), (200_000, None, rows[0][2]), (3, 1, [float("nan")] * dim), (4, 1, [float("inf")] * dim), (6, 1, [None] * dim), (7, 1, [0.0] * dim)]
    rows += [(11, 2, rows[8][2]), (12, 3, rows[8][2]), rows[9], rows[9], (300, 2, rows[1][2]), (400_000, 1, [0.0] * dim), (500_000, 1, []), (13, 1, []), (14, 2, []), (600_000, 0, rows[0][2] + [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    frame = frame.selectExpr("*", "1 as block", "'x' as kind", "2 as part", "3 as v")
    vectors = hard_negatives.vectors(frame)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 500 * dim)
    found = hard_negatives.mine(vectors, vectors.filter("vec_id % 100 = 0"))
    assert _key(found.collect()) == _key(_mined(rows)) and found.columns[:3] == ["anchor_id", "positive_id", "rank"]


def test_hard_negatives_of_few_or_large_or_equal_rows(spark):
    kind = "vec_id long, label int, embedding array<double>"
    run = lambda rows: (lambda v: _key(hard_negatives.mine(v, v.filter("vec_id % 100 = 0")).collect()))(hard_negatives.vectors(spark.createDataFrame(rows, kind)))
    assert run([]) == [] and run([(0, 1, [1.0])]) == [] and run([(0, 1, [1.0]), (1, 1, [1.0])]) == []
    same = [(i, i % 2, [0.5, 0.25]) for i in range(400)]
    assert run(same) == _key(_mined(same))
    large = [(i, i % 3, [float(2**21 + 977 * i), -float(2**20 - i)]) for i in range(120)]
    assert run(large) == _key(_mined(large))
    beyond = [(i, i % 2, [float(2**40 + i)]) for i in range(20)]
    assert {r[1:] for r in run(beyond) if r[1] == 2} == {(2, r, 2 * r - 1, 2**63 - 2, 2**63 - 2) for r in range(1, 6)}
    away = [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-1.0]), (3, 2, [-0.9])]
    assert run(away) == _key(_mined(away)) == []


def test_index_omits_and_prunes():
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(size=(500, 32)))
    q, labels = x[:7] + 3, np.zeros(500, np.int64)
    tile, norms = hard_negatives._Tile(np.arange(500), labels, x), hard_negatives._leading_norms(q)
    scores = (q @ x.T).astype(np.int64)
    for quantile in (0.0, 0.5, 0.9, 0.99, 1.0):
        low = np.quantile(scores, quantile, axis=1).astype(np.int64)
        a, r, s = hard_negatives._reaching(tile, q, norms, labels[:7], low, True)
        want = np.nonzero(scores >= low[:, None])
        assert sorted(zip(a, r, s)) == sorted(zip(*want, scores[want]))


# --- 13 quality rules ------------------------------------------------------------------------------------------------


def _counted(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    hit = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines)


def _leading(v, bits=7):
    return v - v % (1 << max(v.bit_length() - bits - 1, 0))


def _quartiles(values):
    values = sorted(map(_leading, values))
    at = lambda p: values[-(-len(values) * p // 4) - 1]
    return at(1), at(3)


def _judged(rows, least_rows):
    counted = [(r[0], r[2], r[3], *_counted(r[1])) for r in rows]
    measures, groups = {}, defaultdict(list)
    for i, (_, lang, source, n, chars, symbols, dup, again, lines) in enumerate(counted):
        if n >= 20 and 100 * again <= 30 * n:
            measures[i] = (1000 * chars // n, 10**6 * symbols // chars, 10**6 * dup // lines, 10**6 * again // n)
            for g in ((lang, source), (lang,), ()):
                groups[g].append(measures[i])
    out = []
    for i, (doc_id, lang, source, *counts) in enumerate(counted):
        kept = i in measures
        if kept:
            group = next(g for g in ((lang, source), (lang,), ()) if len(groups[g]) >= least_rows or not g)
            for (_, _, least, both), v, values in zip(quality_rules.MEASURES, measures[i], zip(*groups[group])):
                low, high = _quartiles(values)
                spread = 3 * max(high - low, least)
                kept &= v <= high + spread and (not both or v >= low - spread)
        out.append((doc_id, *counts[:5], i not in measures, kept))
    return out


@pytest.mark.parametrize("least_rows", [1, 30, 10_000])
def test_quality_rules(docs, least_rows):
    found = quality_rules.judge(docs, least_rows=least_rows)
    want = _judged(_rows(), least_rows)
    assert _key(found.drop("failed").collect()) == _key(want)
    assert Counter((w[-2], w[-1]) for w in want).keys() == {(True, False), (False, True), (False, False)}
    assert all(bool(r.failed) == (not r.base_failed and not r.kept) for r in found.collect())
    assert quality_rules.judge(docs.limit(0)).collect() == []


def test_sketches_merge_in_any_order_and_err_little(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("abc"), *[int(rnd.expovariate(1e-4)) for _ in quality_rules.MEASURES]) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "g string, " + ", ".join(f"{m} long" for m, *_ in quality_rules.MEASURES))
    merged = quality_rules.merge(quality_rules.sketch(frame, ["g"]), [])
    assert _key(merged.select("measure", "value", "n").collect()) == _key(quality_rules.sketch(frame, []).select("measure", "value", "n").collect())
    for i, r in enumerate(sorted(quality_rules.quartiles(merged, []).collect(), key=lambda r: [m for m, *_ in quality_rules.MEASURES].index(r.measure))):
        values = sorted(x[i + 1] for x in rows)
        for got, exact in ((r.low, values[749]), (r.high, values[2249])):
            assert got <= exact <= got * (1 + 2**-quality_rules.BITS) + 1


def test_thresholds_of_many_groups_without_a_broadcast(docs, monkeypatch):
    monkeypatch.setattr(quality_rules, "small_or_shuffled", lambda df: df)
    assert _key(quality_rules.judge(docs, least_rows=30).drop("failed").collect()) == _key(_judged(_rows(), 30))

"""Every operator against a brute-force version on small tables with nulls, empty and very long texts, ties and repeats."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from lodestack.llm import bwt_dedup, count_min, decontam, kneser_ney, lang_kernel, mil_quality, mixing, parity_join, topk, url_rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Columns that the operators use inside, with values that must not reach a result.
CLASHING = "row long, ranges string, start string, score double, held_out string, component string, anchor string, n string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING


def _word(rnd):
    return "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 4)))


def _texts():
    rnd = random.Random(5)
    base = [" ".join(_word(rnd) for _ in range(n)) for n in (90, 120, 200, 60, 400, 75)]
    passage = " ".join(_word(rnd) for _ in range(70))
    texts = [None, "", " \t\r\n", "One", "one two", "One two", "a b c d", "é" * 500, *base, base[0], base[0], base[1].upper()]
    for text in base:
        words = text.split()
        for k in (1, 3, 9):
            edited = list(words)
            for _ in range(k):
                edited[rnd.randrange(len(edited))] = _word(rnd)
            texts.append(" ".join(edited))
        texts.append(" ".join(words[: len(words) // 2] + passage.split() + words[len(words) // 2:]))
    texts += ["xy " * 900, "xy " * 700, "long " + " ".join(_word(rnd) for _ in range(150_000)), passage]
    return texts


def _rows():
    rnd = random.Random(6)
    rows = []
    for i, text in enumerate(_texts()):
        rows.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "Z", "é", None]), len(text or "")))
    rows += [rows[9], rows[9], (None, rows[10][1], "en", "s1", 0), (None, None, None, None, None), (7_000_000_000, rows[12][1], "de", "Z", 0)]
    return [(*r, 1, "x", "x", 0.5, "x", "x", "x", "x") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# --- 1 language ------------------------------------------------------------------------------------------------------


def test_language_kernel_learns_and_names_what_it_cannot(spark, none):
    rnd = random.Random(1)
    alphabet = {"aa": "abcde", "bb": "fghij", "cc": "éßüöä"}
    text = lambda c: " ".join("".join(rnd.choice(alphabet[c]) for _ in range(rnd.randint(2, 7))) for _ in range(12))
    rows = [(i, text(c), c) for i, c in enumerate(random.Random(2).choices(list(alphabet), k=240))]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !", "bb"), (903, text("cc"), None), (904, "abc " * 60_000, "aa"), (None, text("bb"), "bb"), rows[0]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = lang_kernel.classify(frame).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r for r in found}
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:240]) and all(0 <= r.score <= 1 for r in found)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904, None)] == ["und", "und", "und", "cc", "aa", "bb"]
    assert lang_kernel.classify(none).collect() == []
    unlabelled = lang_kernel.classify(frame.withColumn("lang", frame.lang.substr(9, 1)).filter("lang is null or lang = ''").selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_language_prediction_sees_the_text_only(spark):
    rows = [(i, "abc abd " * 5 if i % 2 else "xyz xyw " * 5, "p" if i % 2 else "q") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = frame.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 5 = 0 then 'p' else lang end lang")
    assert _key(lang_kernel.classify(frame).collect()) == _key(lang_kernel.classify(other).collect())


def test_a_hundred_languages_and_long_texts(spark):
    rnd = random.Random(12)
    rows = []
    for k in range(100):
        letters = [chr(0x4E00 + 7 * k + j) for j in range(7)]
        text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
        rows += [(len(rows) + i, text(9_000 if k % 2 else 60), f"l{k:03}") for i in range(12)]
    found = lang_kernel.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {i: x for i, _, x in rows}
    assert len({r.lang_pred for r in found}) == 100
    assert all(r.lang_pred == lang[r.doc_id] for r in found)


def test_language_scores_equal_the_exact_ridge():
    rnd = random.Random(4)
    text = lambda c: "".join(rnd.choice(c) for _ in range(40))
    texts, langs = zip(*[(text(c), c) for c in ("abcdef", "defghi", "xyzabc") for _ in range(20)])
    new = [text("abcdefghixyz") for _ in range(10)]

    def grams(t):
        return set(lang_kernel.buckets(t).tolist())

    def kernel(a, b):
        return np.array([[len(grams(x) & grams(y)) / np.sqrt(len(grams(x)) * len(grams(y))) for y in b] for x in a])

    # With every text a landmark the features span the kernel, so the ridge has a closed form.
    target = np.eye(3)[[sorted(set(langs)).index(x) for x in langs]]
    exact = kernel(new, texts) @ np.linalg.solve(kernel(texts, texts) + lang_kernel.RIDGE * len(texts) * np.eye(len(texts)), target)
    model = lang_kernel.fit(list(texts), list(langs))
    assert np.abs(model.scores([lang_kernel.buckets(t) for t in new]) - exact).max() < 1e-3


# --- 2 quality -------------------------------------------------------------------------------------------------------


def test_quality_learns_from_bags(spark, none):
    rnd = random.Random(3)
    good = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(200))
    bad = lambda: " ".join(["SPAM!!", "$$$ win"][rnd.randrange(2)] for _ in range(150))
    # A poor passage anywhere makes a text poor.
    rows = [(i, good() if i % 3 else good() + " " + bad(), "x", 0.0) for i in range(240)]
    rows += [(300, None, "x", 0.0), (301, "", "x", 0.0), (302, good() * 60, "x", 0.0), (None, bad(), "x", 0.0), rows[0]]
    labels = [(i, 1 if i % 3 else 0) for i in range(240)] + [(0, 0), (None, 1), (5, None), (999, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, held_out string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    found = mil_quality.score(frame, marks).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 240 and r.held_out]
    assert sum(r.predicted == (1 if r.doc_id % 3 else 0) for r in held) >= 0.95 * len(held) > 20
    assert len(mil_quality.score(none, marks).collect()) == 0
    assert {r.score for r in mil_quality.score(frame, marks.filter("doc_id < 0")).collect()} == {0.5}


def test_quality_learns_from_long_texts_alone(spark):
    rnd = random.Random(5)
    make = lambda words: " ".join(rnd.choice(words) for _ in range(6_000))
    rows = [(i, make(["plain", "words", "of", "text"] if i % 2 else ["$$$", "WIN!!", "NOW"])) for i in range(80)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    found = mil_quality.score(spark.createDataFrame(rows, "doc_id long, text string"), marks).collect()
    assert min(len(t) for _, t in rows) > 20_000 and all(r.predicted == r.doc_id % 2 for r in found)


def test_keep_good_leaves_columns_as_they_were(spark):
    rows = [(i, "plain words of text " * 9 if i % 2 else "$$$ WIN!! " * 9, -7.0, "h", 5, f"v{i}") for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out string, predicted int, `a.b` string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    kept = mil_quality.keep_good(frame, marks)
    assert kept.schema.names == frame.schema.names
    assert _key(kept.collect()) == _key(r for r in rows if r[0] % 2)


def test_attention_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, mil_quality.FEATURES)) for n in (1, 3, 2)]
    model = mil_quality.fit(bags, [0, 1, 1])
    x, first, y = np.concatenate(bags), np.array([0, 1, 4, 6]), np.array([0.0, 1.0, 1.0])

    def loss():
        p = model.forward(x, first)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    model.weights = {k: rng.normal(0, 0.3, v.shape) for k, v in model.weights.items()}
    for name, g in model.gradient(x, first, y).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        w = model.weights[name]
        keep = w[at]
        w[at] = keep + 1e-5
        up = loss()
        w[at] = keep - 1e-5
        down = loss()
        w[at] = keep
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5


# --- 3 near duplicates -----------------------------------------------------------------------------------------------


def _shingles(text):
    words = re.findall(SPACED, (text or "").translate(LOWER))
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1 if words else 0))}


def _components(rows):
    sets = [_shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if sets[i] and r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def test_parity_join_equals_brute_force(spark, docs, none):
    got = parity_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
    assert _key(got.collect()) == _key(_components(_rows()))
    assert parity_join.near_duplicates(none).count() == 0
    kept = parity_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    wordless = [r[0] for r in _rows() if not _shingles(r[1])]
    assert Counter(ids) == Counter([c for c in {c for _, n, c in _components(_rows()) if n}] + wordless)


def test_parity_join_finds_chains_and_large_groups(spark):
    rnd = random.Random(9)
    rows, base = [], [_word(rnd) + str(i) for i in range(120)]
    for i in range(300):  # a walk: each text differs from the one before by one word
        base = list(base)
        base[rnd.randrange(len(base))] = f"w{i}"
        rows.append((i, " ".join(base)))
    boiler = " ".join(f"b{i}" for i in range(60))
    rows += [(1000 + i, boiler + " " + " ".join(f"{i}x{j}" for j in range(70))) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = parity_join.near_duplicates(frame).select("doc_id", "n_shingles", "component_id").collect()
    assert _key(got) == _key(_components(rows))


@pytest.mark.parametrize("block", [2, 5])
def test_clusters_are_compared_block_by_block(spark, docs, monkeypatch, block):
    monkeypatch.setattr(parity_join, "CLUSTER", block)
    got = parity_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
    assert _key(got.collect()) == _key(_components(_rows()))


def test_small_maps_and_heavy_texts_give_the_same_components(spark, docs, monkeypatch):
    monkeypatch.setattr(parity_join, "MAP", 8)
    monkeypatch.setattr(parity_join, "WEIGHT", 300)
    got = parity_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
    assert _key(got.collect()) == _key(_components(_rows()))


def test_part_keys_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(3, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = int(rng.integers(0, max(1, len(a) // 7)))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop // 2).astype(np.uint64)]))
        if 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b)) and len(a) and len(b):
            bands = {level: need for level, need in parity_join._bands(len(a))}
            common = [(level, need, bands[level]) for level, need in parity_join._bands(len(b)) if level in bands]
            keys = lambda s, level, need: set(np.sort(parity_join.part_keys(s, level, need))[:need].tolist())
            assert any(keys(a, level, na) & keys(b, level, nb) for level, nb, na in common)


# --- 4 url rules -----------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [
        None, "", "nourl", "http://", "http://net", "http://net/", "HTTP://A.Net/x?y#z", "http://example.net/en/", "http://www.example.net/en/a/b?c",
        "http://example.net/enx", "http://notexample.net/en/", "http://example.com/de/1", "http://a.b.example.com/de/", "http://example.com/DE/", "http://org/fr/",
        "http://x.org/fr", "http://x.org/fr/#f", "http://xorg/fr/", "http://example.net:80/en/", "http://a-net/", "http://net-a/", "http://.net/", "http://net./", "x://y?q://z",
        "http://EXAMPLE.NET/EN/", "http://a.org?/fr/", "http://net.example/", "http://a..net/q\nr",
    ]
    rows = [(i, u, "x", "x") for i, u in enumerate(urls)] + [(None, "http://q.net/", "x", "x"), (5, "http://net/", "x", "x")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, key string, stack string")
    rules = spark.createDataFrame(url_rules.RULES + [(None, "/", "block"), ("", "/", "block"), ("net", "/", "block"), ("sub.example.net", "/", "block")], "host string, path string, action string")

    def brute(i, url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = raw.translate(LOWER), re.match(r"[^?#]*", rest[len(raw):])[0]
        fit = [(len(h + p), len(h), h + p, a) for h, p, a in url_rules.RULES + [("sub.example.net", "/", "block")] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        return i, host, path, best[2], best[3]

    assert _key(url_rules.judge(pages, rules).collect()) == _key(brute(i, u) for i, u, *_ in rows)
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0)).collect()} == {"allow"}


# --- 5 top k ---------------------------------------------------------------------------------------------------------


def test_top_k(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, [rnd.choice([0.0, 0.5, -0.25, 1e-3]) for _ in range(4)], "x") for i in range(300)]
    rows += [(400, None, "x"), (500, [1.0, None, 0.0, 0.0], "x"), (600, [float("nan")] * 4, "x"), (700, [float("inf"), 0.0, 0.0, 0.0], "x"), (None, [1.0] * 4, "x"), (800, [1.0, 2.0], "x"), (801, [2.0, 2.0], "x"), (900, [], "x"), (150, rows[150][1], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(6)
    monkeypatch.setattr(topk, "FAN", 2)
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q, v in {(i, tuple(v)) for i, v in good if i % 100 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:10]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    asked = frame.filter("vec_id % 100 = 0")
    assert _key(topk.top_k(frame, asked, 10).collect()) == _key(expected)
    monkeypatch.setattr(topk, "PASS", 2)
    assert _key(topk.top_k(frame, asked, 10).collect()) == _key(expected)
    assert topk.top_k(frame, asked.limit(0)).count() == 0 and topk.top_k(frame.limit(0), asked).count() == 0


def test_products_beyond_doubles_are_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20 + 1, 7.0]])
    assert topk._product(a, b)[0, 0] == 2**60 + 2**40 + 21


# --- 6 mixing --------------------------------------------------------------------------------------------------------


def _targets(sizes, weights):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, fixed = sum(sizes.values()), {}
    while True:
        share = left / max(1e-300, sum(w[s] for s in names if s not in fixed))
        over = [s for s in names if s not in fixed and share * w[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return {s: fixed.get(s, share * w[s] if left > 0 else 0.0) for s in names}
        for s in over:
            fixed[s] = 3 * sizes[s]
            left -= fixed[s]


def test_mixing(spark, docs, none):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rnd.randint(0, 60))), rnd.choice(["a"] * 6 + ["b", "B", "c", "é", "😀", None]), i) for i in range(6000)]
    rows += [(9999, "v " * 4000, "tiny", 1), (None, "n n", "b", 1), (None, "n n", "b", 1), (10001, None, "b", 1), (10002, "", "empty", 1), rows[5]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, taken long")
    found = mixing.mix(frame).collect()
    assert len(found) == len(rows) and _key(found) == _key(mixing.mix(frame.repartition(13)).collect())
    size_of = {(i, len((t or "").split())) for i, t, *_ in rows}
    assert all((r.doc_id, r.size) in size_of and (r.taken == 0 if not r.size else r.taken % r.size == 0 and 0 <= r.taken <= 3 * r.size) for r in found)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = _targets(sizes, (1, 2, 3))
    source = {(i, len((t or "").split())): s for i, t, s, _ in rows}
    taken = Counter()
    for r in found:
        s = source[r.doc_id, r.size]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
    for s, target in want.items():
        most = max((len((t or "").split()) for _, t, x, _ in rows if x == s), default=0)
        assert abs(taken[s] - target) <= most / 2 + 1e-6
    assert mixing.mix(none).count() == 0 and mixing.mix(docs).count() == len(_rows())


# --- 7 decontamination -----------------------------------------------------------------------------------------------


def _words(text):
    return re.findall(ALNUM, (text or "").translate(LOWER))


def _contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = _words(text) if item is not None else []
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i:i + k])].add(str(item))
    out = []
    for i, text, *_ in rows:
        w, hit, met = _words(text), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a:a + k]) in windows:
                    hit |= set(range(a, a + k))
                    met |= windows[tuple(w[a:a + k])]
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_equals_brute_force(spark, docs, none, monkeypatch):
    long = _texts()[8].split()
    items = [(1, " ".join(long[3:40])), (2, "one"), (10, "xy XY,xy"), (3, None), (None, "one"), (4, "..."), (5, "nowhere to be found"), (2, "two"), (6, " ".join(long[20:60]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = _key(_contamination(_rows(), items))
    assert _key(decontam.digest(decontam.find_contamination(docs, bench)).collect()) == expected
    monkeypatch.setattr(decontam, "PASS", 2)
    assert _key(decontam.digest(decontam.find_contamination(docs, bench)).collect()) == expected
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(r[0] for r in _contamination(_rows(), items) if not r[5])
    assert not any(r.contaminated for r in decontam.digest(decontam.find_contamination(docs, bench.limit(0))).collect())
    assert decontam.find_contamination(none, bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "c b a"), (3, "a q q q q q q q b c"), (4, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    near = lambda slop: {r.doc_id for r in decontam.find_contamination(docs, items, slop=slop).collect() if r.hits}
    assert near(0) == {2} and near(2) == {1, 2} and near(7) == {1, 2, 3} and near(None) == set()


# --- 8 and 10 repeats ------------------------------------------------------------------------------------------------


def _byte_repeats(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((r[0], len(t), int(gone.sum()), int(np.sum(np.diff(np.r_[0, gone.astype(int)]) == 1)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [7, 100])
def test_suffix_dedup_equals_brute_force(spark, docs, none, length):
    small = docs.filter("text is null or length(text) < 10000")
    rows = [r for r in _rows() if len(r[1] or "") < 10000]
    expected = _key(_byte_repeats(rows, length))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert _key(bwt_dedup.remove_repeats(small, length=length).select(*columns).collect()) == expected
    cut = bwt_dedup.cut_texts(small, length=length)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert bwt_dedup.remove_repeats(none, length=length).count() == 0


def test_crowded_anchors_go_by_hash(spark):
    rnd = random.Random(3)
    passage = "".join(rnd.choice("abc") for _ in range(90))
    rows = [(i, "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 80))) + passage + "".join(rnd.choice("abc") for _ in range(40))) for i in range(40)]
    frame = spark.createDataFrame(rows, "row long, text string")
    for bucket in (1, 500, 10**9):
        found = defaultdict(set)
        for r in bwt_dedup.repeated_ranges(frame, 50, bucket).collect():
            found[r.row] |= set(range(r.start, r.end))
        assert [(i, len(t), len(found[i])) for i, t in rows] == [x[:3] for x in _byte_repeats(rows, 50)]


def test_repeated_windows():
    rnd = random.Random(3)
    for trial in range(120):
        length = rnd.choice([1, 2, 3, 5, 8, 13])
        texts = [bytes(rnd.choice(b"ab\0" if trial % 2 else b"abcdefgh") for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 8))]
        texts.append(texts[0][3:30] + texts[-1][:9])
        seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
        assert [list(x) for x in bwt_dedup.repeated_windows(texts, length)] == [[i for i in range(len(t) - length + 1) if seen[t[i:i + length]] > 1] for t in texts]


def _word_repeats(rows, window):
    words = [re.findall(SPACED, r[1] or "") for r in rows]
    first = {}
    for r, w in zip(rows, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, math.inf), math.inf if r[0] is None else r[0])
    out = []
    for r, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < (math.inf if r[0] is None else r[0]):
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [3, 50])
def test_count_min_equals_brute_force(spark, docs, none, window):
    expected = _key(_word_repeats(_rows(), window))
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert _key(count_min.remove_repeats(docs, window=window).select(*columns).collect()) == expected
    # A full sketch lets everything pass, and loses nothing.
    assert _key(count_min.remove_repeats(docs, window=window, bits=16).select(*columns).collect()) == expected
    assert count_min.remove_repeats(none).count() == 0


# --- 9 language model ------------------------------------------------------------------------------------------------


def test_kneser_ney(spark, docs, none):
    rows = _rows()
    tokens = [re.findall(SPACED, (r[1] or "").translate(LOWER)) + [None] for r in rows]
    held = [crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in rows]
    unigram, pair = Counter(), Counter()
    for t, h in zip(tokens, held):
        if not h:
            unigram.update(t)
            pair.update(zip([0, *t], t))
    n, v = sum(unigram.values()), len(unigram)
    before, total, follow = Counter(w for _, w in pair), Counter(), defaultdict(Counter)
    for (u, w), c in pair.items():
        total[u] += c
        follow[u][min(c, 3)] += 1
    d = [kneser_ney._discounts(np.array([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])) for c in (pair, before)]

    def low(w):
        spread = sum(d[1][min(x, 3)] for x in before.values())
        return (max(before[w] - d[1][min(before[w], 3)], 0) + spread / (v + 1)) / len(pair)

    def p(u, w):
        if not total[u]:
            return low(w)
        c, f = pair[u, w], follow[u]
        return ((c - d[0][min(c, 3)] if c > 1 else 0) + (f[1] + d[0][2] * f[2] + d[0][3] * f[3]) * low(w)) / total[u]

    some = [0, *list(unigram)[:3]]
    assert all(abs(sum(p(u, w) for w in unigram) + low("never seen") - 1) < 1 for u in some)
    model = {w: low(w) for w in unigram}
    assert abs(sum(model.values()) + low("never seen") - 1) < 1e-9
    expected = []
    for r, t, h in zip(rows, tokens, held):
        base = sum(math.log10((unigram[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        expected.append((r[0], h, len(t), sum(unigram[w] > 0 for w in t), n, base, sum(math.log10(p(u, w)) for u, w in zip([0, *t], t))))
    got = _key(kneser_ney.score(docs).drop("perplexity").collect())
    expected = _key(expected)
    near = lambda rows: sorted(((*x[:5], float(f"{x[5]:.7g}"), float(f"{x[6]:.7g}")) for x in rows), key=repr)
    assert near(got) == near(expected)
    assert kneser_ney.score(none).count() == 0
    alone = kneser_ney.score(docs.filter("crc32(cast(doc_id as string)) % 10 = 0 and doc_id is not null")).collect()
    assert alone and {(r.train_tokens, r.n_known, r.base_score, r.score) for r in alone} == {(0, 0, 0.0, 0.0)}


def test_kneser_ney_with_all_pairs(spark):
    """Pairs counted once are part of the model, and their own evidence shows; the sums of every context are 1."""
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 9)))) for i in range(60)]
    tokens = {i: [*t.split(), None] for i, t in rows}
    unigram, pair = Counter(), Counter()
    for i, t in tokens.items():
        if crc32(str(i).encode()) % 10:
            unigram.update(t)
            pair.update(zip([0, *t], t))
    assert 1 in pair.values()
    before, total, follow = Counter(w for _, w in pair), Counter(), defaultdict(Counter)
    for (u, w), c in pair.items():
        total[u] += c
        follow[u][min(c, 3)] += 1
    d = [kneser_ney._discounts(np.array([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])) for c in (pair, before)]
    spread = sum(d[1][min(x, 3)] for x in before.values())
    low = lambda w: (max(before[w] - d[1][min(before[w], 3)], 0) + spread / (len(unigram) + 1)) / len(pair)
    rest = lambda u: sum(d[0][k] * follow[u][k] for k in (1, 2, 3))
    p = lambda u, w: (max(pair[u, w] - d[0][min(pair[u, w], 3)], 0) + rest(u) * low(w)) / total[u] if total[u] else low(w)
    for u in total:
        assert abs(sum(p(u, w) for w in unigram) + p(u, "never seen") - 1) < 1e-9
    found = kneser_ney.score(spark.createDataFrame(rows, "doc_id long, text string"), single=True).collect()
    assert len(found) == len(rows)
    for r in found:
        assert abs(r.score - sum(math.log10(p(u, w)) for u, w in zip([0, *tokens[r.doc_id]], tokens[r.doc_id]))) < 1e-6

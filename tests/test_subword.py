import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.operators import subword


def sequential_merges(counts, n):
    """One merge at a time."""
    state = {w: list(w) for w in counts}
    out = []
    for _ in range(n):
        pairs = Counter()
        for w, c in counts.items():
            for p in zip(state[w], state[w][1:]):
                pairs[p] += c
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out.append(best)
        for w, s in state.items():
            merged, i = [], 0
            while i < len(s):
                if tuple(s[i:i + 2]) == best:
                    merged.append(s[i] + s[i + 1])
                    i += 2
                else:
                    merged.append(s[i])
                    i += 1
            state[w] = merged
    return out


def _sample(seed, letters="abcde", longest=7):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(30)) for _ in range(40)]


@pytest.mark.parametrize("ranked,segments", [(100_000, 100_000), (100_000, 60), (40, 100), (7, 25), (3, 2)])
def test_merging_in_rounds_equals_one_at_a_time(spark, ranked, segments):
    df = spark.createDataFrame([(t,) for t in _sample(ranked + segments)], "t string")
    words = subword.word_counts(df, "t")
    n = 60 if segments > 10 else 12
    want = sequential_merges({r.word: r.freq for r in words.collect()}, n)
    made = subword.learn(words, n, ranked, segments).orderBy("rank").collect()
    assert [(r.left, r.right) for r in made] == want
    assert [r.rank for r in made] == list(range(len(want))) and [r.freq for r in made] == sorted((r.freq for r in made), reverse=True)


@pytest.mark.parametrize("seed,letters,longest,lo,cap", [(1, "ab", 9, 0, 10_000), (2, "ab", 12, 8, 10_000), (3, "abc", 9, 20, 10_000), (4, "a", 12, 0, 500), (5, "aab", 10, 3, 40)])
def test_a_round_stops_where_its_segments_no_longer_tell(seed, letters, longest, lo, cap):
    """Cut a corpus at its rarer pairs again and again: pieces that are made twice must not change the order."""
    counts = Counter(w for t in _sample(seed, letters, longest) for w in t.split())
    want = sequential_merges(counts, cap)
    state, known, got = {w: list(w) for w in counts}, set("".join(counts)), []
    while len(got) < len(want):
        pairs = Counter()
        for w, c in counts.items():
            for p in zip(state[w], state[w][1:]):
                pairs[p] += c
        low = min(lo, max(pairs.values()) - 1)
        below = {p: n for p, n in pairs.items() if n <= low}
        segments, freqs = [], []
        for w, c in counts.items():
            run = state[w][:1]
            for a, b in zip(state[w], state[w][1:]):
                if (a, b) in below:
                    segments, freqs, run = segments + [run], freqs + [c], []
                run = run + [b]
            segments, freqs = segments + [run], freqs + [c]
        made = [m[:2] for m in subword.merge_down(segments, freqs, low, cap, known, below, 0)]
        made = made or [min(pairs, key=lambda p: (-pairs[p], p))]
        got += made
        known |= {a + b for a, b in made}
        ranks = subword._in_order(made)
        state = {w: subword.apply_merges(s, ranks) for w, s in state.items()}
    assert got[: len(want)] == want


def test_apply_merges_follows_the_order():
    rng = random.Random(7)
    for _ in range(300):
        letters = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        pieces, merges = list("abc"), []
        for _ in range(rng.randint(0, 9)):
            merges.append((rng.choice(pieces), rng.choice(pieces)))
            pieces.append("".join(merges[-1]))
        want = letters
        for pair in merges:
            out, i = [], 0
            while i < len(want):
                hit = tuple(want[i:i + 2]) == pair
                out.append("".join(pair) if hit else want[i])
                i += 2 if hit else 1
            want = out
        assert subword.apply_merges(letters, subword._in_order(merges)) == want


def test_encode_decode(spark):
    df = spark.createDataFrame([(1, "low lower lowest low"), (2, ""), (3, "new newest"), (4, None)], "k long, t string")
    model = subword.learn_bpe(df, "t", vocab_size=30)
    ids = {"whole": (F.col("t"), None), "ids": (F.col("t"), 12), "cut": (F.col("t"), 3)}
    rows = subword.with_ids(df, "k", ids, model).collect()
    assert len(rows) == 4
    for r in rows:
        assert len(r.ids) == 12 and r.ids[0] == subword.BOS and r.ids.count(subword.EOS) == 1
        assert len(r.cut) == 3 and r.cut.count(subword.EOS) == 1
        framed = [subword.BOS, *r.whole, subword.EOS]
        assert list(r.cut) == ((framed[:2] + [subword.EOS]) if len(framed) > 3 else (framed + [subword.PAD] * 3)[:3])
        assert list(r.ids) == ((framed[:11] + [subword.EOS]) if len(framed) > 12 else (framed + [subword.PAD] * 12)[:12])
    whole = subword.with_ids(df, "k", {"ids": (F.col("t"), 64)}, model)
    back = {r.k: r.text for r in subword.decode_ids(whole, "k", "ids", model.vocab).collect()}
    assert back == {1: "low lower lowest low", 2: "", 3: "new newest", 4: ""}
    lengths = {r.k: r.n for r in subword.with_lengths(df, "k", {"n": F.col("t")}, model).collect()}
    assert lengths == {r.k: len(r.whole) for r in rows}


def test_each_word_is_segmented_by_brute_force_and_unknown_characters(spark):
    df = spark.createDataFrame(list(enumerate(_sample(11))), "k long, t string")
    model = subword.learn_bpe(df, "t", vocab_size=60)
    other = spark.createDataFrame([(1, "abcab edé " * 50), (2, "cab")], "k long, t string")

    def brute(text):
        out = []
        for word in text.split():
            symbols = list(subword.SPACE_MARK + word)
            for pair in model.merges:
                symbols = subword.apply_merges(symbols, {pair: [0]})
            out += [model.vocab.get(s, subword.UNK) for s in symbols]
        return out

    rows = {r.k: list(r.ids) for r in subword.with_ids(other, "k", {"ids": (F.col("t"), None)}, model).collect()}
    assert rows == {1: brute("abcab edé " * 50), 2: brute("cab")} and subword.UNK in rows[1]


def test_texts_are_encoded_where_they_are(spark, monkeypatch):
    """No word rows for keys of their own; rows that share a key or have none, odd blanks and a small memory as by the word table."""
    import io
    from contextlib import redirect_stdout

    monkeypatch.setattr(subword, "KNOWN", 2)
    rows = [(1, "ab abc abab  c", "x"), (2, None, ""), (3, " \x1cabab\nab ", None), (4, "ab c", "q"), (4, "abc", "ab ab"), (None, "ab", "ab")]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    merges = [("a", "b"), (subword.SPACE_MARK, "ab"), ("ab", "c")]
    model = subword.Model({p: i for i, p in enumerate([*subword.SPECIALS, subword.SPACE_MARK, "a", "b", "c", "ab", subword.SPACE_MARK + "ab", "abc"])}, merges)
    texts = {"i": (F.col("a"), 4), "j": (F.col("b"), None)}
    plain = lambda d: sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in d.collect()), key=repr)
    assert plain(subword.with_ids(df, "k", texts, model)) == plain(subword._joined_ids(df, "k", texts, model, True))
    lengths = {"n": F.col("a"), "m": F.col("b")}
    assert plain(subword.with_lengths(df, "k", lengths, model)) == plain(subword._joined_lengths(df, "k", lengths, model))
    with redirect_stdout(io.StringIO()) as plan:
        subword.with_ids(df.filter("k < 4"), "k", texts, model).explain()
    assert "Generate" not in plan.getvalue() and "Join" not in plan.getvalue()


def test_pairs_are_found_in_all_words_at_once():
    rnd = random.Random(1)
    words = [[rnd.choice(["a", "b", "ab", "c", "é"]) for _ in range(rnd.randint(2, 9))] for _ in range(500)]
    for pairs in (set(), {("x", "a")}, {("a", "b"), ("ab", "c"), ("é", "x")}):
        symbols, first, joint = subword._joints(pa.array([["a", "b"], *words]).slice(1), *subword._pair_columns(pairs))
        assert [symbols[a:b] for a, b in zip(first, first[1:])] == words
        assert [joint[a:b].tolist() for a, b in zip(first, first[1:])] == [[p in pairs for p in zip(w, w[1:])] + [False] for w in words]

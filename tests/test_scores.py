import pytest
from pyspark.sql import functions as F

from lodestack.operators import overlap, scores

HYP1 = "It is a guide to action which ensures that the military always obeys the commands of the party"
HYP2 = "he read the book because he was interested in world history"
REF1 = [
    "It is a guide to action that ensures that the military will forever heed Party commands",
    "It is the guiding principle which guarantees the military forces always being under the command of the Party",
    "It is the practical guide for the army always to heed the directions of the party",
]
REF2 = ["he was interested in world history because he read the book"]


def multi(spark, hyps, refs):
    h = spark.createDataFrame([(i, t.split()) for i, t in enumerate(hyps)], "k long, tok array<string>")
    r = spark.createDataFrame([(i, j, t.split()) for i, ts in enumerate(refs) for j, t in enumerate(ts)], "k long, ref_id long, tok array<string>")
    stats = overlap.multi_reference_stats(h, r, "k")
    return stats.join(overlap.closest_ref_length(h, r, "k").select("k", "ref_len"), "k")


def test_published_sentence_and_corpus_scores(spark):
    one = multi(spark, [HYP1], [REF1])
    assert one.select(scores.sentence_bleu(one).alias("s")).first().s == pytest.approx(0.5045, abs=1e-4)
    two = multi(spark, [HYP1, HYP2], [REF1, REF2])
    assert scores.nltk_bleu(two).first().score == pytest.approx(0.5920, abs=1e-4)


def test_modified_precision(spark):
    stats = multi(spark, ["the the the the the the the"], [["the cat is on the mat", "there is a cat on the mat"]])
    row = stats.first()
    assert row.m1 / row.hyp_len == pytest.approx(2 / 7)
    row = multi(spark, [HYP1], [REF1]).first()
    assert (row.m1 / 18, row.m2 / 17) == (pytest.approx(0.9444, abs=1e-4), pytest.approx(0.5882, abs=1e-4))


@pytest.mark.parametrize("refs,hyp,expected", [([28, 28], 12, 0.2636), ([13, 2], 12, 0.9200), ([13, 11], 12, 1.0), ([11, 8], 7, 0.8668), ([11, 8, 6, 7], 7, 1.0)])
def test_brevity(spark, refs, hyp, expected):
    h = spark.createDataFrame([(0, ["a"] * hyp)], "k long, tok array<string>")
    r = spark.createDataFrame([(0, i, ["a"] * n) for i, n in enumerate(refs)], "k long, ref_id long, tok array<string>")
    row = overlap.closest_ref_length(h, r, "k").select(scores.brevity_closest(F.col("hyp_len"), F.col("ref_len")).alias("b")).first()
    assert row.b == pytest.approx(expected, abs=1e-4)


def test_identical_texts_score_100_and_empty_ones_0(spark):
    same = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "x y", "x y")], "idx long, pred string, gold string")
    assert scores.corpus_bleu(same, "idx").first().bleu == 100.0
    empty = spark.createDataFrame([(1, "", "a b")], "idx long, pred string, gold string")
    assert scores.corpus_bleu(empty, "idx").first().bleu == 0.0


def test_many_references_on_one_id(spark):
    """One id holds most of the references."""
    preds = spark.createDataFrame([(0, "a b c d")], "id long, pred string")
    golds = spark.range(3000).select(F.lit(0).cast("long").alias("id"), F.col("id").alias("ref_id"), F.concat(F.lit("a b x"), F.col("id").cast("string")).alias("gold"))
    row = scores.smooth_bleu_per_id(preds, golds, "id").first()
    assert row.p1 == pytest.approx(0.5) and row.p2 == pytest.approx(1 / 3)


def test_composite_and_perplexity(spark):
    parts = {n: spark.createDataFrame([(v,)], "score double") for n, v in [("a", 1.0), ("b", 0.0)]}
    assert scores.composite(parts).first().score == 0.5
    losses = spark.createDataFrame([(1, 0, 1.0), (1, 0, 3.0), (1, 1, 0.0)], "r long, batch long, loss double")
    assert scores.perplexity(losses, ["r"]).first().ppl == pytest.approx(2.71828)


def test_several_references_by_brute_force(spark):
    import random
    from collections import Counter

    from lodestack.operators.overlap import reference_stats
    from lodestack.operators.scores import reference_scores

    rnd = random.Random(2)
    text = lambda: " ".join(rnd.choice("the cat sat on a mat of if".split()) for _ in range(rnd.randint(0, 14)))
    data = [(i, text(), [text() for _ in range(rnd.randint(1, 3))]) for i in range(60)] + [(60, "a", []), (61, "", ["", "the"])]
    df = spark.createDataFrame(data, "k long, pred string, refs array<string>")
    words = ["the", "if"]
    got = {r.k: r for r in reference_stats(df, "k", "pred", "refs", 4, words).collect()}
    grams = lambda t, n: Counter(zip(*[t.split()[i:] for i in range(n)]))
    assert got.keys() == {k for k, _, _ in data} and got[60].ref_min is None
    for k, pred, refs in data:
        sizes = [len(r.split()) for r in refs]
        if refs:
            n = len(pred.split())
            assert (got[k].hyp_len, got[k].ref_min, got[k].ref_closest) == (n, min(sizes), min(sizes, key=lambda s: (abs(s - n), s)))
        for n in range(1, 5):
            own, others = grams(pred, n), [grams(r, n) for r in refs]
            best = Counter()
            for o in others:
                best |= o
            scale = lambda g: 0.2 if n == 1 and g[0] not in words else 1.0
            assert got[k][f"m{n}"] == sum((own & best).values())
            assert abs(got[k][f"r{n}"] - sum(c * scale(g) for o in others for g, c in (own & o).items())) < 1e-9
            assert abs(got[k][f"d{n}"] - sum(max(1, sum(c * scale(g) for g, c in o.items())) for o in others)) < 1e-9
    same = spark.createDataFrame([(1, "a b c d e", ["x", "a b c d e"])], "k long, pred string, refs array<string>")
    row = reference_scores(reference_stats(same, "k", "pred", "refs")).first()
    assert row.ngram == 1.0 and row.bleu == 100.0 and row.weighted < 1.0


def test_statistics_of_odd_rows_and_without_gram_rows(spark, monkeypatch):
    """Missing and blank texts, keys that repeat or are missing, odd blanks, and portions of a few rows."""
    import io
    from collections import Counter
    from contextlib import redirect_stdout

    monkeypatch.setattr(overlap, "PORTION", 40)
    data = [(1, "a b a the", "a a the c"), (2, None, "x y"), (3, " \u2003 ", None), (4, "a b\u00a0c d e", "\x1ca b c\nd"), (4, "a b", "f a"), (None, "q", "q"), (5, "k " * 30, "k " * 20)]
    df = spark.createDataFrame(data, "k long, pred string, gold string")
    got = {r.k: r for r in overlap.segment_stats(df, "k", "pred", "gold", 4, ["the"]).collect()}
    assert got.keys() == {1, 2, 3, 4, 5, None}
    for k, row in got.items():
        own = [((p or "").split(), (g or "").split()) for i, p, g in data if i == k]
        assert (row.hyp_len, row.ref_len) == (sum(len(p) for p, _ in own), sum(len(g) for _, g in own))
        for n in range(1, 5):
            sides = [sum((Counter(zip(*[x[i][j:] for j in range(n)])) for x in own), Counter()) for i in (0, 1)]
            assert row[f"m{n}"] == sum((sides[0] & sides[1]).values())
        weigh = lambda c: sum(v * (1.0 if w == "the" else 0.2) for w, v in c.items())
        words = [Counter(w for x in own for w in x[i]) for i in (0, 1)]
        assert abs(row.wm - weigh(words[0] & words[1])) < 1e-9 and abs(row.wr - weigh(words[1])) < 1e-9
    alone = df.filter("k in (1, 2, 3, 5)")
    refs = alone.withColumn("refs", F.array("gold", F.upper("gold"), F.lit("a")))
    for stats in (overlap.segment_stats(alone, "k", "pred", "gold"), overlap.reference_stats(refs, "k", "pred", "refs")):
        with redirect_stdout(io.StringIO()) as plan:
            stats.explain()
        assert "Generate" not in plan.getvalue()

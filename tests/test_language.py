from collections import Counter

from lodestack.operators import language


def test_grams_are_counted_in_the_task(spark, monkeypatch):
    """Counts are those of the overlapping grams of every row, across portions, code points and odd rows; no gram row is exploded."""
    monkeypatch.setattr(language, "PORTION", 40)
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 300)))
    texts = ["The cat, the CAT!", "", None, "12 34", "a", "é\U00010400z " * 9, wide, wide + "a", "Ünï 7 x"]
    df = spark.createDataFrame([(i, None if i == 4 else "en", t) for i, t in enumerate(texts)], "k long, lang string, t string").coalesce(1)
    table = language.gram_table(df, "k", "t", "lang")
    assert "Generate" not in table._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in table.collect():
        gram = "".join(chr(r.gram >> s & 0x1FFFFF) for s in (42, 21, 0))
        got.setdefault((r.k, r.lang), Counter())[gram] += r.cnt
    want = {}
    for r in df.select("k", "lang", language.letters(df.t).alias("t")).collect():
        grams = Counter(r.t[i:i + 3] for i in range(len(r.t or "") - 2))
        if grams:
            want[(r.k, r.lang)] = grams
    assert got == want


def test_texts_of_very_many_letters(monkeypatch):
    """An alphabet that does not fit beside the numbers of the texts is halved, not cut."""
    import pyarrow as pa

    monkeypatch.setattr(language, "GRAM", 3)
    many = "".join(chr(i) for i in range(0x4E00, 0x4E00 + 70000) if not 0xD800 <= i < 0xE000)
    texts = [many] + ["ab cd"] * 40000
    own, gram, cnt = language._counted(pa.array(texts))
    assert len(own) == len(many) - 2 + 3 * 40000 and cnt.min() == cnt.max() == 1 and own.max() == 40000

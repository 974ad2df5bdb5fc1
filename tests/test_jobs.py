import pytest
from pyspark.sql import functions as F

from lodestack.operators import structure, subword
from lodestack.plans import jobs
from lodestack.sources.keywords import KEYWORDS

RUST = KEYWORDS["rust"]


@pytest.fixture(scope="module")
def preds(spark):
    rows = [(1, "fn f(a: u32) { let b = a; b }", "fn f(a: u32) { let b = a; b }"), (2, "fn g() { }", "fn g(x: i32) { let y = x; y }")]
    return spark.createDataFrame(rows, "idx long, pred string, gold string")


def test_evaluate_by_task(spark, preds):
    examples = preds.select("idx", F.lit("src").alias("source"))
    full = jobs.evaluate(preds, examples, RUST).first()
    assert full.em == 50.0 and 0 < full.bleu < 100 and 0 < full.code_score < 100
    text = jobs.evaluate(preds, examples, RUST, "summarize").first()
    assert text.em == 50.0 and 0 < text.bleu < 100 and text.code_score is None
    labels = spark.createDataFrame([("true", 1), ("true", 0)], "pred string, gold int")
    assert jobs.evaluate(labels, examples, RUST, "defect").first().em == 50.0
    same = preds.withColumn("pred", F.col("gold"))
    best = jobs.evaluate(same, examples, RUST, "translate").first()
    assert best.em == 100.0 and best.bleu == 100.0 and best.code_score == pytest.approx(100.0)


def test_missing_example_is_an_error(spark, preds):
    with pytest.raises(Exception, match="no example for"):
        jobs.evaluate(preds, preds.filter("idx = 1").select("idx", F.lit("s").alias("source")), RUST).collect()


def test_edges_of_a_hand_made_sample(spark):
    code = "fn f(a: u32) -> u32 { let mut b = a + 1; let c = g(b, a); b += c; for i in c { b = b + i; } b }"
    df = spark.createDataFrame([(1, code)], "k long, c string")
    got = {(r.name, r.pos): (r.rel, list(r.parents), list(r.parent_pos)) for r in structure.def_use_edges(df, "k", "c", RUST).collect()}
    assert got[("a", 3)] == ("comesFrom", [], [])
    assert got[("b", 13)] == ("comesFrom", ["a"], [15])
    assert got[("c", 20)] == ("comesFrom", ["b", "a"], [24, 26])
    assert got[("b", 29)] == ("computedFrom", ["b", "b", "c"], [13, 29, 32])
    assert got[("i", 35)] == ("computedFrom", ["c"], [37])
    assert got[("b", 46)] == ("comesFrom", ["b"], [39])


def test_features(spark):
    rows = [(1, "let a", "ok", 1, "u", "v", "defect", "none"), (2, "let b", "fine", 0, "u", "v", "summarize", "go")]
    ex = spark.createDataFrame(rows, "idx long, source string, target string, label int, url1 string, url2 string, task string, sub_task string")
    encode = subword.learn_bpe(ex, "source", 40)
    made = jobs.build_features(ex, "generation", encode, 16, 8).collect()
    assert all(len(r.source_ids) == 16 and len(r.target_ids) == 8 for r in made)
    assert all(len(r.target_ids) == 0 for r in jobs.build_features(ex, "generation", encode, 16, 8, stage="test").collect())
    assert all(len(r.source_ids) == 32 for r in jobs.build_features(ex, "clone", encode, 16).collect())
    assert [r.label for r in jobs.build_features(ex, "defect", encode, 16).orderBy("example_id").collect()] == [1, 0]


def test_cleaning_takes_the_doctest_before_the_summary(spark):
    doc = "/// Sum. More.\n/// ```\n/// f(1); // x\n/// ```"
    rows = [(1, "r", "h", "a.rs", doc, "fn f() {} // c"), (2, "r", "h", "b.rs", "", "fn f() {} // c"), (3, "r", "h", "c.rs", "", "// only")]
    df = spark.createDataFrame(rows, "row_id long, repo string, ref string, file string, doc string, code string")
    got = [(r.row_id, r.doc, r.doctest, r.code) for r in jobs.clean_corpus(df).collect()]
    assert got == [(1, "Sum.", "f(1); \n", "fn f() {} ")]


def test_datasets_with_ids(spark):
    """Ids of code, doc and doctest against segmenting every text by hand."""
    rows = [(i, f"fn f{i}() {{ let abc = {i * 7}; }} " * (1 + i % 9), f"Doc number {i} of all. " * (1 + i % 4), f"f{i}(); abc {i}" if i % 3 else "") for i in range(60)]
    df = spark.createDataFrame(rows + [(60, *rows[1][1:])], "row_id long, code string, doc string, doctest string")
    model = subword.learn_bpe(df.selectExpr("concat_ws(' ', code, doc, doctest) t"), "t", 90)
    ranks = subword._in_order(model.merges)

    def framed(text, most):
        ids = [model.vocab[p] for w in text.split() for p in subword.apply_merges(list(subword.SPACE_MARK + w), ranks)]
        full = [subword.BOS, *ids, subword.EOS]
        return (full[:most - 1] + [subword.EOS]) if len(full) > most else full + [subword.PAD] * (most - len(full))

    made = {r.row_id: r for r in jobs.build_pretrain(df, model).collect()}
    assert made.keys() == set(range(60))
    assert all(list(made[i].code_tokens) == framed(code, 64) and list(made[i].doc_tokens) == framed(doc, 32) for i, code, doc, _ in rows)
    tuned = {r.row_id: r for r in jobs.build_finetune(df, model).collect()}
    assert tuned.keys() == {i for i in range(60) if i % 3}
    assert all(list(tuned[i].code_doc_tokens) == framed(c, 256) + framed(d, 32) and list(tuned[i].doctest_tokens) == framed(t, 256) for i, c, d, t in rows if i % 3)
    assert {r.split for r in made.values()} == {"train", "valid", "test"}


def test_code_score_cuts_each_text_once(spark, monkeypatch):
    """Structure and data flow share the tokens of a text, whatever the number of files the pairs come from."""
    cut = []
    real = structure.lexemes
    monkeypatch.setattr(structure, "lexemes", lambda c: cut.append(c) or real(c))
    code = "fn f(a: u32) -> u32 { let s = 3; let t = s + a; t }"
    rows = [(0, code, code), (1, code, "fn f(a: u32) -> u32 { let t = a; t }"), (2, "", "")]
    out = jobs.code_score(spark.createDataFrame(rows, "idx long, gold string, pred string").coalesce(1), "idx", RUST).first()
    assert len(cut) == 2
    assert (round(out.structure, 6), round(out.edges, 6)) == (round(5 / 7, 6), 0.75)

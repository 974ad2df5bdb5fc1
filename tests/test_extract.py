from pathlib import Path

from lodestack import session
from lodestack.operators import extract
from lodestack.operators.extract import extract_functions
from lodestack.plans import code_queries

HOSTILE = '''trait T { fn sig(&self); /// d1
    fn deflt(&self) -> [u8; 4] { [0;4] } }
fn a<'x>(c: &'x str) -> fn(u32) -> u32 { let q = '}'; let z = "fn b() {"; /* fn c() { */ fn inner() { } g }
// too far

// yes 1
/// yes 2
#[inline]
#[cfg(feature = "x[")]
pub(crate) async unsafe fn docd() { é }
#[same] fn same() {}
'''


def test_hostile_sample(spark):
    content = HOSTILE.encode() + b"fn bad() { \xff }\nfn good() {}\n"
    files = spark.createDataFrame([(1, "r", "h", "p.rs", bytearray(content))], "file_id long, repo string, ref string, file string, content binary")
    got = {(r.doc, r.code) for r in extract_functions(files).collect()}
    outer = HOSTILE.split("\n")[2]
    assert got == {
        ("/// d1", "fn deflt(&self) -> [u8; 4] { [0;4] }"),
        ("", outer),
        ("", "fn inner() { }"),
        ("// yes 1\n/// yes 2", '#[inline]\n#[cfg(feature = "x[")]\npub(crate) async unsafe fn docd() { é }'),
        ("", "fn same() {}"),
        ("", "fn good() {}"),
    }


def test_source_tree_has_bounded_files(spark, tmp_path):
    """More rows of a repository are more files, not longer ones: a file is one row of the job."""
    n = 3 * code_queries.FILE_ROWS
    part = spark.range(n).selectExpr("100 * id + 1 as p_partkey", "'n' as p_name", "'b' as p_brand", "'t' as p_type", "1 as p_size").coalesce(1)
    part.write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("select 1L as c_custkey, 1 as c_nationkey, 5000D as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    assert [tuple(r) for r in code_queries.QUERIES["s20_extract_corpus"](spark, str(tmp_path)).collect()] == [("o1/r1", n, n + 2 * (n // 3))]
    tree = next(p for p in reversed(session._PATHS) if "/tree-" in p).split(":", 1)[-1]
    assert sorted(f.read_text().count("#[inline]") for f in Path(tree).rglob("*.txt")) == [code_queries.FILE_ROWS] * 3


def test_functions_of_a_file_share_one_row_of_its_content(spark):
    """A long file is not repeated for each of its functions."""
    text = "".join(f"/// d{i}\nfn f{i}() {{ {i} }}\n\n" for i in range(300))
    files = spark.createDataFrame([(1, "r", "h", "p.rs", bytearray(text.encode()))], "file_id long, repo string, ref string, file string, content binary")
    found = extract_functions(files)
    assert {(r.doc, r.code) for r in found.collect()} == {(f"/// d{i}", f"fn f{i}() {{ {i} }}") for i in range(300)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join Inner")


def test_partitions_follow_the_text(spark, monkeypatch):
    """Lexemes take many times the memory of their text, so the bytes of text set the number of partitions."""
    monkeypatch.setattr(extract, "PORTION", 100)
    rows = [(i, "r", "h", f"{i}.rs", bytearray(b"fn f() { 1 } // " + b"x" * 84)) for i in range(50)]
    files = spark.createDataFrame(rows, "file_id long, repo string, ref string, file string, content binary")
    found = extract.extract_functions(files)
    assert found.count() == 50
    assert found.rdd.getNumPartitions() == 50

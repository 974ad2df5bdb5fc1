import json

from pyspark.sql import functions as F

from lodestack.operators.filters import eligible_repos
from lodestack.plans import jobs
from lodestack.sources import corpus, tasks, text


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"row {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = text.read_lines(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
        assert rows.filter(F.col("value") != F.concat(F.lit("row "), F.col("line_no").cast("string"))).count() == 0
        assert rows.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_and_limits_over_a_folder(spark, tmp_path, monkeypatch):
    lines = [f"row {i}" for i in range(900)]
    for name, cuts in (("a", (0, 250, 250, 600, 900)), ("b", (0, 10, 899, 900))):
        (tmp_path / name).mkdir()
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            (tmp_path / name / f"part-{k:05}.txt").write_text("".join(f"{x}\n" for x in lines[lo:hi]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for most in (10**6, 2):
            monkeypatch.setattr(text, "SPLITS", most)
            rows = text.read_lines(spark, str(tmp_path / "a")).collect()
            assert sorted((r.line_no, r.value) for r in rows) == list(enumerate(lines))
            for n in (1, 10, 260, 5000):
                assert sorted(r.value for r in text.read_lines(spark, str(tmp_path / "a"), n).collect()) == sorted(lines[:n])
        both = text.read_aligned(spark, str(tmp_path / "a"), str(tmp_path / "b"), 700).collect()
        assert sorted(both) == [(i, x, x) for i, x in enumerate(lines[:700])]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_task_readers(spark, tmp_path):
    (tmp_path / "a").write_text(" x \ny\nz\n")
    (tmp_path / "b").write_text("1\n2 \n")
    got = {(r.idx, r.source, r.target) for r in text.read_aligned(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert got == {(0, "x", "1"), (1, "y", "2")}
    clone = tmp_path / "clone"
    clone.mkdir()
    (clone / "data.jsonl").write_text("\n".join(json.dumps({"idx": k, "func": v}) for k, v in [("1", "a  b"), ("2", "c"), ("1", "last\none")]))
    (clone / "train.txt").write_text("1\t2\t0\n1\t9\t1\n2\t1\t1\n2\t2\t7\n")
    rows = text.read_pairs(spark, str(clone / "train.txt"), str(clone / "data.jsonl"), 2).orderBy("idx").collect()
    assert [(r.source, r.target, r.label) for r in rows] == [("last one", "c", 0), ("c", "last one", 1)]
    assert tasks.task_files("d", "translate", "cs-java", "dev") == ["d/translate/valid.java-cs.txt.cs", "d/translate/valid.java-cs.txt.java"]
    assert tasks.task_files("d", "concode", "none", "dev") == ["d/concode/dev.json"]


def test_extraction_end_to_end(spark, tmp_path):
    meta = tmp_path / "meta" / "deep"
    meta.mkdir(parents=True)
    repos = [
        {"id": 1, "full_name": "o/kept", "fork": False, "stargazers_count": 12, "created_at": "2020-01-02T03:04:05Z", "topics": ["a"], "mirror_url": None},
        {"id": 2, "full_name": "o/fork", "fork": True, "stargazers_count": 99},
        {"id": 3, "full_name": "o/few", "fork": False, "stargazers_count": 9},
    ]
    (meta / "x.jsonl").write_text("\n".join(map(json.dumps, repos)))
    (meta / "x.txt").write_text("{}")
    assert [r.full_name for r in eligible_repos(corpus.read_repos(spark, str(tmp_path / "meta"))).collect()] == ["o/kept"]
    for name in ("o+kept", "o+few"):
        folder = tmp_path / "tree" / name / "src"
        folder.mkdir(parents=True)
        (folder / "lib.rs").write_text("/// Doc.\nfn a() { 1 }\n")
        (folder / "note.md").write_text("fn b() {}")
    refs = spark.createDataFrame([("o/kept", "abc")], "full_name string, ref string")
    rows = jobs.extract_corpus(spark, str(tmp_path / "meta"), str(tmp_path / "tree"), refs).collect()
    assert [(r.repo, r.ref, r.doc, r.code) for r in rows] == [("o/kept", "abc", "/// Doc.", "fn a() { 1 }")]
    assert rows[0].file.endswith("o+kept/src/lib.rs")


def test_cache_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert corpus.cached(spark, str(tmp_path), ("t", "none", "dev", 10), build).count() == 3
    assert corpus.cached(spark, str(tmp_path), ("t", "none", "test", 10), build).count() == 3
    assert len(calls) == 2


def test_spans_round_trip(spark, tmp_path):
    rows = spark.sql("select timestamp'2020-01-01 00:00:00' as start, timestamp'2020-01-02 12:00:01' as end, cast(null as bigint) as cnt")
    corpus.write_spans(rows, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first().value == "2020-01-01T00:00:00Z 2020-01-02T12:00:01Z None"
    assert corpus.read_spans(spark, str(tmp_path / "s")).first() == rows.first()


def test_a_tab_in_an_indexed_text_stays(spark, tmp_path):
    for name in ("output", "gold", "src"):
        (tmp_path / name).write_text(f"1\t{name}\tmore\n")
    row = text.read_indexed(spark, *(str(tmp_path / n) for n in ("output", "gold", "src"))).first()
    assert (row.idx, row.src, row.output, row.gold) == (1, "src\tmore", "output\tmore", "gold\tmore")


def test_written_predictions_are_compressed_and_read_alike(spark, tmp_path):
    """The Parquet table and all six text tables together take less room than the texts once, and hold every row."""
    said = [" ".join(f"{chr(97 + (i * k) % 26)}on" for k in range(300)) for i in range(200)]
    rows = [(i, f" {x}\n", f"{x} ti\tle\nend ", str(i)) for i, x in enumerate(said)] + [(200, None, "only", "200"), (201, "", "", "201")]
    folder = tmp_path / "predictions"
    text.write_predictions(spark.createDataFrame(rows, "idx long, output string, gold string, src string"), str(folder))
    assert sum(f.stat().st_size for f in folder.rglob("part-*")) < sum(len(x) for x in said)
    got = {tuple(r) for r in text.read_indexed(spark, *(f"{folder}/{n}" for n in ("output", "gold", "src"))).select("idx", "src", "output", "gold").collect()}
    assert got == {(i, str(i), x, f"{x} ti\tle end") for i, x in enumerate(said)} | {(200, "200", None, "only"), (201, "201", "", "")}
    assert sorted(r.value for r in spark.read.text(f"{folder}/output.noidx").collect()) == sorted([*said, "", ""])
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/table").collect()} == set(rows)

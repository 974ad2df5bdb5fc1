"""Queries on source code: extraction, structure, data flow, evaluation of code."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions.text import repo_dir
from lodestack.operators import extract, structure
from lodestack.operators.filters import eligible_repos
from lodestack.operators.lookups import files_for_repos
from lodestack.plans import jobs
from lodestack.plans.derived import ctes, view
from lodestack.plans.score_queries import BLEU_SQL, NGRAM_SQL, RECALL_SQL, code_totals_sql
from lodestack.session import scratch_path
from lodestack.sources.corpus import read_repos, read_sources
from lodestack.sources.keywords import KEYWORDS

QUERIES, SQL = {}, {}
RUST = KEYWORDS["rust"]
# Rows that the source tree of s20 puts into one file, so that files get more and not longer with the table.
FILE_ROWS = 256


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


_FUNCTIONS = (
    ctes("fx_src") + " SELECT repo, file, f_doc AS doc, f_code AS code FROM fx_src UNION ALL "
    "SELECT repo, file, '', g_code FROM fx_src WHERE more UNION ALL SELECT repo, file, '', inner_code FROM fx_src WHERE more"
)


def _files(spark, sf):
    return view(spark, sf, "fx_src").select("file_id", "repo", F.lit("head").alias("ref"), "file", F.col("content").cast("binary").alias("content"))


@query("x01_extract_functions", _FUNCTIONS)
def x01(spark, sf):
    return extract.extract_functions(_files(spark, sf)).select("repo", "file", "doc", "code")


@query("j16_doc_attachment", ctes("fx_src") + " SELECT file, length(f_doc) AS n_doc FROM fx_src")
def j16(spark, sf):
    documented = extract.extract_functions(_files(spark, sf)).filter("doc <> ''")
    return documented.select("file", F.length("doc").cast("long").alias("n_doc"))


@query("w06_contiguous_lines", ctes("fx_src") + " SELECT file_id, CAST(0 AS BIGINT) AS doc_start, length(f_doc) AS doc_end, length(f_doc) + 1 AS code_start FROM fx_src")
def w06(spark, sf):
    rows = view(spark, sf, "fx_src").repartition("file_id")
    found = extract.function_ranges(rows.select("file_id", "content"), "file_id", "content").filter("doc_start is not null")
    return found.select("file_id", "doc_start", "doc_end", "code_start")


@query("w07_bracket_depth", ctes("fx_src") + " SELECT file_id, CAST(CASE WHEN more THEN 2 ELSE 1 END AS BIGINT) AS deepest, CAST(0 AS BIGINT) AS final FROM fx_src")
def w07(spark, sf):
    rows = extract.located_lexemes(view(spark, sf, "fx_src").repartition("file_id"), "file_id", "content")
    return rows.groupBy("file_id").agg(F.max("depth").alias("deepest"), F.max_by("depth", "pos").alias("final"))


@query(
    "s20_extract_corpus",
    ctes("fx_src", "fx_repos") + " SELECT repo, count(*) AS files, CAST(sum(CASE WHEN more THEN 3 ELSE 1 END) AS BIGINT) AS functions FROM fx_src "
    "WHERE repo IN (SELECT full_name FROM fx_repos WHERE stargazers_count >= 10 AND NOT fork) GROUP BY repo",
)
def s20(spark, sf):
    meta, tree = scratch_path(spark, "meta"), scratch_path(spark, "tree")
    repos = view(spark, sf, "fx_repos")
    repos.write.json(f"{meta}/x")
    src = view(spark, sf, "fx_src")
    src.select("content", repo_dir(F.col("repo")).alias("d")).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("d").text(tree)
    eligible = eligible_repos(read_repos(spark, meta, glob="*.json"))
    files = read_sources(spark, tree, "*.txt").withColumn("full_name", F.regexp_replace("repo", "^d(=|%3D)", "")).withColumn("file_id", F.col("file"))
    kept = files_for_repos(files.drop("repo"), eligible, "file_id").withColumnRenamed("full_name", "repo")
    found = extract.extract_functions(kept)
    own = F.when(F.col("code").rlike(r"\A#\[inline\]"), 1).otherwise(0)
    return found.groupBy("repo").agg(F.sum(own).alias("files"), F.count(F.lit(1)).alias("functions"))


# --- structure and flow; expected values follow from how the pairs are made -------------------------------------

# Every text has 3 subtrees: the whole, (a: u32) and { ... }. Renaming changes no shape; the third kind of prediction
# keeps only (a: u32). Brackets go one deep, in files with a nested function two deep.
_SHAPES = "CASE idx % 3 WHEN 2 THEN 1 ELSE 3 END"


@query("x03_structure_nodes", ctes("fx_code") + " SELECT idx, CAST(3 AS BIGINT) AS nodes, CAST(1 AS BIGINT) AS deepest FROM fx_code")
def x03(spark, sf):
    nodes = structure.structure_nodes(view(spark, sf, "fx_code"), "idx", "gold", RUST)
    return nodes.groupBy("idx").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").cast("long").alias("deepest"))


def _nodes(spark, sf):
    pairs = view(spark, sf, "fx_code")
    return [structure.structure_nodes(pairs, "idx", c, RUST) for c in ("gold", "pred")]


@query("j12_subtree_membership", ctes("fx_code") + f" SELECT idx, CAST({_SHAPES} AS BIGINT) AS matched FROM fx_code")
def j12(spark, sf):
    ref, hyp = _nodes(spark, sf)
    hits = ref.join(hyp.select("idx", "shape").distinct(), ["idx", "shape"], "left_semi")
    return hits.groupBy("idx").agg(F.count(F.lit(1)).alias("matched"))


@query("a10_structure_recall", ctes("fx_code") + f" SELECT CAST(sum({_SHAPES}) AS BIGINT) AS matched, CAST(3 * count(*) AS BIGINT) AS total, round(sum({_SHAPES}) / (3.0 * count(*)), 6) AS score FROM fx_code")
def a10(spark, sf):
    ref, hyp = _nodes(spark, sf)
    return structure.structure_recall(ref, hyp, "idx").withColumn("score", F.round("score", 6))


def _edges(spark, sf, column):
    return structure.def_use_edges(view(spark, sf, "fx_code"), "idx", column, RUST)


# Token positions: fn 0, f 1, ( 2, a 3, : 4, u32 5, ) 6, - 7, > 8, u32 9, { 10, let 11, s 12, = 13, number 14, ; 15,
# let 16, t 17, = 18, s 19, + 20, a 21, ; 22, t 23, } 24.
_GOLD_EDGES = [
    ("a", 3, "comesFrom", "", ""), ("s", 12, "comesFrom", "", ""), ("t", 17, "comesFrom", "s,a", "19,21"),
    ("s", 19, "comesFrom", "s", "12"), ("a", 21, "comesFrom", "a", "3"), ("t", 23, "comesFrom", "t", "17"),
]


def _edge_values(rows):
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


@query("j17_def_use_edges", ctes("fx_code") + f", e(name, pos, rel, parents, parent_pos) AS (VALUES {_edge_values(_GOLD_EDGES)}) SELECT idx, name, CAST(pos AS BIGINT) AS pos, rel, parents, parent_pos FROM fx_code, e")
def j17(spark, sf):
    edges = _edges(spark, sf, "gold")
    return edges.select("idx", "name", F.col("pos").cast("long").alias("pos"), "rel", F.array_join("parents", ",").alias("parents"), F.array_join(F.col("parent_pos").cast("array<string>"), ",").alias("parent_pos"))


@query("a25_merge_edges", ctes("fx_code") + " SELECT idx, CAST(6 AS BIGINT) AS positions, CAST(2 AS BIGINT) AS most_parents FROM fx_code")
def a25(spark, sf):
    edges = _edges(spark, sf, "gold")
    return edges.groupBy("idx").agg(F.count(F.lit(1)).alias("positions"), F.max(F.size("parents")).cast("long").alias("most_parents"))


# Order of first mention: a, s, (s, a before) t.
_NORMAL = [("var_0", "comesFrom", ""), ("var_1", "comesFrom", ""), ("var_2", "comesFrom", "var_1,var_0"), ("var_1", "comesFrom", "var_1"), ("var_0", "comesFrom", "var_0"), ("var_2", "comesFrom", "var_2")]


@query("x04_normalize_edges", ctes("fx_code") + f", e(name, rel, parents) AS (VALUES {_edge_values(_NORMAL)}) SELECT idx, name, rel, parents FROM fx_code, e")
def x04(spark, sf):
    edges = structure.normalize_edges(_edges(spark, sf, "gold"), "idx")
    return edges.select("idx", "name", "rel", F.array_join("parents", ",").alias("parents"))


# The third kind, fn f(a) { let t = a; t }: a, t from a, a from a, t from t. Normalised: var_0 [], var_1 [var_0],
# var_0 [var_0], var_1 [var_1]. Of the six gold edges: var_0 [], var_0 [var_0], var_1 [var_1] are found.
_HITS = "CASE idx % 3 WHEN 2 THEN 3 ELSE 6 END"


@query("j13_edge_match", ctes("fx_code") + f" SELECT idx, CAST({_HITS} AS BIGINT) AS matched FROM fx_code")
def j13(spark, sf):
    sides = [structure.normalize_edges(_edges(spark, sf, c), "idx") for c in ("gold", "pred")]
    cols = ["idx", "name", "rel", "parents"]
    ref, hyp = (s.groupBy(*cols).agg(F.count(F.lit(1)).alias(n)) for s, n in zip(sides, ("r", "h")))
    return ref.join(hyp, cols).groupBy("idx").agg(F.sum(F.least("r", "h")).alias("matched"))


@query("a11_edge_recall", ctes("fx_code") + f" SELECT CAST(sum({_HITS}) AS BIGINT) AS matched, CAST(6 * count(*) AS BIGINT) AS total, round(sum({_HITS}) / (6.0 * count(*)), 6) AS score FROM fx_code")
def a11(spark, sf):
    ref, hyp = (structure.normalize_edges(_edges(spark, sf, c), "idx") for c in ("gold", "pred"))
    return structure.edge_recall(ref, hyp, "idx").withColumn("score", F.round("score", 6))


_PARTS = (
    code_totals_sql(RUST) + f", c AS (SELECT {NGRAM_SQL} AS ngram, {RECALL_SQL} AS weighted, {BLEU_SQL} AS bleu FROM t), "
    f"d AS (SELECT sum({_SHAPES}) / (3.0 * count(*)) AS structure, sum({_HITS}) / (6.0 * count(*)) AS edges, "
    "avg(CASE WHEN gold = pred THEN 1 ELSE 0 END) * 100 AS em FROM fx_code) "
)


@query(
    "a12_code_score",
    _PARTS + "SELECT round(ngram, 6) AS ngram, round(weighted, 6) AS weighted, round(structure, 6) AS structure, round(edges, 6) AS edges, "
    "round((ngram + weighted + structure + edges) / 4, 6) AS score FROM c, d",
)
def a12(spark, sf):
    out = jobs.code_score(view(spark, sf, "fx_code"), "idx", RUST)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("x10_evaluate", _PARTS + "SELECT round(em, 6) AS em, bleu, round((ngram + weighted + structure + edges) * 25, 6) AS code_score FROM c, d")
def x10(spark, sf):
    pairs = view(spark, sf, "fx_code")
    examples = pairs.select("idx", F.col("gold").alias("source"))
    out = jobs.evaluate(pairs, examples, RUST)
    return out.select(F.round("em", 6).alias("em"), "bleu", F.round("code_score", 6).alias("code_score"))

"""Views that both the Spark queries and their SQL counterparts read: one SQL text each, over one given table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_N = "chr(10)"
_K = "CAST(p_partkey AS STRING)"
_F_DOC = f"concat('/// ', p_name, '.', {_N}, '/// ```', {_N}, '/// let x = ', CAST(p_size AS STRING), ';', {_N}, '/// ```')"
_F_CODE = (
    f"concat('#[inline]', {_N}, 'pub fn f', {_K}, '(a: u32) -> u32 {{ let s = \"', p_brand, '\"; a + ', CAST(p_size AS STRING), ' }}')"
)
_INNER = f"concat('fn inner', {_K}, '() {{ }}')"
_G_CODE = (
    f"concat('fn g', {_K}, '<''x>(c: &''x str) -> fn(u32) -> u32 {{ let q = ''}}''; let z = \"fn b() {{\"; ', {_INNER}, ' q }}')"
)

# name -> (table, SQL with {t} for the table)
VIEWS = {
    # repository metadata
    "fx_repos": (
        "customer",
        "SELECT c_custkey AS id, concat('o', CAST(c_nationkey AS STRING), '/r', CAST(c_custkey AS STRING)) AS full_name, "
        "CAST(floor(c_acctbal / 100) AS BIGINT) AS stargazers_count, (c_custkey % 7 = 0) AS fork FROM {t}",
    ),
    # source files: one documented function each; every third file also has a decoy comment, a function without body,
    # a function with hostile text and one nested in it
    "fx_src": (
        "part",
        f"SELECT p_partkey AS file_id, concat('o', CAST(p_partkey % 25 AS STRING), '/r', CAST(p_partkey % 100 AS STRING)) AS repo, "
        f"concat('/repos/o', CAST(p_partkey % 25 AS STRING), '+r', CAST(p_partkey % 100 AS STRING), '/src/m', "
        f"CAST(p_partkey % 3 AS STRING), '/f', {_K}, '.rs') AS file, {_F_DOC} AS f_doc, {_F_CODE} AS f_code, "
        f"(p_partkey % 3 = 0) AS more, {_INNER} AS inner_code, {_G_CODE} AS g_code, p_type, "
        f"concat({_F_DOC}, {_N}, {_F_CODE}, ' // ', p_type, {_N}, CASE WHEN p_partkey % 3 = 0 THEN "
        f"concat('/* fn no() {{}} */', {_N}, 'trait T {{ fn sig(&self); }}', {_N}, {_G_CODE}, {_N}) ELSE '' END) AS content FROM {{t}}",
    ),
    # gold / prediction pairs with partial overlap
    "fx_pairs": (
        "documents",
        "SELECT doc_id AS idx, text AS gold, replace(replace(text, ' the ', ' a '), ' de ', ' la ') AS pred FROM {t}",
    ),
    # raw doc comments and texts with fenced blocks, from the documents
    "fx_docs": (
        "documents",
        f"SELECT doc_id AS row_id, text, source AS repo, concat('/// ', replace(text, {_N}, concat({_N}, '/// '))) AS raw_doc, "
        f"concat('Intro.', {_N}, '```', CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'rust' WHEN 2 THEN 'text' ELSE 'rust,ignore' END, "
        f"{_N}, text, {_N}, '```', {_N}, 'mid', {_N}, '```', {_N}, replace(text, ' ', ''), "
        f"CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat({_N}, '```') END) AS fenced FROM {{t}}",
    ),
    # code-doc corpus: the code carries the whole text in a literal
    "fx_corpus": (
        "documents",
        f"SELECT doc_id AS row_id, source AS repo, lang AS ref, concat('f', CAST(doc_id AS STRING), '.rs') AS file, "
        f"concat('/// ', replace(text, {_N}, concat({_N}, '/// ')), {_N}, '/// ```', {_N}, '/// let n = ', CAST(n_chars % 5 AS STRING), '; // t', {_N}, '/// ```') AS doc, "
        f"concat('fn f() {{ /* c */ let s = \"', text, '\"; }} // ', CAST(doc_id % 2 AS STRING)) AS code FROM {{t}}",
    ),
    # time spans
    "fx_spans": ("events", "SELECT event_type AS key, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS cnt FROM {t} GROUP BY 1, 2"),
    # run logs; epochs are numbered across runs, so the order within a run is what counts
    "fx_runs": (
        "events",
        "SELECT user_id AS run_id, event_id AS epoch, value AS ppl, event_type, CAST(event_id * 7919 % 10007 AS DOUBLE) / 100 AS bleu, "
        "CAST(event_id * 7907 % 9973 AS DOUBLE) / 100 AS em FROM {t}",
    ),
    # pair index with missing targets
    "fx_index": (
        "labels",
        "SELECT doc_id AS row_id, CAST(doc_id AS STRING) AS url1, CAST(doc_id * 3 % 1500 AS STRING) AS url2, CAST(quality AS STRING) AS label FROM {t}",
    ),
    # code pairs with known structure and flow: equal, renamed, other expression
    "fx_code": (
        "part",
        f"SELECT p_partkey AS idx, concat('fn f', {_K}, '(a: u32) -> u32 {{ let s = ', CAST(p_size AS STRING), '; let t = s + a; t }}') AS gold, "
        f"CASE p_partkey % 3 WHEN 0 THEN concat('fn f', {_K}, '(a: u32) -> u32 {{ let s = ', CAST(p_size AS STRING), '; let t = s + a; t }}') "
        f"WHEN 1 THEN concat('fn h(b: u32) -> u32 {{ let c = ', CAST(p_size AS STRING), '; let d = c + b; d }}') "
        f"ELSE concat('fn f', {_K}, '(a: u32) -> u32 {{ let t = a; t }}') END AS pred FROM {{t}}",
    ),
}


def sql(name: str) -> str:
    table, text = VIEWS[name]
    return text.replace("{t}", table)


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({sql(n)})" for n in names)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source, _ = VIEWS[name]
    frame = table(spark, sf, source)
    # The texts hold braces, so the table is put in through a view of its own name instead of by formatting.
    alias = f"lodestack_{source}"
    frame.createOrReplaceTempView(alias)
    return spark.sql(sql(name).replace(f"FROM {source}", f"FROM {alias}"))

"""Queries on text columns, filters, sources and sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.functions.lexing import drop_comments, lex, mask_code, strip_c_comments
from lodestack.operators import filters
from lodestack.plans.derived import ctes, sql, table, view
from lodestack.session import scratch_path
from lodestack.sources import corpus, tasks
from lodestack.sources import text as L
from lodestack.sources.keywords import KEYWORDS
from lodestack.streaming import ingest

QUERIES, SQL = {}, {}
NL = "chr(10)"
TOK = "list_filter(regexp_split_to_array({c}, '\\s+'), lambda t: t <> '')"
TRIM = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


def tok(c):
    return TOK.format(c=c)


def trim(c):
    return TRIM.format(c=c)


# --- sources and sinks ------------------------------------------------------------------------------------------


@query("s01_read_repos", ctes("fx_repos") + " SELECT id, full_name, stargazers_count, fork FROM fx_repos")
def s01(spark, sf):
    path = scratch_path(spark, "repos")
    view(spark, sf, "fx_repos").write.json(path)
    return corpus.read_repos(spark, path, glob="*.json").select("id", "full_name", "stargazers_count", "fork")


@query("s02_read_sources", ctes("fx_src") + " SELECT repo, CAST(sum(strlen(content) + 1) AS BIGINT) AS n_bytes FROM fx_src GROUP BY repo")
def s02(spark, sf):
    path = scratch_path(spark, "tree")
    src = view(spark, sf, "fx_src")
    src.select("content", F.concat(F.lit("x="), T.repo_dir(F.col("repo"))).alias("d")).write.partitionBy("d").text(path)
    files = corpus.read_sources(spark, path, "*.txt")
    name = F.regexp_replace("repo", r"^d=x(=|%3D)", "")
    return files.groupBy(name.alias("repo")).agg(F.sum(F.length("content")).alias("n_bytes"))


@query("s03_parquet_scan", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang = 'en' GROUP BY source")
def s03(spark, sf):
    docs = table(spark, sf, "documents").filter(F.col("lang") == "en")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("s04_write_corpus", ctes("fx_corpus") + " SELECT repo, count(*) AS n, CAST(sum(length(code)) AS BIGINT) AS chars FROM fx_corpus GROUP BY repo")
def s04(spark, sf):
    path = scratch_path(spark, "corpus")
    corpus.write_corpus(view(spark, sf, "fx_corpus"), path)
    return spark.read.parquet(path).groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("code")).alias("chars"))


@query("s05_read_aligned", f"SELECT {trim('replace(text, ' + NL + ', chr(32))')} AS source, concat(lang, ':', CAST(doc_id AS VARCHAR)) AS target FROM documents")
def s05(spark, sf):
    a, b = scratch_path(spark, "src"), scratch_path(spark, "trg")
    docs = table(spark, sf, "documents")
    docs.select(T.flatten_newlines(F.col("text"))).write.text(a)
    docs.select(F.concat("lang", F.lit(":"), F.col("doc_id").cast("string"), F.lit(" "))).write.text(b)
    return L.read_aligned(spark, a, b).select("source", "target")


# Four part files that hold the rows in the order of doc_id, read with a limit that ends inside one of them.
_IN_ORDER = "(SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents)"


def _part_files(df):
    return df.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")


@query(
    "o02_limit_over_files",
    f"SELECT 'nl' AS reader, CAST(line AS BIGINT) AS idx, {trim('text')} AS source, source AS target FROM {_IN_ORDER} WHERE line < 130 "
    f"UNION ALL SELECT 'tokens', CAST(line AS BIGINT), array_to_string({tok('text')}, ' '), lang FROM {_IN_ORDER} WHERE line < 70 "
    f"UNION ALL SELECT 'aligned', CAST(line AS BIGINT), CAST(doc_id AS VARCHAR), lang FROM {_IN_ORDER} WHERE line < 150 "
    f"UNION ALL SELECT 'labelled', doc_id, array_to_string({tok('text')}, ' '), CAST(n_chars AS VARCHAR) FROM {_IN_ORDER} WHERE line < 90",
)
def o02b(spark, sf):
    docs = _part_files(table(spark, sf, "documents"))
    nl, tokens_at, src, trg, labelled = (scratch_path(spark, n) for n in ("nl", "tokens", "src", "trg", "labelled"))
    docs.select(F.col("text").alias("nl"), F.col("source").alias("code")).write.json(nl)
    docs.select(F.split("text", " ").alias("code_tokens"), F.array("lang").alias("docstring_tokens")).write.json(tokens_at)
    docs.select(F.col("doc_id").cast("string")).write.text(src)
    docs.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").select("lang").write.text(trg)
    docs.select(F.col("text").alias("func"), F.col("n_chars").alias("target"), F.col("doc_id").alias("idx")).write.json(labelled)
    name = lambda df, r: df.select(F.lit(r).alias("reader"), "idx", "source", "target")
    rows = L.read_labelled(spark, labelled, 90).withColumn("target", F.col("label").cast("string"))
    return (
        name(L.read_nl_code(spark, nl, 130), "nl").unionAll(name(L.read_token_arrays(spark, tokens_at, 70), "tokens"))
        .unionAll(name(L.read_aligned(spark, src, trg, 150), "aligned")).unionAll(name(rows, "labelled"))
    )


@query("s06_read_nl_code", f"SELECT {trim('text')} AS source, source AS target FROM documents")
def s06(spark, sf):
    path = scratch_path(spark, "nl")
    table(spark, sf, "documents").select(F.col("text").alias("nl"), F.concat(F.lit(" "), "source").alias("code")).write.json(path)
    return L.read_nl_code(spark, path).select("source", "target")


@query(
    "s07_read_token_arrays",
    f"SELECT array_to_string({tok('text')}, ' ') AS source, array_to_string({tok('replace(text, ' + NL + ', chr(32) || chr(32))')}, ' ') AS target FROM documents",
)
def s07(spark, sf):
    path = scratch_path(spark, "tokens")
    words = F.split("text", " ")
    spaced = F.split(F.replace("text", F.lit("\n"), F.lit(" \n ")), " ")
    table(spark, sf, "documents").select(words.alias("code_tokens"), spaced.alias("docstring_tokens")).write.json(path)
    return L.read_token_arrays(spark, path).select("source", "target")


_LABELLED = f"SELECT doc_id AS idx, array_to_string({tok('text')}, ' ') AS source, quality AS label FROM documents JOIN labels USING (doc_id)"


def _labelled_rows(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rows.select(F.col("doc_id").alias("idx"), F.col("text").alias("func"), F.col("quality").alias("target"))


@query("s08_read_labelled", _LABELLED)
def s08(spark, sf):
    path = scratch_path(spark, "labelled")
    _labelled_rows(spark, sf).write.json(path)
    return L.read_labelled(spark, path)


@query(
    "s09_read_pairs",
    ctes("fx_index")
    + f", d AS (SELECT CAST(doc_id AS VARCHAR) AS url, array_to_string({tok('text')}, ' ') AS text FROM documents) "
    "SELECT a.text AS source, b.text AS target, CASE WHEN label = '0' THEN 0 ELSE 1 END AS label, url1, url2 "
    "FROM fx_index i JOIN d a ON a.url = i.url1 JOIN d b ON b.url = i.url2",
)
def s09(spark, sf):
    index, data = scratch_path(spark, "index"), scratch_path(spark, "data")
    view(spark, sf, "fx_index").select(F.concat_ws("\t", "url1", "url2", "label")).write.text(index)
    table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("func")).write.json(data)
    return L.read_pairs(spark, index, data).drop("idx")


def _flat(c):
    return trim(f"replace({c}, {NL}, ' ')")


_PREDICTIONS = ctes("fx_pairs") + f" SELECT idx, CAST(idx AS VARCHAR) AS src, {_flat('pred')} AS output, {_flat('gold')} AS gold FROM fx_pairs"


@query("s10_read_indexed", _PREDICTIONS)
def s10(spark, sf):
    paths = {r: scratch_path(spark, r) for r in ("output", "gold", "src")}
    rows = view(spark, sf, "fx_pairs").withColumnRenamed("pred", "output").withColumn("src", F.col("idx").cast("string"))
    for role, path in paths.items():
        rows.select(F.concat_ws("\t", F.col("idx").cast("string"), T.strip(T.flatten_newlines(F.col(role))))).write.text(path)
    return L.read_indexed(spark, paths["output"], paths["gold"], paths["src"])


@query("s11_write_predictions", _PREDICTIONS)
def s11(spark, sf):
    folder = scratch_path(spark, "predictions")
    rows = view(spark, sf, "fx_pairs").select("idx", F.col("pred").alias("output"), "gold", F.col("idx").cast("string").alias("src"))
    L.write_predictions(rows, folder)
    return L.read_indexed(spark, f"{folder}/output", f"{folder}/gold", f"{folder}/src")


_ALL_CODE = f"concat(f_code, CASE WHEN more THEN concat({NL}, g_code, {NL}, inner_code) ELSE '' END)"


@query(
    "s12_text_corpus",
    ctes("fx_src") + f", r AS (SELECT {_ALL_CODE} AS code, f_doc AS doc, concat('// ', p_type, {NL}, f_code) AS doctest FROM fx_src) "
    f"SELECT 'code' AS kind, replace(code, {NL}, ' ') AS value FROM r UNION ALL SELECT 'doc', replace(doc, {NL}, ' ') FROM r "
    f"UNION ALL SELECT 'doctest', replace(doctest, {NL}, ' ') FROM r",
)
def s12(spark, sf):
    path = scratch_path(spark, "lines")
    more = F.when(F.col("more"), F.concat(F.lit("\n"), "g_code", F.lit("\n"), "inner_code")).otherwise(F.lit(""))
    rows = view(spark, sf, "fx_src").select(
        F.concat("f_code", more).alias("code"), F.col("f_doc").alias("doc"), F.concat(F.lit("// "), "p_type", F.lit("\n"), "f_code").alias("doctest")
    )
    L.write_text_corpus(rows, path)
    return spark.read.text(path).select("kind", "value")


@query(
    "s14_spans_file",
    ctes("fx_spans") + " SELECT strftime(day, '%Y-%m-%dT%H:%M:%SZ') AS start_text, CASE WHEN day > DATE '2024-01-10' THEN CAST(cnt AS BIGINT) ELSE -1 END AS cnt FROM fx_spans",
)
def s14(spark, sf):
    path = scratch_path(spark, "spans")
    day = F.col("day").cast("timestamp")
    known = F.when(F.col("day") > F.lit("2024-01-10").cast("date"), F.col("cnt"))
    corpus.write_spans(view(spark, sf, "fx_spans").select(day.alias("start"), day.alias("end"), known.alias("cnt")), path)
    return corpus.read_spans(spark, path).select(F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_text"), F.coalesce("cnt", F.lit(-1)).alias("cnt"))


_JAVA = ", ".join(f"('{w}')" for w in KEYWORDS["java"])


@query(
    "s15_read_keywords",
    f"WITH k(word) AS (VALUES {_JAVA}), w AS (SELECT unnest({tok('text')}) AS word FROM documents) "
    "SELECT word, count(*) AS n FROM w JOIN k USING (word) GROUP BY word",
)
def s15(spark, sf):
    path = scratch_path(spark, "keywords")
    spark.createDataFrame([(w,) for w in KEYWORDS["java"]], "word string").coalesce(1).write.text(path)
    words = table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(L.read_keywords(spark, path)), "word")


@query(
    "s16_task_catalog",
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'data/concode/' || CASE source WHEN 'src1' THEN 'dev' ELSE 'test' END || '.json' "
    "WHEN 1 THEN 'data/summarize/java/' || CASE source WHEN 'src1' THEN 'valid' ELSE 'test' END || '.jsonl' "
    "ELSE 'data/translate/' || CASE source WHEN 'src1' THEN 'valid' ELSE 'test' END || '.java-cs.txt.cs' END AS path FROM documents",
)
def s16(spark, sf):
    k = F.col("doc_id") % 3
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.when(k == 0, "concode").when(k == 1, "summarize").otherwise("translate").alias("task"),
        F.when(k == 0, "none").when(k == 1, "java").otherwise("cs-java").alias("sub_task"),
        F.when(F.col("source") == "src1", "dev").otherwise("test").alias("split"),
        F.lit("source").alias("role"),
    )
    return docs.join(F.broadcast(tasks.task_catalog(spark, "data")), ["task", "sub_task", "split", "role"]).select("doc_id", "path")


@query(
    "s17_read_examples",
    f"SELECT 'defect' AS task, idx, source, '' AS target, label FROM ({_LABELLED}) "
    f"UNION ALL SELECT 'concode', -1, {trim('text')}, source, -1 FROM documents",
)
def s17(spark, sf):
    a, b = scratch_path(spark, "defect"), scratch_path(spark, "concode")
    _labelled_rows(spark, sf).write.json(a)
    table(spark, sf, "documents").select(F.col("text").alias("nl"), F.col("source").alias("code")).write.json(b)
    defect = tasks.read_examples(spark, "defect", [a]).withColumn("task", F.lit("defect"))
    concode = tasks.read_examples(spark, "concode", [b]).withColumn("task", F.lit("concode")).withColumn("idx", F.lit(-1).cast("bigint"))
    both = defect.unionByName(concode)
    return both.select("task", "idx", "source", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("label", F.lit(-1)).alias("label"))


@query("s18_cached", f"SELECT doc_id AS idx, CAST(len({tok('text')}) AS BIGINT) AS n_tokens FROM documents")
def s18(spark, sf):
    folder = scratch_path(spark, "cache")
    build = lambda: table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))
    corpus.cached(spark, folder, ("concode", "none", "dev", -1), build)
    return corpus.cached(spark, folder, ("concode", "none", "dev", -1), build)


@query("s19_ingest_stream", ctes("fx_repos") + " SELECT full_name, stargazers_count FROM fx_repos")
def s19(spark, sf):
    landing, target, state = (scratch_path(spark, n) for n in ("landing", "landed", "state"))
    repos = view(spark, sf, "fx_repos")
    for part in (F.col("id") % 2 == 0, F.col("id") % 2 == 1):
        repos.filter(part).write.mode("append").json(landing)
        ingest.ingest_repos_stream(ingest.landing_stream(spark, landing, glob="*.json"), target, state).awaitTermination()
    landed = spark.read.option("basePath", target).parquet(target)
    return ingest.latest_per_repo(landed).select("full_name", "stargazers_count")


# --- filters ----------------------------------------------------------------------------------------------------


@query("f01_eligible_repos", ctes("fx_repos") + " SELECT id, full_name, stargazers_count FROM fx_repos WHERE stargazers_count >= 10 AND NOT fork")
def f01(spark, sf):
    return filters.eligible_repos(view(spark, sf, "fx_repos")).select("id", "full_name", "stargazers_count")


@query(
    "f02_stale_repos",
    ctes("fx_repos") + " SELECT id, full_name FROM fx_repos WHERE NOT fork AND stargazers_count < 10 AND full_name IN "
    "(SELECT full_name FROM fx_repos JOIN orders ON o_custkey = id)",
)
def f02(spark, sf):
    repos = view(spark, sf, "fx_repos")
    present = repos.join(table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct(), "id")
    return filters.stale_repos(repos, present).select("id", "full_name")


@query("f03_keep_doc", f"SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN substring(text, 1, 2) WHEN doc_id % 5 = 1 THEN text || chr(9) ELSE text END AS doc FROM documents) WHERE length(doc) >= 3 AND NOT contains(doc, chr(9))")
def f03(spark, sf):
    k = F.col("doc_id") % 5
    doc = F.when(k == 0, F.substring("text", 1, 2)).when(k == 1, F.concat("text", F.lit("\t"))).otherwise(F.col("text"))
    return filters.keep_doc(table(spark, sf, "documents").select("doc_id", doc.alias("doc"))).select("doc_id")


@query("f04_has_doctest", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND text <> ''")
def f04(spark, sf):
    test = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("text"))
    return filters.has_doctest(table(spark, sf, "documents").select("doc_id", test.alias("doctest"))).select("doc_id")


@query("f06_non_empty", "SELECT doc_id FROM documents WHERE length(replace(text, 'e', '')) > 0")
def f06(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("e"), F.lit("")).alias("code"))
    return filters.non_empty(rows).select("doc_id")


@query("f07_guard_size", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN 0 ELSE length(text) END AS n FROM documents")
def f07(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(T.guard_size(F.col("text"), 2000)).cast("long").alias("n"))


_MARKERS = " OR ".join(f"contains(t, '{m}')" for m in T.BAD_MARKERS)
_MARKED = "CASE page_id % 4 WHEN 0 THEN replace(html, '<!-- ', '<! -- ') WHEN 1 THEN replace(html, '<p>', '<p > < / p >') ELSE html END"


@query("f08_marker_flag", f"SELECT page_id, ({_MARKERS} OR regexp_matches(t, '<\\w+ |< \\/ \\w+ >')) AS flagged FROM (SELECT page_id, {_MARKED} AS t FROM pages)")
def f08(spark, sf):
    k = F.col("page_id") % 4
    t = F.when(k == 0, F.replace("html", F.lit("<!-- "), F.lit("<! -- "))).when(k == 1, F.replace("html", F.lit("<p>"), F.lit("<p > < / p >"))).otherwise(F.col("html"))
    return table(spark, sf, "pages").select("page_id", T.marker_flag(t).alias("flagged"))


@query(
    "f10_flatten_newlines",
    f"SELECT doc_id, replace(text, {NL}, ' ') AS text FROM documents",
)
def f10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.flatten_newlines(F.col("text")).alias("text"))


# --- text columns -----------------------------------------------------------------------------------------------

_RSTRIP = f"array_to_string(list_transform(string_split({{c}}, {NL}), lambda s: regexp_replace(s, '\\s+$', '')), {NL})"
_SPLITLINES = f"(CASE WHEN suffix({{c}}, {NL}) THEN left({{c}}, length({{c}}) - 1) ELSE {{c}} END)"


def _stripped(c):
    """T1 in SQL for comments made by prefixing every line with '/// '."""
    return _RSTRIP.format(c=c)


@query("t01_strip_markers", ctes("fx_docs") + f" SELECT row_id, {_RSTRIP.format(c='text')} AS doc FROM fx_docs")
def t01(spark, sf):
    return view(spark, sf, "fx_docs").select("row_id", T.strip_markers(F.col("raw_doc")).alias("doc"))


_EXCLUDED = ", ".join(f"'{x}'" for x in T.EXCLUDED_FENCES)
_BLOCKS = (
    ctes("fx_docs") + ", s AS (SELECT row_id, string_split(fenced, '```') AS g FROM fx_docs), "
    f"b AS (SELECT row_id, i, CASE WHEN i < len(g) AND list_has_any(string_split(string_split(g[i], {NL})[1], ','), [{_EXCLUDED}]) THEN NULL "
    f"ELSE substring(g[i], position({NL} IN g[i]) + 1) END AS block "
    f"FROM s, unnest(range(2, len(g) + 1, 2)) u(i) WHERE contains(g[i], {NL})) "
)


@query("t02_longest_block", _BLOCKS + ", m AS (SELECT row_id, arg_max(block, length(block) * 1000 - i) AS block FROM b WHERE block IS NOT NULL GROUP BY row_id) SELECT fx_docs.row_id, coalesce(block, '') AS block FROM fx_docs LEFT JOIN m USING (row_id)")
def t02(spark, sf):
    return view(spark, sf, "fx_docs").select("row_id", T.longest_block(F.col("fenced")).alias("block"))


@query("t02_fenced_blocks", _BLOCKS + "SELECT row_id, block FROM b WHERE block IS NOT NULL")
def t02b(spark, sf):
    return view(spark, sf, "fx_docs").select("row_id", F.explode(T.fenced_blocks(F.col("fenced"))).alias("block"))


@query("f11_fence_exclusion", _BLOCKS + "SELECT row_id FROM b GROUP BY row_id HAVING count(block) < count(*)")
def f11(spark, sf):
    rows = view(spark, sf, "fx_docs").select("row_id", F.floor(F.size(F.split("fenced", "```")) / 2).alias("n"), F.size(T.fenced_blocks(F.col("fenced"))).alias("k"))
    return rows.filter(F.col("k") < F.col("n")).select("row_id")


def _cut(c, mark, keep):
    flat = f"replace(left({c}, position({mark} IN {c}) - 1), {NL}, ' ')"
    return f"CASE WHEN contains({c}, {mark}) THEN {flat} || '{keep}' ELSE {c} END"


def first_sentence_sql(source, key, col):
    steps = [("'.</p>'", "."), (f"('.' || {NL})", "."), (f"({NL} || {NL})", ""), ("'. '", ".")]
    q = f"SELECT {key}, {col} AS d FROM {source}"
    for mark, keep in steps:
        q = f"SELECT {key}, {_cut('d', mark, keep)} AS d FROM ({q})"
    return f"SELECT {key}, regexp_replace(string_split(d, {NL})[1], '^<p>', '') AS doc FROM ({q})"


_HTMLISH = f"(SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<p>' || replace(text, '. ', '.</p>') WHEN 1 THEN replace(text, '. ', {NL} || {NL}) ELSE text END AS t FROM documents)"


@query("t03_first_sentence", first_sentence_sql(_HTMLISH, "doc_id", "t"))
def t03(spark, sf):
    k = F.col("doc_id") % 3
    doc = F.when(k == 0, F.concat(F.lit("<p>"), F.replace("text", F.lit(". "), F.lit(".</p>")))).when(
        k == 1, F.replace("text", F.lit(". "), F.lit("\n\n"))
    ).otherwise(F.col("text"))
    return T.first_sentence(table(spark, sf, "documents").select("doc_id", doc.alias("doc"))).select("doc_id", "doc")


_INTL = "regexp_replace(regexp_replace(regexp_replace({c}, '(\\P{{N}})(\\p{{P}})', '\\1 \\2 ', 'g'), '(\\p{{P}})(\\P{{N}})', ' \\1 \\2', 'g'), '(\\p{{S}})', ' \\1 ', 'g')"


@query("t04_tokenize_intl", f"SELECT page_id, array_to_string({tok(_INTL.format(c='html'))}, ' ') AS tokens FROM pages")
def t04(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.tokenize_intl(F.col("html")).alias("tokens"))


def _literal_sql(c):
    for plain, mark in [("' '", f" {T.SPACE_MARK} "), (NL, T.NEWLINE_MARK), ("chr(9)", T.TAB_MARK)]:
        c = f"replace({c}, {plain}, '{mark}')"
    for plain, mark in T.LITERAL_TOKENS:
        c = f"replace({c}, '{plain}', ' {mark} ')"
    c = f"replace(array_to_string({tok(_INTL.format(c=c))}, ' '), chr(13), '')"
    for plain, mark in T.LITERAL_TOKENS:
        c = f"replace({c}, '{mark}', '{plain}')"
    return c


_LITERAL = "CASE doc_id % 2 WHEN 0 THEN '\"' || text || '\"' ELSE replace(text, '. ', '// a\\nb ') END"


@query(
    "t05_encode_literal",
    "SELECT doc_id, CASE WHEN regexp_matches(left(t, 1), '\\p{L}') THEN replace(t, left(t, 1) || ' ', left(t, 1)) ELSE t END AS code "
    f"FROM (SELECT doc_id, {_literal_sql(_LITERAL)} AS t FROM documents)",
)
def t05(spark, sf):
    quoted = F.concat(F.lit('"'), "text", F.lit('"'))
    literal = F.when(F.col("doc_id") % 2 == 0, quoted).otherwise(F.replace("text", F.lit(". "), F.lit("// a\\nb ")))
    return table(spark, sf, "documents").select("doc_id", T.encode_literal(literal).alias("code"))


@query("t06_normalize_comment")
def t06(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_comment(F.col("html")).alias("comment"))


@query("t07_decode_literal", "SELECT doc_id, text AS decoded FROM documents")
def t07(spark, sf):
    marked = F.replace(F.replace("text", F.lit(" "), F.lit(" ▁ ")), F.lit("\n"), F.lit(" STRNEWLINE "))
    return table(spark, sf, "documents").select("doc_id", T.decode_literal(marked).alias("decoded"))


_BARE = f"concat(f_doc_kept, f_code, ' ', {NL}, CASE WHEN more THEN concat({NL}, 'trait T {{ fn sig(&self); }}', {NL}, g_code, {NL}) ELSE '' END)".replace("{{", "{").replace("}}", "}")
_DROPPED = ctes("fx_src") + f" SELECT file_id, replace({_BARE}, '\"' || chr(0) || '\"', '') AS code FROM (SELECT *, repeat({NL}, 4) AS f_doc_kept FROM fx_src)"


@query("t08_mask_code", ctes("fx_src") + f" SELECT file_id, concat(repeat({NL}, 4), '#[inline]', {NL}, 'pub fn f', CAST(file_id AS VARCHAR), '(a: u32) -> u32 {{ let s = <STR>; a + <NUM> }} ', {NL}, CASE WHEN more THEN concat({NL}, 'trait T {{ fn sig(&self); }}', {NL}, replace(g_code, '\"fn b() {{\"', '<STR>'), {NL}) ELSE '' END) AS code FROM fx_src".replace("{{", "{").replace("}}", "}"))
def t08(spark, sf):
    return view(spark, sf, "fx_src").select("file_id", mask_code(F.col("content"), "mask", "mask").alias("code"))


@query("t09_drop_comments", _DROPPED)
def t09(spark, sf):
    return view(spark, sf, "fx_src").select("file_id", drop_comments(F.col("content")).alias("code"))


@query("t10_lex", ctes("fx_src") + " SELECT file_id, CAST(4 + 1 + 2 + 22 + 1 + CASE WHEN more THEN 1 + 11 + 42 ELSE 0 END AS BIGINT) AS n_tokens, concat('f', CAST(file_id AS VARCHAR)) AS name FROM fx_src")
def t10(spark, sf):
    src = view(spark, sf, "fx_src").select("file_id", lex(F.col("content")).alias("t"))
    return src.select("file_id", F.size("t").cast("long").alias("n_tokens"), F.get("t", F.lit(10)).alias("name"))


@query("t11_strip_c_comments", ctes("fx_src") + f" SELECT file_id, concat(f_code, '  ', CASE WHEN more THEN concat({NL}, 'trait T {{ fn sig(&self); }}', {NL}, g_code) ELSE '' END) AS code FROM fx_src".replace("{{", "{").replace("}}", "}"))
def t11(spark, sf):
    return view(spark, sf, "fx_src").select("file_id", strip_c_comments(F.col("content")).alias("code"))


_WORDS = f"(SELECT DISTINCT unnest({tok('text')}) AS w FROM documents)"
_IDENT = "(w || 'TestKL1x_' || w || '__Y')"


def _words(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct()
    ident = F.concat("w", F.lit("TestKL1x_"), "w", F.lit("__Y"))
    return w.select("w", ident.alias("ident"))


@query(
    "t12_split_camel",
    f"SELECT w, array_to_string(list_filter(string_split(regexp_replace({_IDENT}, '([A-Z][a-z0-9]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda t: t <> ''), '|') AS parts, "
    "regexp_matches(w, '^[\\p{L}\\p{N}]+$') AND regexp_matches(w, '\\p{Lu}') = regexp_matches(w, '\\p{Ll}') AS needs "
    f"FROM {_WORDS}",
)
def t12(spark, sf):
    return _words(spark, sf).select("w", F.array_join(T.split_camel(F.col("ident")), "|").alias("parts"), T.needs_camel_split(F.col("w")).alias("needs"))


@query(
    "t13_split_snake",
    f"SELECT w, array_to_string(list_filter(string_split({_IDENT}, '_'), lambda t: t <> ''), '|') AS parts, contains(trim(w, '_'), '_') AS needs FROM {_WORDS}",
)
def t13(spark, sf):
    return _words(spark, sf).select("w", F.array_join(T.split_snake(F.col("ident")), "|").alias("parts"), T.needs_snake_split(F.col("w")).alias("needs"))


_DOC_TOKEN_SQL = T.DOC_TOKEN.replace("'", "''")


@query("t14_tokenize_doc", f"SELECT page_id, array_to_string(regexp_extract_all(html, '{_DOC_TOKEN_SQL}'), '|') AS tokens FROM pages")
def t14(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(T.tokenize_doc(F.col("html")), "|").alias("tokens"))


def nist_sql(c):
    for old, new in [("<skipped>", ""), ("-' || chr(10) || '", ""), ("' || chr(10) || '", " "), ("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&amp;", "&")]:
        c = f"replace({c}, '{old}', '{new}')"
    c = f"lower(' ' || {c} || ' ')"
    for pattern, new in T.NIST_RULES:
        c = f"regexp_replace({c}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    return tok(c)


@query("n01_normalize_nist", f"SELECT page_id, array_to_string({nist_sql('html')}, ' ') AS tokens FROM pages")
def n01(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(T.normalize_nist(F.col("html")), " ").alias("tokens"))


PUNCT_SQL = "array_to_string(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}_]'), ' ')"


@query("n02_split_punct", f"SELECT doc_id, {PUNCT_SQL.format(c='text')} AS tokens FROM documents")
def n02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.split_punct(F.col("text")).alias("tokens"))


@query("n03_prediction_line", f"SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN lang ELSE source END AS pred FROM documents")
def n03(spark, sf):
    k = F.col("doc_id") % 4
    ident = F.concat(F.lit(" "), F.col("doc_id").cast("string"))
    line = F.when(k == 0, ident).when(k == 1, F.concat_ws("\t", ident, "lang", "source")).otherwise(F.concat_ws("\t", ident, "source"))
    return L.parse_prediction_line(table(spark, sf, "documents").select(line.alias("value"))).select("id", "pred")


_STATEMENTS = "list_filter(list_transform(string_split(p, ';'), lambda s: " + trim("s") + "), lambda s: s <> '')"
_PROGRAM = f"CASE WHEN contains(p, 'fn main') THEN p ELSE array_to_string(list_transform(list_filter(s, lambda x: starts_with(x, '#') OR starts_with(x, 'use')), lambda x: regexp_replace(x, '^[ #]+', '') || ';' || {NL}), '') || 'pub fn main() {{' || {NL} || array_to_string(list_transform(list_filter(s, lambda x: NOT (starts_with(x, '#') OR starts_with(x, 'use'))), lambda x: x || ';' || {NL}), '') || {NL} || '}}' END".replace("{{", "{").replace("}}", "}")
_GENERATED = f"(CASE WHEN doc_id % 5 = 0 THEN 'fn main() {{ }}' ELSE replace(replace(text, '.', ';'), ',', '; use ') || '; # x ' END)".replace("{{", "{").replace("}}", "}")


@query("t15_assemble_program", f"SELECT doc_id, {_PROGRAM} AS program FROM (SELECT doc_id, p, {_STATEMENTS} AS s FROM (SELECT doc_id, {_GENERATED} AS p FROM documents))")
def t15(spark, sf):
    text = F.concat(F.replace(F.replace("text", F.lit("."), F.lit(";")), F.lit(","), F.lit("; use ")), F.lit("; # x "))
    p = F.when(F.col("doc_id") % 5 == 0, F.lit("fn main() { }")).otherwise(text)
    return table(spark, sf, "documents").select("doc_id", T.assemble_program(p).alias("program"))


_TASK = "(CASE doc_id % 4 WHEN 0 THEN 'summarize' WHEN 1 THEN 'translate' WHEN 2 THEN 'concode' ELSE 'defect' END)"
_SUB = "(CASE doc_id % 4 WHEN 0 THEN 'go' WHEN 1 THEN (CASE WHEN doc_id % 8 = 1 THEN 'java-cs' ELSE 'cs-java' END) ELSE 'none' END)"


def task_columns():
    k, h = F.col("doc_id") % 4, F.col("doc_id") % 8
    task = F.when(k == 0, "summarize").when(k == 1, "translate").when(k == 2, "concode").otherwise("defect")
    sub = F.when(k == 0, "go").when(h == 1, "java-cs").when(h == 5, "cs-java").otherwise("none")
    return task, sub


@query(
    "t16_to_model_text",
    f"SELECT doc_id, replace({_TASK} || CASE WHEN {_SUB} <> 'none' THEN ' ' || {_SUB} ELSE '' END || ': ' || replace(text, '. ', ' </s> '), '</s>', '<unk>') AS source FROM documents",
)
def t16(spark, sf):
    task, sub = task_columns()
    text = F.replace("text", F.lit(". "), F.lit(" </s> "))
    return table(spark, sf, "documents").select("doc_id", T.to_model_text(text, task, sub).alias("source"))


@query(
    "t17_lang_tag",
    f"SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '<en> ' WHEN 4 THEN '<en> ' WHEN 1 THEN '<c_sharp> ' WHEN 5 THEN '<java> ' WHEN 2 THEN '<java> ' WHEN 6 THEN '<java> ' ELSE '' END || source AS target FROM documents",
)
def t17(spark, sf):
    task, sub = task_columns()
    return table(spark, sf, "documents").select("doc_id", T.lang_tag(F.col("source"), task, sub).alias("target"))


@query("t18_label_text", "SELECT doc_id, CASE quality WHEN 0 THEN 'false' ELSE 'true' END AS label FROM labels")
def t18(spark, sf):
    return table(spark, sf, "labels").select("doc_id", T.label_text(F.col("quality")).alias("label"))


@query("t19_repo_dir", ctes("fx_repos") + " SELECT id, replace(full_name, '/', '+') AS dir, full_name AS back FROM fx_repos")
def t19(spark, sf):
    d = T.repo_dir(F.col("full_name"))
    return view(spark, sf, "fx_repos").select("id", d.alias("dir"), T.repo_name(d).alias("back"))


# --- user functions ---------------------------------------------------------------------------------------------


@query("p01_scalar_function", "SELECT doc_id, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS n FROM documents")
def p01(spark, sf):
    @F.pandas_udf("bigint")
    def count_e(texts: pd.Series) -> pd.Series:
        return texts.str.count("e")

    return table(spark, sf, "documents").select("doc_id", count_e("text").alias("n"))


@query("p02_chunk_function", "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def p02(spark, sf):
    def chunk(frames):
        for frame in frames:
            sized = frame.assign(chars=frame.text.str.len())
            yield sized.groupby("lang", as_index=False).agg(n=("chars", "size"), chars=("chars", "sum"))

    parts = table(spark, sf, "documents").select("lang", "text").mapInPandas(chunk, "lang string, n bigint, chars bigint")
    return parts.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


@query("p03_table_function", f"SELECT doc_id, unnest(string_split(text, {NL})) AS line FROM documents")
def p03(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))

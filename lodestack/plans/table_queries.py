"""Queries on joins, duplicates, samples and splits, run logs, spans and datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions.text import tokens
from lodestack.operators import dedup, language, lookups, runs, scores, spans, split, subword
from lodestack.operators.skew import lookup_join
from lodestack.plans import jobs
from lodestack.plans.derived import ctes, table, view
from lodestack.plans.text_queries import _SUB, _TASK, NL, _RSTRIP, first_sentence_sql, task_columns, tok
from lodestack.session import scratch_path, stage_table
from lodestack.sources import corpus, tasks
from lodestack.sources import text as L

QUERIES, SQL = {}, {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


# --- joins ------------------------------------------------------------------------------------------------------

_ELIGIBLE = "SELECT full_name FROM fx_repos WHERE stargazers_count >= 10 AND NOT fork"


@query("j01_files_for_repos", ctes("fx_repos", "fx_src") + f" SELECT file_id, repo FROM fx_src WHERE repo IN ({_ELIGIBLE})")
def j01(spark, sf):
    repos = view(spark, sf, "fx_repos").filter("stargazers_count >= 10 and not fork")
    files = view(spark, sf, "fx_src").select("file_id", F.col("repo").alias("full_name"))
    return lookups.files_for_repos(files, repos, "file_id").select("file_id", F.col("full_name").alias("repo"))


@query("j02_attach_source", ctes("fx_pairs") + " SELECT idx, length(pred) AS n_pred, source FROM fx_pairs JOIN documents ON doc_id = idx")
def j02(spark, sf):
    examples = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "source")
    rows = lookups.attach_source(view(spark, sf, "fx_pairs"), examples)
    return rows.select("idx", F.length("pred").cast("long").alias("n_pred"), "source")


@query(
    "j03_join_pairs",
    ctes("fx_index") + ", d AS (SELECT CAST(doc_id % 900 AS VARCHAR) AS url, arg_max(text, doc_id) AS text FROM documents GROUP BY 1) "
    "SELECT row_id, a.text AS source, b.text AS target, CASE WHEN label = '0' THEN 0 ELSE 1 END AS label "
    "FROM fx_index i JOIN d a ON a.url = i.url1 JOIN d b ON b.url = i.url2",
)
def j03(spark, sf):
    data = table(spark, sf, "documents").select((F.col("doc_id") % 900).cast("string").alias("url"), "text", F.col("doc_id").alias("line"))
    return lookups.join_pairs(view(spark, sf, "fx_index"), data, "line", "row_id").select("row_id", "source", "target", "label")


@query(
    "j04_join_gold_pred",
    "WITH p AS (SELECT conv_id, arg_max(text, turn) AS pred FROM conversations WHERE role = 'assistant' GROUP BY conv_id) "
    "SELECT conv_id, turn AS ref_id, text AS gold, pred FROM conversations JOIN p USING (conv_id) WHERE role = 'user'",
)
def j04(spark, sf):
    rows = table(spark, sf, "conversations")
    preds = rows.filter("role = 'assistant'").select("conv_id", F.col("text").alias("pred"), "turn")
    golds = rows.filter("role = 'user'").select("conv_id", F.col("text").alias("gold"), F.col("turn").alias("ref_id"))
    last, known = scores.join_gold_pred(preds, golds, "conv_id", "turn")
    return lookup_join(known, last, ["conv_id"], "ref_id", "inner").select("conv_id", "ref_id", "gold", "pred")


@query("j05_attach_origin", ctes("fx_src") + " SELECT file_id AS row_id, p_retailprice AS pred, file FROM fx_src JOIN part ON p_partkey = file_id")
def j05(spark, sf):
    preds = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_retailprice").alias("pred"))
    origin = view(spark, sf, "fx_src").select(F.col("file_id").alias("row_id"), "file")
    return lookups.attach_origin(preds, origin)


_MANIFESTS = (
    "SELECT DISTINCT CASE WHEN file_id % 4 = 0 THEN regexp_extract(file, '^(.*)/[^/]*/[^/]*$', 1) WHEN file_id % 4 = 1 "
    "THEN regexp_extract(file, '^(.*)/[^/]*$', 1) ELSE '/repos' END AS dir FROM fx_src WHERE file_id % 100 < 40"
)


@query(
    "j06_nearest_manifest",
    ctes("fx_src") + f", m AS ({_MANIFESTS}), c AS (SELECT f.file_id, f.file, dir, length(dir) AS n FROM fx_src f JOIN m "
    "ON starts_with(f.file, dir || '/') AND dir <> '/repos') "
    "SELECT f.file_id, f.file AS path, coalesce(max_by(dir, n), '') AS manifest FROM fx_src f LEFT JOIN c USING (file_id) GROUP BY 1, 2",
)
def j06(spark, sf):
    src = view(spark, sf, "fx_src")
    up = lambda k: F.regexp_replace("file", r"(/[^/]*){%d}\z" % k, "")
    k = F.col("file_id") % 4
    where = F.when(k == 0, up(2)).when(k == 1, up(1)).otherwise(F.lit("/repos"))
    manifests = src.filter(F.col("file_id") % 100 < 40).select(where.alias("dir"))
    return lookups.nearest_manifest(src.select("file_id", F.col("file").alias("path")), manifests, "/repos")


@query(
    "j07_duplicate_links",
    "SELECT d.doc_id AS id, k.keeper FROM documents d JOIN (SELECT text, max(doc_id) AS keeper FROM documents GROUP BY text) k USING (text) WHERE d.doc_id <> k.keeper",
)
def j07(spark, sf):
    return dedup.duplicate_links(table(spark, sf, "documents"), "text", "doc_id")


@query(
    "j07_duplicate_pair_counts",
    "SELECT g.keeper, count(*) AS n_pairs FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id "
    "JOIN (SELECT text, max(doc_id) AS keeper FROM documents GROUP BY text) g ON g.text = a.text GROUP BY g.keeper",
)
def j07b(spark, sf):
    return dedup.duplicate_groups(table(spark, sf, "documents"), "text", "doc_id").select("keeper", "n_pairs")


_SHINGLES = (
    f"WITH w AS (SELECT doc_id, {tok('text')} AS w FROM documents), "
    "s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) <= 3 THEN [array_to_string(w, ' ')] "
    "ELSE list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS s FROM w), "
    "c AS (SELECT s, max(doc_id) AS rep FROM s GROUP BY s), x AS (SELECT rep, len(s) AS n, unnest(s) AS h FROM c), "
    "p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS c FROM x a JOIN x b USING (h) WHERE a.rep < b.rep GROUP BY a.rep, b.rep), "
    "links AS (SELECT doc_id AS id, rep AS other FROM s JOIN c USING (s) WHERE doc_id <> rep UNION ALL SELECT a, b FROM p WHERE 1000 * c > 850 * (n - c))"
)


@query("j08_near_duplicate_links", _SHINGLES + " SELECT id, other FROM links")
def j08(spark, sf):
    return dedup.near_duplicate_links(table(spark, sf, "documents"), "text", "doc_id")


@query(
    "j08_near_duplicate_groups",
    _SHINGLES.replace("WITH", "WITH RECURSIVE", 1) + ", e AS (SELECT id, other FROM links UNION ALL SELECT other, id FROM links), "
    "r AS (SELECT id, id AS root FROM e UNION SELECT e.id, r.root FROM r JOIN e ON e.other = r.id) SELECT id, max(root) AS root FROM r GROUP BY id",
)
def j08b(spark, sf):
    links = stage_table(dedup.near_duplicate_links(table(spark, sf, "documents"), "text", "doc_id"), "links")
    return dedup.components(links, "id", "other")


@query("j09_zip_references", ctes("fx_pairs") + " SELECT idx AS seg_id, length(pred) AS n_hyp, length(gold) AS n_a, length(source) AS n_b FROM fx_pairs JOIN documents ON doc_id = idx")
def j09(spark, sf):
    pairs = view(spark, sf, "fx_pairs").withColumnRenamed("idx", "seg_id")
    second = table(spark, sf, "documents").select(F.col("doc_id").alias("seg_id"), F.col("source").alias("text"))
    zipped = lookups.zip_references(pairs.select("seg_id", F.col("pred").alias("hyp")), [pairs.select("seg_id", F.col("gold").alias("text")), second])
    size = lambda c: F.length(c).cast("long")
    return zipped.select("seg_id", size("hyp").alias("n_hyp"), size(F.col("refs")[0]).alias("n_a"), size(F.col("refs")[1]).alias("n_b"))


_SEEN = "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS cnt FROM events GROUP BY 1, 2"


@query(
    "j14_reconcile",
    f"WITH e AS ({_SEEN}), l AS (SELECT day, event_type, CASE WHEN day_n = 3 THEN cnt - 1 ELSE cnt END AS cnt FROM (SELECT *, CAST(day(day) % 5 AS INTEGER) AS day_n FROM e) WHERE day_n <> 2) "
    "SELECT strftime(e.day, '%Y-%m-%d') AS day, e.event_type, CASE WHEN l.cnt IS NULL THEN 'missing' WHEN l.cnt <> e.cnt THEN 'mismatch' ELSE 'finished' END AS status FROM e LEFT JOIN l USING (day, event_type)",
)
def j14(spark, sf):
    seen = table(spark, sf, "events").groupBy(F.to_date("ts").alias("start"), F.col("event_type").alias("end")).agg(F.count(F.lit(1)).alias("cnt"))
    n = F.day("start") % 5
    landed = seen.filter(n != 2).withColumn("cnt", F.when(n == 3, F.col("cnt") - 1).otherwise(F.col("cnt")))
    out = lookups.reconcile(seen, landed)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), F.col("end").alias("event_type"), "status")


@query(
    "j15_task_limits",
    "SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 256 WHEN 1 THEN 320 WHEN 2 THEN 320 ELSE 512 END AS INTEGER) AS max_source, "
    "CAST(CASE doc_id % 4 WHEN 0 THEN 128 WHEN 1 THEN 256 WHEN 2 THEN 150 ELSE 3 END AS INTEGER) AS max_target FROM documents",
)
def j15(spark, sf):
    task, sub = task_columns()
    docs = table(spark, sf, "documents").select("doc_id", task.alias("task"), sub.alias("sub_task"))
    return lookups.with_task_limits(docs, tasks.task_limits(spark)).select("doc_id", "max_source", "max_target")


# --- duplicates -------------------------------------------------------------------------------------------------


@query("a01_dedup_first", "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def a01(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return dedup.dedup_first(docs, ["text"], "doc_id").select("doc_id", "lang", "source")


@query("a01_dedup_first_two_keys", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) = 1")
def a01b(spark, sf):
    return dedup.dedup_first(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id").select("doc_id")


@query(
    "a02_audit_unique",
    "SELECT 'documents' AS dataset, count(*) AS \"rows\", count(DISTINCT text) AS distinct_rows, count(*) <> count(DISTINCT text) AS has_duplicates FROM documents "
    "UNION ALL SELECT 'parts', count(*), count(DISTINCT p_partkey), count(*) <> count(DISTINCT p_partkey) FROM part",
)
def a02(spark, sf):
    docs = dedup.audit_unique(table(spark, sf, "documents"), ["text"], "documents")
    return docs.unionByName(dedup.audit_unique(table(spark, sf, "part"), ["p_partkey"], "parts"))


@query("a18_unique_ids", "SELECT max(doc_id) AS id FROM documents GROUP BY text")
def a18(spark, sf):
    return dedup.unique_ids(table(spark, sf, "documents"), "text", "doc_id")


@query(
    "a18_components",
    "SELECT doc_id AS id, max(doc_id) OVER (PARTITION BY text) AS root FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1",
)
def a18b(spark, sf):
    return dedup.components(dedup.duplicate_links(table(spark, sf, "documents"), "text", "doc_id"))


# --- aggregates over logs ---------------------------------------------------------------------------------------

_STATS = "count(*) AS n, CAST(floor(avg(len({s}))) AS BIGINT) AS avg_src, CAST(max(len({s})) AS BIGINT) AS max_src, CAST(floor(avg(len({t}))) AS BIGINT) AS avg_trg, CAST(max(len({t})) AS BIGINT) AS max_trg"


@query("a03_length_stats", "SELECT " + _STATS.format(s=tok("text"), t=tok("lang || ' ' || text")) + " FROM documents")
def a03(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("text").alias("source"), F.concat("lang", F.lit(" "), "text").alias("target"))
    return jobs.length_stats(rows)


@query(
    "a13_perplexity",
    "SELECT user_id, round(exp(avg(l)), 5) AS ppl FROM (SELECT user_id, event_id // 64 AS b, avg(value / 100) AS l FROM events GROUP BY 1, 2) GROUP BY user_id",
)
def a13(spark, sf):
    losses = table(spark, sf, "events").select("user_id", F.floor(F.col("event_id") / 64).alias("batch"), (F.col("value") / 100).alias("loss"))
    return scores.perplexity(losses, ["user_id"])


@query("a14_success_rate", "SELECT CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS succ, count(*) AS total, round(avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END), 6) AS rate FROM events")
def a14(spark, sf):
    results = table(spark, sf, "events").select((F.col("event_type") != "error").alias("ok"))
    return scores.success_rate(results).withColumn("rate", F.round("rate", 6))


# --- run logs ---------------------------------------------------------------------------------------------------


def _run_log(spark, sf):
    task = F.when(F.col("run_id") % 3 == 0, "summarize").when(F.col("run_id") % 3 == 1, "defect").otherwise("concode")
    score = runs.selection_score(task, F.col("bleu"), F.col("em"))
    return view(spark, sf, "fx_runs").withColumn("score", score).select("run_id", "epoch", "ppl", "score")


_LOG = ctes("fx_runs") + ", l AS (SELECT run_id, epoch, ppl, CASE run_id % 3 WHEN 0 THEN bleu WHEN 1 THEN em ELSE bleu + em END AS score FROM fx_runs), " \
    "b AS (SELECT *, row_number() OVER w AS rank, coalesce(ppl < least(min(ppl) OVER p, 1e6), ppl < 1e6) AS pi, score > greatest(coalesce(max(score) OVER p, -1), -1) AS si FROM l " \
    "WINDOW w AS (PARTITION BY run_id ORDER BY epoch), p AS (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), " \
    "c AS (SELECT *, rank - coalesce(max(CASE WHEN pi THEN rank END) OVER w, 0) AS ps, rank - coalesce(max(CASE WHEN si THEN rank END) OVER w, 0) AS ss FROM b " \
    "WINDOW w AS (PARTITION BY run_id ORDER BY epoch)), d AS (SELECT *, coalesce(lag(ss) OVER (PARTITION BY run_id ORDER BY epoch), 0) AS s0 FROM c)"


@query("w01_best_so_far", _LOG + " SELECT run_id, epoch, pi AS ppl_improved, si AS score_improved, round(min(ppl) OVER w, 6) AS best_ppl, round(max(score) OVER w, 6) AS best_score FROM b WINDOW w AS (PARTITION BY run_id ORDER BY epoch)")
def w01(spark, sf):
    out = runs.best_so_far(_run_log(spark, sf))
    return out.select("run_id", "epoch", "ppl_improved", "score_improved", F.round("best_ppl", 6).alias("best_ppl"), F.round("best_score", 6).alias("best_score"))


@query("w02_patience", _LOG + " SELECT run_id, epoch, ps AS ppl_stall, ss AS score_stall FROM c")
def w02(spark, sf):
    flagged = runs.best_so_far(_run_log(spark, sf))
    return runs.patience(flagged).select("run_id", "epoch", "ppl_stall", "score_stall")


@query("w03_early_stop", _LOG + " SELECT run_id, min(epoch) AS stop_epoch FROM d WHERE (NOT pi AND s0 > 5 AND ps > 5) OR (NOT si AND ss > 5 AND ps > 5) GROUP BY run_id")
def w03(spark, sf):
    flagged = runs.best_so_far(_run_log(spark, sf))
    return runs.early_stop(runs.patience(flagged))


@query("w04_selection_score", _LOG + " SELECT run_id, epoch, round(score, 6) AS score FROM l")
def w04(spark, sf):
    return _run_log(spark, sf).select("run_id", "epoch", F.round("score", 6).alias("score"))


@query(
    "w05_running_loss",
    ctes("fx_runs") + ", s AS (SELECT run_id, epoch AS step, CAST(sum(CAST(ppl AS DECIMAL(18, 4))) OVER w AS DOUBLE) AS t, row_number() OVER w AS n FROM fx_runs WINDOW w AS (PARTITION BY run_id ORDER BY epoch)) "
    "SELECT run_id, step, round(t * 2 / (n + 1), 4) AS train_loss FROM s WHERE n % 2 = 0",
)
def w05(spark, sf):
    steps = view(spark, sf, "fx_runs").select("run_id", F.col("epoch").alias("step"), F.col("ppl").cast("decimal(18,4)").alias("loss"))
    return runs.running_loss(steps, ["run_id"], accumulate=2).select("run_id", "step", "train_loss")


# --- spans ------------------------------------------------------------------------------------------------------

_HALF = "strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


def _span_bounds(spark, sf):
    bounds = table(spark, sf, "events").agg(F.date_trunc("day", F.min("ts")).alias("first"), F.max("ts").alias("limit"))
    return spans.make_spans(bounds, 6)


_SPANS = (
    "WITH b AS (SELECT date_trunc('day', min(ts)) AS first, max(ts) AS lim FROM events), "
    "s AS (SELECT first + to_days(CAST(7 * i AS INTEGER)) AS start, first + to_days(CAST(7 * i + 6 AS INTEGER)) AS stop FROM b, unnest(range(0, 400)) u(i) WHERE first + to_days(CAST(7 * i AS INTEGER)) < lim)"
)


def _texted(df):
    return df.withColumn("start", spans.span_text(F.col("start"))).withColumn("end", spans.span_text(F.col("end")))


@query("t20_make_spans", _SPANS + " SELECT strftime(start, '%Y-%m-%d') AS start, strftime(stop, '%Y-%m-%d') AS \"end\", strftime(start, '%Y-%m-%dT%H:%M:%SZ') || '-' || strftime(stop, '%Y-%m-%dT%H:%M:%SZ') || '.jsonl' AS file FROM s")
def t20(spark, sf):
    s = _span_bounds(spark, sf)
    a, b = F.col("start"), F.col("end")
    return s.select(spans.query_text(a, b, a).alias("start"), spans.query_text(a, b, b).alias("end"), spans.span_file(a, b).alias("file"))


_COUNTED = "SELECT {g} AS start, {h} AS \"end\", CAST((SELECT count(*) FROM events WHERE date_trunc('second', ts) BETWEEN s.start AND s.stop + to_seconds(86399)) AS BIGINT) AS cnt FROM s"


@query("a15_count_spans", _SPANS + " " + _COUNTED.format(g=_HALF.format(c="start"), h=_HALF.format(c="stop")))
def a15(spark, sf):
    return _texted(spans.count_spans(table(spark, sf, "events"), "ts", _span_bounds(spark, sf)))


@query(
    "a16_pack_spans",
    "WITH RECURSIVE s AS (SELECT event_type AS key, CAST(date_trunc('day', ts) AS DATE) AS day, CAST(count(*) AS BIGINT) AS cnt FROM events GROUP BY 1, 2), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) AS i FROM s), c AS (SELECT 2 * max(cnt) AS cap FROM s), "
    "f AS (SELECT key, i, day, cnt AS acc, 1 AS pack FROM o WHERE i = 1 UNION ALL SELECT o.key, o.i, o.day, CASE WHEN f.acc + o.cnt > cap THEN o.cnt ELSE f.acc + o.cnt END, "
    "f.pack + CASE WHEN f.acc + o.cnt > cap THEN 1 ELSE 0 END FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1, c) "
    "SELECT key, strftime(min(day), '%Y-%m-%dT%H:%M:%SZ') AS start, strftime(max(day), '%Y-%m-%dT%H:%M:%SZ') AS \"end\", max(acc) AS cnt FROM f GROUP BY key, pack",
)
def a16(spark, sf):
    days = view(spark, sf, "fx_spans")
    cap = days.agg((2 * F.max("cnt")).alias("cap")).first().cap
    items = days.select("key", F.col("day").cast("timestamp").alias("start"), F.col("day").cast("timestamp").alias("end"), "cnt")
    return _texted(spans.pack_spans(items, ["key"], cap))


_LAST = "CASE WHEN whole THEN stop + to_seconds(86399) ELSE stop END"
_MID = (
    "CASE WHEN whole AND start = stop THEN start + to_seconds(43200) WHEN whole THEN start + to_days(CAST(date_diff('day', start, stop) // 2 AS INTEGER)) "
    "ELSE start + to_seconds(date_diff('second', start, stop) // 2) END"
)


@query(
    "a17_split_spans",
    _SPANS.replace("WITH b", "WITH RECURSIVE b", 1) + ", k AS (SELECT count(*) // 40 + 1 AS cap FROM events), e AS (SELECT date_trunc('second', ts) AS sec FROM events), "
    f"r AS (SELECT start, stop, whole, (SELECT count(*) FROM e WHERE sec BETWEEN start AND {_LAST}) AS cnt FROM (SELECT start, stop, true AS whole FROM s) "
    f"UNION ALL SELECT start, stop, whole, (SELECT count(*) FROM e WHERE sec BETWEEN start AND {_LAST}) FROM ("
    "SELECT CASE WHEN side = 0 THEN start WHEN whole AND start < stop THEN mid + to_days(1) ELSE mid + to_seconds(1) END AS start, "
    "CASE WHEN side = 0 THEN mid WHEN whole AND start = stop THEN start + to_seconds(86399) ELSE stop END AS stop, whole AND start < stop AS whole "
    f"FROM (SELECT start, stop, whole, {_MID} AS mid, unnest([0, 1]) AS side FROM r, k WHERE cnt > cap AND (whole OR start < stop)))) "
    f"SELECT {_HALF.format(c='start')} AS start, {_HALF.format(c='stop')} AS \"end\", CAST(cnt AS BIGINT) AS cnt FROM r, k WHERE NOT (cnt > cap AND (whole OR start < stop))",
)
def a17(spark, sf):
    events = table(spark, sf, "events")
    cap = int(events.count() / 40) + 1
    return _texted(spans.split_spans(events, "ts", _span_bounds(spark, sf), cap))


# --- order, samples, splits -------------------------------------------------------------------------------------

_HASH = "md5('42|' || CAST(doc_id AS VARCHAR))"


@query("o01_top_repos", ctes("fx_repos") + " SELECT id, stargazers_count FROM fx_repos ORDER BY stargazers_count DESC, id LIMIT 100")
def o01(spark, sf):
    return split.top_repos(view(spark, sf, "fx_repos"), 100).select("id", "stargazers_count")


@query("o02_limit_rows", "SELECT doc_id, lang FROM documents WHERE doc_id < 137")
def o02(spark, sf):
    return split.limit_rows(table(spark, sf, "documents").select("doc_id", "lang"), 137, "doc_id")


@query("o03_sample_exact", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_HASH}) AS r, count(*) OVER () AS n FROM documents) WHERE r <= n // 10")
def o03(spark, sf):
    return split.sample_exact(table(spark, sf, "documents").select("doc_id"), "doc_id", share=0.1)


def split_sql(source, key):
    h = f"md5('42|' || CAST({key} AS VARCHAR))"
    return (
        f"SELECT * EXCLUDE (r, n), CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split "
        f"FROM (SELECT *, row_number() OVER (ORDER BY {h}) AS r, count(*) OVER () AS n FROM {source})"
    )


@query("o04_split_exact", split_sql("(SELECT doc_id FROM documents)", "doc_id"))
def o04(spark, sf):
    return split.split_exact(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "o04_split_by_group",
    "SELECT DISTINCT source, CASE WHEN p < 800 THEN 'train' WHEN p < 900 THEN 'valid' ELSE 'test' END AS split, CAST(1 AS BIGINT) AS n_splits "
    "FROM (SELECT source, CAST('0x' || md5('42|' || source)[1:8] AS BIGINT) % 1000 AS p FROM documents)",
)
def o04b(spark, sf):
    rows = split.split_by_group(table(spark, sf, "documents").select("doc_id", "source"), "source")
    return rows.groupBy("source").agg(F.countDistinct("split").alias("n_splits"), F.min("split").alias("split"))


@query("o05_longest", f"SELECT doc_id, list_reduce({tok('text')}, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS word FROM documents WHERE len({tok('text')}) > 0")
def o05(spark, sf):
    from lodestack.functions.text import longest

    words = table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    return words.filter(F.size("w") > 0).select("doc_id", longest(F.col("w")).alias("word"))


@query("u01_union_all", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def u01(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    even, odd = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    return even.unionByName(odd).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u02_multi_task",
    "WITH k AS (SELECT doc_id % 4 AS k FROM documents) SELECT 'summarize_go' AS dataset, count(*) AS n, 256 AS max_source FROM k WHERE k = 0 "
    "UNION ALL SELECT 'translate_java-cs', count(*), 320 FROM k WHERE k = 1 UNION ALL SELECT 'translate_cs-java', count(*), 320 FROM k WHERE k = 1 "
    "UNION ALL SELECT 'concode', count(*), 320 FROM k WHERE k = 2 UNION ALL SELECT 'defect', count(*), 512 FROM k WHERE k = 3",
)
def u02(spark, sf):
    root = scratch_path(spark, "tasks")
    docs = table(spark, sf, "documents")
    k = F.col("doc_id") % 4
    picked = {("summarize", "go"): k == 0, ("translate", "java-cs"): k == 1, ("concode", "none"): k == 2, ("defect", "none"): k == 3}
    for task, sub, _, _ in tasks.TASK_LIMITS:
        if (task, sub) == ("translate", "cs-java"):
            continue  # reads the files of the other direction, source and target exchanged
        rows = docs.filter(picked.get((task, sub), F.lit(False)))
        paths = tasks.task_files(root, task, sub, "dev")
        if task == "summarize":
            words = F.split("text", " ")
            rows.select(words.alias("code_tokens"), words.alias("docstring_tokens")).write.json(paths[0])
        elif task == "concode":
            rows.select(F.col("text").alias("nl"), F.col("source").alias("code")).write.json(paths[0])
        elif task == "defect":
            rows.select(F.col("text").alias("func"), F.lit(1).alias("target"), F.col("doc_id").alias("idx")).write.json(paths[0])
        else:
            for path in paths:
                rows.select(F.replace("text", F.lit("\n"), F.lit(" "))).write.text(path)
    out = tasks.multi_task(spark, root, "dev")
    return out.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.max("max_source").alias("max_source"))


# --- datasets ---------------------------------------------------------------------------------------------------

_PLAIN_DOC = _RSTRIP.format(c="raw")
_CLEAN_BASE = (
    "WITH u AS (SELECT row_number() OVER (PARTITION BY text, doc_id % 2 ORDER BY doc_id) AS r, * FROM documents), "
    f"c AS (SELECT doc_id AS row_id, source AS repo, lang AS ref, text || {NL} || '```' || {NL} || 'let n = ' || (n_chars % 5) || '; // t' || {NL} || '```' AS raw, text FROM u WHERE r = 1), "
    f"s AS (SELECT row_id, repo, ref, text, {_PLAIN_DOC} AS stripped FROM c), "
    f"f AS ({first_sentence_sql('s', 'row_id, repo, ref, text, stripped', 'stripped')}), "
    f"k AS (SELECT row_id, repo, ref, doc, 'let n = ' || (SELECT n_chars % 5 FROM documents d WHERE d.doc_id = row_id) || '; ' || {NL} AS doctest, "
    "'fn f() {  let s = \"' || text || '\"; } ' AS code FROM f), "
    "z AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY code ORDER BY row_id) = 1)"
)


def _cleaned(spark, sf):
    return jobs.clean_corpus(view(spark, sf, "fx_corpus"))


@query("x02_clean_corpus", _CLEAN_BASE + " SELECT row_id, repo, ref, doc, doctest, code FROM z")
def x02(spark, sf):
    return _cleaned(spark, sf).select("row_id", "repo", "ref", "doc", "doctest", "code")


_PRE = _CLEAN_BASE + ", p AS (SELECT row_id, code, doc, doctest FROM z WHERE length(doc) >= 3 AND NOT contains(doc, chr(9)) QUALIFY row_number() OVER (PARTITION BY code, doc ORDER BY row_id) = 1) "
_FINE = _CLEAN_BASE + ", p AS (SELECT row_id, code, doc, doctest FROM z WHERE doctest <> '' QUALIFY row_number() OVER (PARTITION BY code, doc, doctest ORDER BY row_id) = 1) "


@query("x05_build_pretrain", _PRE + split_sql("(SELECT row_id, doc FROM p)", "row_id"))
def x05(spark, sf):
    return jobs.build_pretrain(_cleaned(spark, sf)).select("row_id", "doc", "split")


@query("x06_build_finetune", _FINE + split_sql("(SELECT row_id, doctest FROM p)", "row_id"))
def x06(spark, sf):
    return jobs.build_finetune(_cleaned(spark, sf)).select("row_id", "doctest", "split")


@query("f09_to_examples", _FINE + "SELECT row_id AS idx, code || doc AS source, doctest AS target FROM p")
def f09(spark, sf):
    return jobs.to_examples(jobs.finetune_rows(_cleaned(spark, sf)), "finetune")


@query("s13_write_splits", _PRE + f"SELECT split, count(*) AS n FROM ({split_sql('(SELECT row_id FROM p)', 'row_id')}) GROUP BY split")
def s13(spark, sf):
    path = scratch_path(spark, "splits")
    corpus.write_splits(jobs.build_pretrain(_cleaned(spark, sf)), path, ["row_id", "code", "doc"])
    return corpus.read_splits(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# Merges that the SQL can follow, one at a time over all words; the vocabulary proper has 50,000 pieces.
_FEW = 100


def _few(spark, sf):
    words = stage_table(subword.word_counts(table(spark, sf, "documents"), "text"), "word-counts")
    merges = subword.learn_merges(words, _FEW)
    return subword.Model(subword.vocabulary(words, merges), merges)


def _full(spark, sf):
    return subword.learn_bpe(table(spark, sf, "documents"), "text")


def _bpe_sql(texts="SELECT text AS t FROM documents WHERE false"):
    """Merges m, vocabulary v (piece, id) and word ids wid (word, ids), of the words of all documents and of ``texts``."""
    mark = "chr(2) || {0} || chr(3)"
    return (
        f"WITH RECURSIVE w AS (SELECT '▁' || w AS word, sum(n) AS freq FROM (SELECT unnest({tok('text')}) AS w, 1 AS n FROM documents UNION ALL SELECT unnest({tok('t')}), 0 FROM ({texts})) GROUP BY w), "
        f"s AS (SELECT 0 AS step, word, freq, regexp_replace(word, '(.)', chr(2) || '\\1' || chr(3), 'g') AS sym, '' AS a, '' AS b FROM w "
        f"UNION ALL SELECT s.step + 1, word, freq, replace(sym, {mark.format('p.a')} || {mark.format('p.b')}, {mark.format('p.a || p.b')}), p.a, p.b "
        "FROM s, (SELECT l[i] AS a, l[i + 1] AS b FROM (SELECT l, freq, unnest(generate_series(1, len(l) - 1)) AS i FROM (SELECT string_split(sym[2:-2], chr(3) || chr(2)) AS l, freq FROM s)) "
        f"GROUP BY 1, 2 ORDER BY sum(freq) DESC, a, b LIMIT 1) p WHERE s.step < {_FEW}), "
        "m AS (SELECT step - 1 AS rank, min(a) AS a, min(b) AS b FROM s WHERE step > 0 GROUP BY step), "
        "c AS (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM w WHERE freq > 0), "
        "u AS (SELECT piece, min(o) AS o FROM (SELECT a || b AS piece, rank AS o FROM m UNION ALL SELECT c, 1000000 FROM c WHERE c <> '') GROUP BY piece), "
        "v AS (SELECT piece, 3 + row_number() OVER (ORDER BY o, piece) AS id FROM u), "
        "wid AS (SELECT word, list(coalesce(id, 3) ORDER BY i) AS ids FROM (SELECT word, unnest(l) AS piece, generate_subscripts(l, 1) AS i "
        f"FROM (SELECT word, string_split(sym[2:-2], chr(3) || chr(2)) AS l FROM s WHERE step = {_FEW})) LEFT JOIN v USING (piece) GROUP BY word)"
    )


def _ids_sql(name, rows):
    """CTE ``name`` (k, ids) of the texts of ``rows`` (k, t)."""
    words = f"SELECT k, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT k, {tok('t')} AS w FROM ({rows}))"
    return f"{name} AS (SELECT r.k, coalesce(ids, []) AS ids FROM ({rows}) r LEFT JOIN (SELECT k, flatten(list(ids ORDER BY i)) AS ids FROM ({words}) JOIN wid ON word = '▁' || w GROUP BY k) USING (k))"


def _framed_sql(ids, most):
    return f"array_to_string(CASE WHEN len({ids}) + 2 > {most} THEN [1] || {ids}[1:{most - 2}] || [2] ELSE [1] || {ids} || [2] || list_transform(range({most} - 2 - len({ids})), lambda x: 0) END, ' ')"


@query("x07_word_counts", f"WITH w AS (SELECT unnest({tok('text')}) AS w FROM documents) SELECT '▁' || w AS word, count(*) AS freq FROM w GROUP BY w")
def x07a(spark, sf):
    return subword.word_counts(table(spark, sf, "documents"), "text")


@query("x07_first_merges", _bpe_sql() + ' SELECT CAST(rank AS INTEGER) AS rank, a AS "left", b AS "right" FROM m')
def x07b(spark, sf):
    words = stage_table(subword.word_counts(table(spark, sf, "documents"), "text"), "word-counts")
    return subword.learn(words, _FEW).select("rank", "left", "right")


@query("x07_learn_bpe")
def x07(spark, sf):
    words = stage_table(subword.word_counts(table(spark, sf, "documents"), "text"), "word-counts")
    return subword.learn(words, subword.VOCAB_SIZE)


@query("x08_encode_ids", _bpe_sql() + ", " + _ids_sql("e", "SELECT doc_id AS k, text AS t FROM documents") + f" SELECT k AS doc_id, {_framed_sql('ids', 64)} AS ids FROM e")
def x08(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = subword.with_ids(docs, "doc_id", {"ids": (F.col("text"), 64)}, _few(spark, sf))
    return rows.select("doc_id", F.array_join("ids", " ").alias("ids"))


@query("x08_decode_ids", f"SELECT doc_id, array_to_string({tok('text')}, ' ') AS text FROM documents")
def x08b(spark, sf):
    model = _full(spark, sf)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ids = stage_table(subword.with_ids(docs, "doc_id", {"ids": (F.col("text"), None)}, model).select("doc_id", "ids"), "ids")
    return subword.decode_ids(ids, "doc_id", "ids", model.vocab)


@query(
    "a03_subword_lengths",
    _bpe_sql("SELECT lang AS t FROM documents") + ", " + _ids_sql("e", "SELECT doc_id AS k, text AS t FROM documents") + ", " + _ids_sql("g", "SELECT doc_id AS k, lang AS t FROM documents")
    + " SELECT count(*) AS n, CAST(floor(avg(len(e.ids))) AS BIGINT) AS avg_src_sub, CAST(max(len(e.ids)) AS BIGINT) AS max_src_sub, CAST(floor(avg(len(g.ids))) AS BIGINT) AS avg_trg_sub, "
    "CAST(max(len(g.ids)) AS BIGINT) AS max_trg_sub FROM e JOIN g USING (k)",
)
def a03b(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("source"), F.col("lang").alias("target"))
    stats = jobs.length_stats(rows, _few(spark, sf))
    return stats.select("n", "avg_src_sub", "max_src_sub", "avg_trg_sub", "max_trg_sub")


_FEATURE_SOURCE = f"SELECT doc_id AS k, replace({_TASK} || CASE WHEN {_SUB} <> 'none' THEN ' ' || {_SUB} ELSE '' END || ': ' || text, '</s>', '<unk>') AS t FROM documents"
_FEATURE_TARGET = (
    "SELECT doc_id AS k, CASE WHEN doc_id % 4 = 3 THEN 'false' ELSE CASE doc_id % 8 WHEN 0 THEN '<en> ' WHEN 4 THEN '<en> ' WHEN 1 THEN '<c_sharp> ' "
    "WHEN 5 THEN '<java> ' ELSE '<java> ' END || source END AS t FROM documents"
)


@query(
    "x09_build_features",
    _bpe_sql(f"SELECT t FROM ({_FEATURE_SOURCE}) UNION ALL SELECT t FROM ({_FEATURE_TARGET})") + ", " + _ids_sql("e", _FEATURE_SOURCE) + ", " + _ids_sql("g", _FEATURE_TARGET)
    + f" SELECT k AS example_id, {_framed_sql('e.ids', 64)} AS source_ids, {_framed_sql('g.ids', 16)} AS target_ids FROM e JOIN g USING (k)",
)
def x09(spark, sf):
    task, sub = task_columns()
    examples = table(spark, sf, "documents").select(
        F.col("doc_id").alias("idx"), F.col("text").alias("source"), F.col("source").alias("target"), F.lit(0).alias("label"), task.alias("task"), sub.alias("sub_task")
    )
    rows = jobs.build_features(examples, "generation", _few(spark, sf), 64, 16, lang_ids=True)
    return rows.select("example_id", F.array_join("source_ids", " ").alias("source_ids"), F.array_join("target_ids", " ").alias("target_ids"))


def _ids_of(df, *columns):
    return df.select("row_id", "split", *[F.array_join(c, " ").alias(c) for c in columns])


@query("x05_pretrain_ids")
def x05b(spark, sf):
    """Learnt on the cleaned code and docs themselves, with the vocabulary proper."""
    rows = stage_table(_cleaned(spark, sf), "cleaned")
    model = subword.learn_bpe(rows.select(F.concat_ws(" ", "code", "doc", "doctest").alias("t")), "t")
    return _ids_of(jobs.build_pretrain(rows, model), "code_tokens", "doc_tokens")


@query("x06_finetune_ids")
def x06b(spark, sf):
    rows = stage_table(_cleaned(spark, sf), "cleaned")
    model = subword.learn_bpe(rows.select(F.concat_ws(" ", "code", "doc", "doctest").alias("t")), "t")
    return _ids_of(jobs.build_finetune(rows, model), "code_doc_tokens", "doctest_tokens")


# --- language ---------------------------------------------------------------------------------------------------


def _detected(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    counts = stage_table(language.gram_table(docs, "doc_id", "text", "lang"), "grams")
    profiles, floors = language.learn_profiles(counts)
    return language.score_language(docs, counts, profiles, floors, "doc_id")


_GRAMS = (
    "WITH c AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '\\P{L}+', ' ', 'g')) || ' ' AS t FROM documents), "
    "g AS (SELECT doc_id, lang, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS gram FROM c), "
    "b AS (SELECT doc_id, lang, gram, count(*) AS cnt FROM g GROUP BY ALL), p AS (SELECT lang, gram, sum(cnt) AS cnt FROM b GROUP BY ALL), "
    "z AS (SELECT lang, sum(cnt) + count(*) + 1 AS size FROM p GROUP BY lang), "
    "q AS (SELECT gram, lang, ln((cnt + 1) / size) + ln(size) AS gain FROM p JOIN z USING (lang)), "
    "s AS (SELECT b.doc_id, q.lang, sum(b.cnt * q.gain) AS gain FROM b JOIN q USING (gram) GROUP BY ALL), "
    "t AS (SELECT doc_id, sum(cnt) AS grams FROM b GROUP BY doc_id), "
    "r AS (SELECT s.doc_id, s.lang, round(gain - grams * ln(size), 6) AS score FROM s JOIN t USING (doc_id) JOIN z ON z.lang = s.lang), "
    "d AS (SELECT doc_id, lang AS detected FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1) "
)


@query("a20_score_language", _GRAMS + "SELECT documents.doc_id, coalesce(detected, 'unk') AS detected FROM documents LEFT JOIN d USING (doc_id)")
def a20(spark, sf):
    return _detected(spark, sf)


@query("f05_filter_language", _GRAMS + "SELECT documents.doc_id, lang FROM documents LEFT JOIN d USING (doc_id) WHERE coalesce(detected, 'unk') IN ('unk', 'en', 'ca', 'nl')")
def f05(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return language.filter_language(docs, _detected(spark, sf), "doc_id")

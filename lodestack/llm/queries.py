"""The queries of this subpackage and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.llm import (
    bwt_dedup, count_min, decontam, fill_middle, hard_negatives, kneser_ney, lang_kernel, mil_quality, mixing, parity_join, quality_rules, topk, url_rules,
)
from lodestack.llm.common import table

QUERIES, SQL = {}, {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


@query(
    "op4_url_rules",
    """WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rhost, rpath, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path, rhost || rpath AS rule, action FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(action, length(rule)), 'allow') AS verdict FROM m GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY page_id, host, path"),
)
def op4(spark, sf):
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, action string")
    return url_rules.judge(table(spark, sf, "pages"), rules)


@query(
    "op5_top_k",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
)
def op5(spark, sf):
    rows = table(spark, sf, "embeddings")
    return topk.top_k(rows, rows.filter(F.col("vec_id") % 100 == 0), 10)


@query("op6_mixing")
def op6(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


@query(
    "op10_count_min",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS i, w FROM d WHERE len(w) >= 50),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS lowest FROM s GROUP BY h),
hit AS (SELECT doc_id, list(i) AS starts FROM s JOIN m USING (h) WHERE doc_id > lowest GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, unnest(starts) AS i FROM hit), range(50) AS r(j)),
k AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
t AS (SELECT k.doc_id, list(word ORDER BY k.i) FILTER (WHERE gone.i IS NULL) AS kept, count(*) AS n, count(gone.i) AS g FROM k LEFT JOIN gone ON k.doc_id = gone.doc_id AND k.i = gone.i GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g, 0) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
)
def op10(spark, sf):
    return count_min.remove_repeats(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op8_suffix_dedup")
def op8(spark, sf):
    return bwt_dedup.remove_repeats(table(spark, sf, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query(
    "op7_decontaminate",
    r"""WITH lo(a, b) AS (VALUES ('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, lo),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, lo WHERE text IS NOT NULL AND item_id IS NOT NULL),
v AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS h FROM (SELECT item, w, least(len(w), 10) AS k, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS h FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k)),
m AS (SELECT doc_id, k, i, item FROM s JOIN v USING (k, h)),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT DISTINCT doc_id, k, i FROM m), range(10) AS r(j) WHERE j < k) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
)
def op7(spark, sf):
    return decontam.digest(decontam.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")))


@query(
    "op3_parity_join",
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))]
 ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
f AS (SELECT h, count(*) AS c FROM x GROUP BY h HAVING c > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN f USING (h) JOIN x b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, k.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) k ON k.a = s.doc_id""",
)
def op3(spark, sf):
    return parity_join.near_duplicates(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op1_language_kernel")
def op1(spark, sf):
    return lang_kernel.classify(table(spark, sf, "documents"))


@query("op2_mil_quality")
def op2(spark, sf):
    found = mil_quality.score(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query("op9_kneser_ney")
def op9(spark, sf):
    return kneser_ney.score(table(spark, sf, "documents"), single=True).drop("perplexity")


@query(
    "op11_fill_middle",
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, w, len(w) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS p, coalesce(array_to_string(w[a + 1:b], ''), '') AS m, coalesce(array_to_string(w[b + 1:n], ''), '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
)
def op11(spark, sf):
    return fill_middle.fill_in_middle(table(spark, sf, "documents")).drop("output")


@query(
    "op12_hard_negatives",
    """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
 CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
 FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
)
def op12(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.vectors(table(spark, sf, "embeddings").select("vec_id", "embedding", label.alias("label")))
    return hard_negatives.mine(rows, rows.filter(F.col("vec_id") % 100 == 0))


@query(
    "op13_quality_rules",
    r"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
x AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 7], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w WHERE len(w) >= 8)),
y AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM x) WHERE c > 1),
z AS (SELECT doc_id, count(*) AS r FROM (SELECT DISTINCT doc_id, i + j AS i FROM y, range(8) AS g(j)) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
 len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words FROM w LEFT JOIN z USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
v AS (SELECT doc_id, lang, source, unnest([{'m': 'a', 'v': word_chars * 1000 // n_words, 'g': 250}, {'m': 'b', 'v': n_symbols * 1000000 // word_chars, 'g': 10000},
 {'m': 'c', 'v': n_dup_lines * 1000000 // n_lines, 'g': 110000}, {'m': 'd', 'v': n_repeat_words * 1000000 // n_words, 'g': 100000}], recursive := true) FROM f WHERE NOT base_failed),
k AS (SELECT lang, source, m, v - v % (CAST(1 AS BIGINT) << greatest(length(bin(v)) - 8, 0)) AS e, CAST(count(*) AS BIGINT) AS c FROM v GROUP BY ALL),
s AS (SELECT 0 AS lvl, lang, source, m, e, c FROM k UNION ALL SELECT 1, lang, NULL, m, e, sum(c) FROM k GROUP BY lang, m, e UNION ALL SELECT 2, NULL, NULL, m, e, sum(c) FROM k GROUP BY m, e),
u AS (SELECT *, sum(c) OVER (PARTITION BY lvl, lang, source, m ORDER BY e ROWS UNBOUNDED PRECEDING) AS upto, sum(c) OVER (PARTITION BY lvl, lang, source, m) AS total FROM s),
q AS (SELECT lvl, lang, source, m, max(total) AS total, min(e) FILTER (WHERE 4 * upto >= total) AS low, min(e) FILTER (WHERE 4 * upto >= 3 * total) AS high FROM u GROUP BY lvl, lang, source, m),
o AS (SELECT v.doc_id, v.m, v.v, v.g, arg_min(struct_pack(low := q.low, high := q.high), q.lvl) AS t FROM v JOIN q ON v.m = q.m AND (q.total >= 100 OR q.lvl = 2)
 AND (q.lvl = 2 OR v.lang IS NOT DISTINCT FROM q.lang) AND (q.lvl > 0 OR v.source IS NOT DISTINCT FROM q.source) GROUP BY v.doc_id, v.m, v.v, v.g),
j AS (SELECT doc_id, bool_or(v > t.high + 3 * greatest(t.high - t.low, g) OR (m = 'a' AND v < t.low - 3 * greatest(t.high - t.low, g))) AS bad FROM o GROUP BY doc_id)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
 base_failed, NOT base_failed AND NOT coalesce(bad, FALSE) AS kept FROM f LEFT JOIN j USING (doc_id)""",
)
def op13(spark, sf):
    return quality_rules.judge(table(spark, sf, "documents")).drop("failed")

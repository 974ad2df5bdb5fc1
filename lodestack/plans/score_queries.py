"""Queries on n-grams, scores and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lodestack.functions.text import tokens
from lodestack.operators import overlap, scores
from lodestack.plans import jobs
from lodestack.plans.derived import ctes, table, view
from lodestack.plans.text_queries import PUNCT_SQL, nist_sql, tok, trim
from lodestack.sources.keywords import KEYWORDS
from lodestack.sources.text import read_keywords
from lodestack.session import scratch_path, stage_table

QUERIES, SQL = {}, {}

# The documents are prose; this list has common words of theirs besides a few keywords.
WORDS = KEYWORDS["java"] + ["the", "and", "de", "la", "der", "und", "el"]


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


def _grams(source, key, top, extra=""):
    """Rows (key, n, gram) by window leads over the unnested tokens."""
    cols = f"{key}{extra}"
    ahead = ", ".join(f"lead(w, {k}) OVER w AS w{k}" for k in range(1, top))
    joined, texts = "w", ["w"]
    for k in range(1, top):
        joined += f" || ' ' || w{k}"
        texts.append(joined)
    orders = ", ".join(str(n) for n in range(1, top + 1))
    return (
        f"SELECT {cols}, n, gram FROM (SELECT {cols}, unnest([{orders}]) AS n, unnest([{', '.join(texts)}]) AS gram FROM "
        f"(SELECT {cols}, w, {ahead} FROM (SELECT {cols}, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM {source}) "
        f"WINDOW w AS (PARTITION BY {cols} ORDER BY i))) WHERE gram IS NOT NULL"
    )


def stats_sql(top=5, source="fx_pairs", words=WORDS):
    kw = ", ".join(f"'{w}'" for w in sorted(set(words)))
    return (
        ctes(source) + f", sides AS MATERIALIZED (SELECT idx, 1 AS is_hyp, {tok('pred')} AS t FROM {source} UNION ALL SELECT idx, 0, {tok('gold')} FROM {source}), "
        f"g AS ({_grams('sides', 'idx', top, ', is_hyp')}), "
        "o AS MATERIALIZED (SELECT idx, n, gram, sum(is_hyp) AS h, sum(1 - is_hyp) AS r FROM g GROUP BY ALL), "
        "m AS (SELECT idx, " + ", ".join(f"sum(CASE WHEN n = {n} THEN least(h, r) ELSE 0 END) AS m{n}" for n in range(1, top + 1))
        + f", sum(CASE WHEN n = 1 THEN least(h, r) * (CASE WHEN gram IN ({kw}) THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END) ELSE 0 END) AS wm"
        + f", sum(CASE WHEN n = 1 THEN r * (CASE WHEN gram IN ({kw}) THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END) ELSE 0 END) AS wr FROM o GROUP BY idx), "
        "l AS (SELECT idx, sum(CASE WHEN is_hyp = 1 THEN len(t) ELSE 0 END) AS hyp_len, sum(CASE WHEN is_hyp = 0 THEN len(t) ELSE 0 END) AS ref_len FROM sides GROUP BY idx), "
        "stats AS MATERIALIZED (SELECT l.idx, hyp_len, ref_len, " + ", ".join(f"coalesce(m{n}, 0) AS m{n}" for n in range(1, top + 1)) + ", coalesce(wm, 0) AS wm, coalesce(wr, 0) AS wr FROM l LEFT JOIN m USING (idx)) "
    )


STATS = stats_sql()


def pair_stats(spark, sf, max_order=4, keywords=None):
    return overlap.segment_stats(view(spark, sf, "fx_pairs"), "idx", "pred", "gold", max_order, keywords)


def possible(n, c="hyp_len"):
    return f"greatest({c} - {n - 1}, 0)"


# --- n-grams ----------------------------------------------------------------------------------------------------


@query("a19_ngram_counts", f"WITH s AS (SELECT doc_id, {tok('text')} AS t FROM documents), g AS ({_grams('s', 'doc_id', 4)}), c AS (SELECT doc_id, n, gram, count(*) AS cnt FROM g GROUP BY ALL) "
    "SELECT doc_id, CAST(n AS BIGINT) AS n, count(*) AS distinct_grams, CAST(sum(cnt) AS BIGINT) AS grams, max(cnt) AS most FROM c GROUP BY doc_id, n")
def a19(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    counts = overlap.ngram_counts(rows, "doc_id", "t", 4)
    return counts.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("distinct_grams"), F.sum("cnt").alias("grams"), F.max("cnt").alias("most")).withColumn("n", F.col("n").cast("long"))


@query("a19_padded_bigrams", f"WITH s AS (SELECT doc_id, list_concat(['<s>'], list_concat({tok('text')}, ['</s>'])) AS t FROM documents), g AS ({_grams('s', 'doc_id', 2)}) SELECT gram, count(*) AS cnt FROM g WHERE n = 2 GROUP BY gram")
def a19b(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", overlap.pad_tokens(tokens(F.col("text")), 2, "<s>", "</s>").alias("t"))
    grams = overlap.with_grams(rows, "t", "_g", 2)
    return grams.select(F.explode("_g2").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("cnt"))


@query("j10_clipped_match", STATS + "SELECT CAST(n AS BIGINT) AS n, CAST(sum(least(h, r)) AS BIGINT) AS matches, CAST(sum(h) AS BIGINT) AS hyp FROM o WHERE n <= 4 GROUP BY n")
def j10(spark, sf):
    rows = overlap.gram_overlap(view(spark, sf, "fx_pairs"), "idx", "pred", "gold")
    return rows.groupBy(F.col("n").cast("long").alias("n")).agg(F.sum(F.least("hyp_cnt", "ref_cnt")).alias("matches"), F.sum("hyp_cnt").alias("hyp"))


@query(
    "j11_keyword_weights",
    "WITH k(w) AS (VALUES " + ", ".join(f"('{w}')" for w in sorted(set(WORDS))) + f"), t AS (SELECT doc_id, unnest({tok('text')}) AS w FROM documents) "
    "SELECT doc_id, round(sum(CASE WHEN k.w IS NULL THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END), 6) AS weight FROM t LEFT JOIN k ON k.w = t.w GROUP BY doc_id",
)
def j11(spark, sf):
    path = scratch_path(spark, "keywords")
    spark.createDataFrame([(w,) for w in WORDS], "word string").coalesce(1).write.text(path)
    marks = read_keywords(spark, path).distinct().withColumn("w", F.lit(1.0))
    words = table(spark, sf, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("word"))
    weighted = words.join(F.broadcast(marks), "word", "left")
    return weighted.groupBy("doc_id").agg(F.round(F.sum(F.coalesce("w", F.lit(0.2))), 6).alias("weight"))


@query(
    "u03_gram_union",
    f"WITH p AS (SELECT doc_id % 50 AS id, doc_id AS ref_id, {tok('text')} AS t FROM documents), g AS ({_grams('p', 'id, ref_id', 2)}), c AS (SELECT id, ref_id, n, gram, count(*) AS cnt FROM g GROUP BY ALL), "
    "b AS (SELECT id, n, gram, max(cnt) AS best FROM c GROUP BY ALL) SELECT id, CAST(n AS BIGINT) AS n, CAST(sum(best) AS BIGINT) AS total FROM b GROUP BY id, n",
)
def u03(spark, sf):
    rows = table(spark, sf, "documents").select(F.struct((F.col("doc_id") % 50).alias("id"), F.col("doc_id").alias("ref_id")).alias("k"), tokens(F.col("text")).alias("t"))
    best = overlap.ngram_counts(rows, "k", "t", 2).groupBy(F.col("k.id").alias("id"), "n", "gram").agg(F.max("cnt").alias("best"))
    return best.groupBy("id", F.col("n").cast("long").alias("n")).agg(F.sum("best").alias("total"))


# --- scores -----------------------------------------------------------------------------------------------------


@query("a04_exact_match", ctes("fx_pairs") + f" SELECT round(avg(CASE WHEN {trim('pred')} = {trim('gold')} THEN 1 ELSE 0 END) * 100, 6) AS em FROM fx_pairs")
def a04(spark, sf):
    return scores.exact_match(view(spark, sf, "fx_pairs")).select(F.round("em", 6).alias("em"))


@query("a05_label_accuracy", "SELECT round(avg(CASE WHEN (toxic = 1) = (quality = 1) THEN 1 ELSE 0 END) * 100, 6) AS em FROM labels")
def a05(spark, sf):
    rows = table(spark, sf, "labels").select(F.when(F.col("toxic") == 1, "true").otherwise("false").alias("pred"), F.col("quality").alias("label"))
    return scores.label_accuracy(rows).select(F.round("em", 6).alias("em"))


_P_SUM = STATS + ", t AS (SELECT sum(hyp_len) AS h, sum(ref_len) AS r, " + ", ".join(f"sum(m{n}) AS a{n}, sum({possible(n)}) AS b{n}" for n in range(1, 5)) + " FROM stats) "
_BP = "CASE WHEN h > r THEN 1.0::DOUBLE ELSE exp(1 - r::DOUBLE / h) END"


def _corpus_bleu_sql(smooth):
    p = [f"((a{n} + 1.0::DOUBLE) / (b{n} + 1))" if smooth else f"(a{n}::DOUBLE / b{n})" for n in range(1, 5)]
    return (
        _P_SUM + "SELECT round(100 * exp((" + " + ".join(f"ln({x})" for x in p) + f") / 4) * ({_BP}), 2) AS bleu, round({_BP}, 6) AS bp, CAST(h AS BIGINT) AS hyp_len, CAST(r AS BIGINT) AS ref_len, "
        + ", ".join(f"CAST(a{n} AS BIGINT) AS match_{n}, CAST(b{n} AS BIGINT) AS possible_{n}" for n in range(1, 5)) + " FROM t"
    )


@query("a06_corpus_bleu", _corpus_bleu_sql(True))
def a06(spark, sf):
    return scores.corpus_bleu(view(spark, sf, "fx_pairs"), "idx")


@query("a06_corpus_bleu_plain", _corpus_bleu_sql(False))
def a06b(spark, sf):
    return scores.corpus_bleu(view(spark, sf, "fx_pairs"), "idx", smooth=False)


_TINY = "2.2250738585072014e-308::DOUBLE"


def _smooth_sql(reflen):
    parts = []
    for n in range(1, 5):
        add = 0 if n == 1 else 1
        parts.append(f"ln(m{n} + {add} + {_TINY}) - ln({possible(n)} + {add} + {_TINY})")
    total = f"exp(({' + '.join(parts)}) / 4 + least(0, 1 - ({reflen} + 1)::DOUBLE / (hyp_len + 1)))"
    plain = [f"CASE WHEN {possible(n)} = 0 THEN 0 ELSE exp(ln(m{n} + {_TINY}) - ln({possible(n)})) END" for n in range(1, 5)]
    return f"round(avg({total}) * 100, 6) AS total, " + ", ".join(f"round(avg({x}) * 100, 6) AS p{n}" for n, x in enumerate(plain, 1))


def _norm_sql(c):
    return nist_sql(PUNCT_SQL.format(c=trim(c)))


_MULTI = (
    "WITH h AS (SELECT conv_id AS id, arg_max(text, turn) AS pred FROM conversations WHERE role = 'assistant' GROUP BY conv_id), "
    f"hs AS (SELECT id, {_norm_sql('pred')} AS t FROM h), rs AS (SELECT conv_id AS id, turn AS ref_id, {_norm_sql('text')} AS t FROM conversations JOIN h ON h.id = conv_id WHERE role = 'user'), "
    f"hg AS (SELECT id, n, gram, count(*) AS c FROM ({_grams('hs', 'id', 4)}) GROUP BY ALL), rg AS (SELECT id, n, gram, max(c) AS c FROM (SELECT id, ref_id, n, gram, count(*) AS c FROM ({_grams('rs', 'id, ref_id', 4)}) GROUP BY ALL) GROUP BY ALL), "
    "mm AS (SELECT hg.id, " + ", ".join(f"sum(CASE WHEN hg.n = {n} THEN least(hg.c, coalesce(rg.c, 0)) ELSE 0 END) AS m{n}" for n in range(1, 5)) + " FROM hg LEFT JOIN rg USING (id, n, gram) GROUP BY hg.id), "
    "ll AS (SELECT id, min(len(t)) AS ref_min, avg(len(t)) AS ref_avg FROM rs GROUP BY id), "
    "st AS (SELECT hs.id, len(hs.t) AS hyp_len, ref_min, ref_avg, " + ", ".join(f"coalesce(m{n}, 0) AS m{n}" for n in range(1, 5)) + " FROM hs JOIN ll USING (id) LEFT JOIN mm USING (id)) "
)


def _conversation_refs(spark, sf):
    rows = table(spark, sf, "conversations")
    preds = rows.filter("role = 'assistant'").select(F.col("conv_id").alias("id"), F.col("text").alias("pred"), "turn")
    golds = rows.filter("role = 'user'").select(F.col("conv_id").alias("id"), F.col("text").alias("gold"), F.col("turn").alias("ref_id"))
    return scores.join_gold_pred(preds, golds, "id", "turn")


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query("a07_smooth_bleu", _MULTI + "SELECT " + _smooth_sql("ref_min") + " FROM st")
def a07(spark, sf):
    preds, golds = _conversation_refs(spark, sf)
    return _rounded(scores.smooth_bleu(scores.smooth_bleu_per_id(preds, golds, "id")))


@query("a21_average_ref_length", _MULTI + "SELECT " + _smooth_sql("ref_avg") + " FROM st")
def a21(spark, sf):
    preds, golds = _conversation_refs(spark, sf)
    return _rounded(scores.smooth_bleu(scores.smooth_bleu_per_id(preds, golds, "id", "average")))


@query("a21_closest_ref_length", _MULTI + ", q AS (SELECT rs.id, len(hs.t) AS hyp_len, len(rs.t) AS ref_len FROM hs JOIN rs USING (id)) SELECT id, hyp_len, ref_len FROM q QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(ref_len - hyp_len), ref_len) = 1")
def a21b(spark, sf):
    preds, golds = _conversation_refs(spark, sf)
    prep = lambda df, c, *keys: df.select(*keys, F.expr("1").alias("_"), c.alias("tok"))
    from lodestack.functions.text import normalize_nist, split_punct

    hyps = prep(preds, normalize_nist(split_punct(F.col("pred"))), "id")
    refs = prep(golds, normalize_nist(split_punct(F.col("gold"))), "id", "ref_id")
    out = overlap.closest_ref_length(hyps, refs, "id")
    return out.select("id", F.col("hyp_len").cast("long").alias("hyp_len"), F.col("ref_len").cast("long").alias("ref_len"))


_CLOSEST_BP = "CASE WHEN {h} > {r} THEN 1.0::DOUBLE WHEN {h} = 0 THEN 0 ELSE exp(1 - {r}::DOUBLE / {h}) END"


@query("a22_brevity", STATS + f"SELECT idx, round({_CLOSEST_BP.format(h='hyp_len', r='ref_len')}, 6) AS closest, round(CASE WHEN hyp_len = 0 OR ref_len = 0 THEN 0 WHEN hyp_len > ref_len THEN 1 ELSE exp(1 - ref_len::DOUBLE / hyp_len) END, 6) AS ratio, round(exp(least(0, 1 - (ref_len + 1)::DOUBLE / (hyp_len + 1))), 6) AS smoothed FROM (SELECT idx, hyp_len // 2 + idx % 7 AS hyp_len, ref_len FROM stats)")
def a22(spark, sf):
    size = lambda c: F.size(tokens(F.col(c)))
    stats = view(spark, sf, "fx_pairs").select("idx", (F.floor(size("pred") / 2) + F.col("idx") % 7).alias("h"), size("gold").alias("r"))
    h, r = F.col("h"), F.col("r")
    return stats.select(
        "idx",
        F.round(scores.brevity_closest(h, r), 6).alias("closest"),
        F.round(scores.brevity_ratio(h, r), 6).alias("ratio"),
        F.round(F.exp(scores.brevity_log_smoothed(h, r)), 6).alias("smoothed"),
    )


_D = {n: f"greatest({possible(n)}, 1)" for n in range(1, 6)}


def _score_sql(ps, h="hyp_len", r="ref_len", first="m1", weights=(0.25, 0.25, 0.25, 0.25)):
    logs = " + ".join(f"{w} * ln({p})" for w, p in zip(weights, ps))
    return f"CASE WHEN {first} = 0 THEN 0 ELSE ({_CLOSEST_BP.format(h=h, r=r)}) * exp({logs}) END"


def _method_sql(method, num, den, h):
    """The four precisions of a smoothing method; ``num`` and ``den`` map order to SQL."""
    raw = {n: f"({num[n]}::DOUBLE / {den[n]})" for n in num}
    if method == 0:
        return [f"(CASE WHEN {num[n]} = 0 THEN {_TINY} ELSE {raw[n]} END)" for n in range(1, 5)]
    if method == 1:
        return [f"(CASE WHEN {num[n]} = 0 THEN 0.1::DOUBLE / {den[n]} ELSE {raw[n]} END)" for n in range(1, 5)]
    if method == 2:
        return [f"(({num[n]} + 1)::DOUBLE / ({den[n]} + 1))" for n in range(1, 5)]
    if method == 3:
        out = []
        for n in range(1, 5):
            k = " + ".join(f"CASE WHEN {num[j]} = 0 THEN 1 ELSE 0 END" for j in range(1, n + 1))
            out.append(f"(CASE WHEN {num[n]} = 0 THEN 1 / (power(2.0::DOUBLE, {k}) * {den[n]}) ELSE {raw[n]} END)")
        return out
    if method in (4, 7):
        lifted = {n: f"(CASE WHEN {num[n]} = 0 THEN ({n - 1} + 5 / ln(CASE WHEN {h} > 1 THEN {h} END)) / {den[n]} ELSE {raw[n]} END)" for n in range(1, 5)}
        if method == 4:
            return [lifted[n] for n in range(1, 5)]
        raw = {**lifted, 5: raw[5]}
    if method in (5, 7):
        out, before = [], f"({raw[1]} + 1)"
        for n in range(1, 5):
            before = f"(({before} + {raw[n]} + {raw[n + 1]}) / 3)"
            out.append(before)
        return out
    p = [raw[1], raw[2]]
    for n in (3, 4):
        prior = f"(CASE WHEN {p[n - 3]} = 0 THEN 0 ELSE {p[n - 2]} * {p[n - 2]} / {p[n - 3]} END)"
        p.append(f"(({num[n]} + 5 * {prior}) / (greatest({h} - {n - 1}, 0) + 5))")
    return [f"(CASE WHEN {num[3]} > 0 THEN {x} END)" for x in p]


_SEG_NUM = {n: f"m{n}" for n in range(1, 6)}
_SENTENCES = ", ".join(f"round(coalesce({_score_sql(_method_sql(k, _SEG_NUM, _D, 'hyp_len'))}, -1), 6) AS s{k}" for k in range(8))


@query("a23_smoothing", STATS + f"SELECT idx, {_SENTENCES} FROM stats")
def a23(spark, sf):
    stats = pair_stats(spark, sf, 5)
    return stats.select("idx", *[F.round(F.coalesce(scores.sentence_bleu(stats, method=k), F.lit(-1.0)), 6).alias(f"s{k}") for k in range(8)])


@query("a24_sentence_bleu", STATS + f"SELECT idx, round({_score_sql(_method_sql(1, _SEG_NUM, _D, 'hyp_len'), weights=(0.5, 0.3, 0.2))}, 6) AS score, "
    "round(CASE WHEN hyp_len IN (1, 2, 3) THEN " + "CASE hyp_len " + " ".join(f"WHEN {k} THEN {_score_sql(_method_sql(1, _SEG_NUM, _D, 'hyp_len')[:k], weights=tuple(f'(1.0::DOUBLE / {k})' for _ in range(k)))}" for k in (1, 2, 3)) + " END "
    f"ELSE {_score_sql(_method_sql(1, _SEG_NUM, _D, 'hyp_len'))} END, 6) AS reweighed FROM stats")
def a24(spark, sf):
    stats = pair_stats(spark, sf)
    return stats.select(
        "idx",
        F.round(scores.sentence_bleu(stats, (0.5, 0.3, 0.2)), 6).alias("score"),
        F.round(scores.sentence_bleu(stats, auto_reweigh=True), 6).alias("reweighed"),
    )


_TOTALS = ", t AS (SELECT sum(hyp_len) AS h, sum(ref_len) AS r, 2 * count(*) AS two, sum(wm) AS wm, sum(greatest(wr, 1)) AS wr, " + ", ".join(
    f"sum(m{n}) AS a{n}, sum({_D[n]}) AS b{n}, sum(greatest({possible(n, 'ref_len')}, 1)) AS c{n}" for n in range(1, 5)
) + " FROM stats) "
_CORPUS = STATS + _TOTALS
_A = {n: f"a{n}" for n in range(1, 5)}
_B = {n: f"b{n}" for n in range(1, 5)}


@query("a08_nltk_bleu", _CORPUS + "SELECT " + ", ".join(f"round({_score_sql(_method_sql(k, _A, _B, 'h'), 'h', 'r', 'a1')}, 6) AS method{k}" for k in range(5)) + " FROM t")
def a08(spark, sf):
    stats = pair_stats(spark, sf)
    sums = stats.agg(
        F.sum("hyp_len").alias("h"), F.sum("ref_len").alias("r"),
        *[F.sum(f"m{n}").alias(f"num{n}") for n in range(1, 5)],
        *[F.sum(F.greatest(scores.possible(F.col("hyp_len"), n), F.lit(1))).alias(f"den{n}") for n in range(1, 5)],
    )
    pairs = [(F.col(f"num{n}"), F.col(f"den{n}")) for n in range(1, 5)]
    return sums.select(*[F.round(scores.bleu_value(pairs, F.col("h"), F.col("r"), [0.25] * 4, k), 6).alias(f"method{k}") for k in range(5)])


_RECALL = _score_sql(["(wm / wr)"] + [f"(CASE WHEN a{n} = 0 THEN 0.1::DOUBLE ELSE a{n} END / c{n})" for n in (2, 3, 4)], "h", "two", "wm")


NGRAM_SQL = _score_sql(_method_sql(1, _A, _B, "h"), "h", "r", "a1")
RECALL_SQL = _RECALL
BLEU_SQL = "round(100 * exp((" + " + ".join(f"ln((a{n} + 1.0::DOUBLE) / (p{n} + 1))" for n in range(1, 5)) + f") / 4) * ({_BP}), 2)"


def code_totals_sql(words):
    """One row t of sums over the code pairs, with the possible n-gram counts p1..p4 that are not raised to one."""
    plain = ", ".join(f"sum({possible(n)}) AS p{n}" for n in range(1, 5))
    return stats_sql(4, "fx_code", words) + _TOTALS.replace(", t AS (SELECT ", f", t AS (SELECT {plain}, ", 1)


@query("a09_weighted_recall", _CORPUS + f"SELECT round({_RECALL}, 6) AS score FROM t")
def a09(spark, sf):
    return scores.weighted_recall(pair_stats(spark, sf, keywords=WORDS)).select(F.round("score", 6).alias("score"))


@query("a09_weighted_recall_true_length", _CORPUS + f"SELECT round({_RECALL.replace('two', 'r')}, 6) AS score FROM t")
def a09b(spark, sf):
    return scores.weighted_recall(pair_stats(spark, sf, keywords=WORDS), compat=False).select(F.round("score", 6).alias("score"))


# Two references for odd documents and three for even ones, of different lengths.
_REF_SIDES = (
    ctes("fx_pairs") + f", sides AS MATERIALIZED (SELECT idx, 0 AS slot, {tok('pred')} AS t FROM fx_pairs UNION ALL SELECT idx, 1, {tok('gold')} FROM fx_pairs "
    f"UNION ALL SELECT idx, 2, {tok("replace(gold, ' ', '  x ')")} FROM fx_pairs WHERE idx % 3 = 0 UNION ALL SELECT idx, 2, {tok("replace(gold, ' of ', ' ')")} FROM fx_pairs WHERE idx % 3 <> 0 "
    f"UNION ALL SELECT idx, 3, {tok("replace(pred, ' a ', ' the the ')")} FROM fx_pairs WHERE idx % 2 = 0), "
    f"g AS ({_grams('sides', 'idx, slot', 4)}), c AS MATERIALIZED (SELECT idx, slot, n, gram, count(*) AS c FROM g GROUP BY ALL), "
)


def _refs_sql(words=WORDS):
    kw = ", ".join(f"'{w}'" for w in sorted(set(words)))
    weigh = f"CASE WHEN k.n = 1 AND k.gram NOT IN ({kw}) THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END"
    pick = lambda x, name: ", ".join(f"sum(CASE WHEN n = {n} THEN {x} ELSE 0 END) AS {name}{n}" for n in range(1, 5))
    dens = ", ".join(f"sum(greatest(len(t) - {n - 1}, 1)) AS d{n}" for n in range(2, 5))
    number = {n: f"m{n}" for n in range(1, 5)}, {n: f"p{n}" for n in range(1, 5)}
    recall = ["(r1 / d1)"] + [f"(CASE WHEN r{n} = 0 THEN 0.1::DOUBLE ELSE r{n} END / d{n})" for n in (2, 3, 4)]
    return (
        _REF_SIDES + "h AS (SELECT idx, n, gram, c FROM c WHERE slot = 0), "
        f"e AS (SELECT k.idx, k.n, k.gram, least(h.c, max(k.c)) AS clipped, sum(least(h.c, k.c) * {weigh}) AS summed FROM c k JOIN h ON k.slot > 0 AND k.idx = h.idx AND k.n = h.n AND k.gram = h.gram GROUP BY k.idx, k.n, k.gram, h.c), "
        f"q AS (SELECT {pick('clipped', 'm')}, {pick('summed', 'r')} FROM e), "
        f"s AS (SELECT idx, slot, t, len(t) AS len, 0.2::DOUBLE * len(t) + 0.8::DOUBLE * len(list_filter(t, lambda w: w IN ({kw}))) AS w FROM sides), "
        f"d AS (SELECT sum(greatest(w, 1)) AS d1, {dens} FROM s WHERE slot > 0), "
        "l AS (SELECT r.idx, any_value(h.len) AS hyp_len, min(r.len) AS short, arg_min(r.len, abs(r.len - h.len) * 1000000 + r.len) AS near FROM s r JOIN s h ON r.idx = h.idx AND h.slot = 0 AND r.slot > 0 GROUP BY r.idx), "
        "y AS (SELECT sum(hyp_len) AS h, sum(short) AS short, sum(near) AS near, 2 * count(*) AS two, "
        + ", ".join(f"sum(greatest({possible(n)}, 1)) AS p{n}, sum({possible(n)}) AS o{n}" for n in range(1, 5)) + " FROM l) "
        "SELECT round(100 * exp((" + " + ".join(f"ln((m{n} + 1.0::DOUBLE) / (o{n} + 1))" for n in range(1, 5)) + ") / 4) * CASE WHEN h > short THEN 1.0::DOUBLE ELSE exp(1 - short::DOUBLE / h) END, 2) AS bleu, "
        f"round({_score_sql(_method_sql(1, *number, 'h'), 'h', 'near', 'm1')}, 6) AS ngram, round({_score_sql(recall, 'h', 'two', 'r1')}, 6) AS weighted FROM q, d, y"
    )


@query("a09_several_references", _refs_sql())
def a09c(spark, sf):
    pairs = view(spark, sf, "fx_pairs")
    third, gold = F.col("idx") % 3 == 0, F.col("gold")
    second = F.when(third, F.replace(gold, F.lit(" "), F.lit("  x "))).otherwise(F.replace(gold, F.lit(" of "), F.lit(" ")))
    last = F.when(F.col("idx") % 2 == 0, F.replace("pred", F.lit(" a "), F.lit(" the the ")))
    rows = pairs.select("idx", "pred", F.array_compact(F.array(gold, second, last)).alias("refs"))
    stats = stage_table(overlap.reference_stats(rows, "idx", "pred", "refs", 4, WORDS), "stats")
    return scores.reference_scores(stats).select("bleu", F.round("ngram", 6).alias("ngram"), F.round("weighted", 6).alias("weighted"))


# --- user functions ---------------------------------------------------------------------------------------------


def half_up(pairs, hyp_len):
    """A user's own smoothing: half a match more in every order."""
    return [(num + 0.5) / (den + 0.5) for num, den in pairs]


@query("p04_custom_smoothing", _CORPUS + "SELECT round(" + _score_sql([f"((a{n} + 0.5::DOUBLE) / (b{n} + 0.5))" for n in range(1, 5)], "h", "r", "a1") + ", 6) AS score FROM t")
def p04(spark, sf):
    return scores.nltk_bleu(pair_stats(spark, sf), method=half_up).select(F.round("score", 6).alias("score"))

"""All runnable queries and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import first_sentence, tokens
from lodestack.operators.dedup import dedup_first
from lodestack.operators.filters import keep_doc
from lodestack.plans import code_queries, score_queries, table_queries, text_queries
from lodestack.plans.derived import table
from lodestack.plans.text_queries import first_sentence_sql, tok

_PARTS = (text_queries, table_queries, score_queries, code_queries)
QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("doc"))
    kept = keep_doc(first_sentence(dedup_first(docs, ["doc"], "doc_id")))
    return kept.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.size(tokens(F.col("doc")))), 6).alias("avg_len"),
        F.max(F.size(tokens(F.col("doc")))).cast("long").alias("max_len"),
    )


QUERIES["flagship_length_stats"] = flagship
SQL["flagship_length_stats"] = (
    "WITH d AS (SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, text FROM documents GROUP BY text), "
    f"c AS ({first_sentence_sql('d', 'doc_id, lang', 'text')}) "
    f"SELECT lang, count(*) AS n, round(avg(len({tok('doc')})), 6) AS avg_len, CAST(max(len({tok('doc')})) AS BIGINT) AS max_len "
    "FROM c WHERE length(doc) >= 3 AND NOT contains(doc, chr(9)) GROUP BY lang"
)

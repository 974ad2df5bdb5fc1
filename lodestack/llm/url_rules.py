"""URL filter by a sort-merge range join over reversed-host keys, in DataFrame functions only.

A host is written with its labels reversed and a dot after each (``www.example.net`` -> ``net.example.www.``), so the
hosts below a rule's host are one interval of keys. These intervals nest, never cross. One sweep over the sorted keys of
rules and pages keeps the stack of rules that are open; the stack at a page holds every rule whose host fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import pieces

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to
    ``?``, ``#`` or the end. A null url and one without ``://`` give two empty texts."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_events(rules: DataFrame) -> DataFrame:
    """Sweep events (key, stack): at the start of a host interval the rules that are then open, at its end those left.

    ``rules``: host, path, action. The stack of a host is found by an equi-join of its suffixes with the rule hosts (a
    host has few labels), so it needs no pass over all rules. Repeated rules count once; of rules with one host and path
    and different actions, ``block`` wins. Rules with a null or empty host fit nothing.
    """
    own = rules.filter("host is not null and host <> '' and path is not null").select(
        F.translate("host", _UPPER, _LOWER).alias("host"), "path", "action"
    )
    own = own.groupBy("host", "path").agg(F.max("action").alias("action"))
    by_host = own.groupBy("host").agg(F.collect_list(F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), "path", F.concat("host", "path").alias("rule"), "action")).alias("rules"))
    labels = F.split("host", r"\.", -1)
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # At the end of an interval the stack of the parent is open again: that of all proper suffixes.
    chain = by_host.select(F.col("host").alias("top"), F.posexplode(suffix).alias("depth", "host")).join(by_host, "host")
    stacks = chain.groupBy("top").agg(
        F.flatten(F.collect_list("rules")).alias("open"),
        F.flatten(F.collect_list(F.when(F.col("depth") > 0, F.col("rules")))).alias("after"),
    )
    key = host_key(F.col("top"))
    start = stacks.select(key.alias("key"), F.lit(1).alias("kind"), F.col("open").alias("stack"))
    # '/' follows '.', so this is the first key behind all hosts below; of ends that meet, the shortest host counts last.
    end = stacks.select(F.concat(F.substr(key, F.lit(1), F.length(key) - 1), F.lit("/")).alias("key"), F.lit(0).alias("kind"), F.col("after").alias("stack"))
    return start.unionAll(end)


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; the longest fitting rule wins (host and path together, then the
    longer host), ``default`` where none fits. Every row gives a row, repeated and null ids too; an empty table gives none.

    The pages are dealt evenly to as many sweeps as the session has shuffle partitions, whatever their hosts, and the
    sweep events go to each; a page carries its url only. The rule list is read by every sweep, as in any merge join.
    """
    n = pieces(pages.sparkSession)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url")).select("page_id", *(c.alias(a) for c, a in zip(split_url(F.col("_url")), ("host", "path"))), "_url")
    rows = rows.select("page_id", "host", "path", host_key(F.col("host")).alias("key"), F.pmod(F.xxhash64("page_id", "_url"), F.lit(n)).alias("sweep"))
    events = rule_events(rules).withColumn("sweep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    both = rows.withColumn("kind", F.lit(2)).unionByName(events, allowMissingColumns=True)
    order = Window.partitionBy("sweep").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("open", F.last("stack", ignorenulls=True).over(order)).filter("kind = 2")
    fits = F.filter("open", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(fits)
    return swept.select("page_id", "host", "path", best.alias("_r")).select(
        "page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.action", F.lit(default)).alias("verdict")
    )

"""Time spans, closed at both ends, at a resolution of one second."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.skew import prefix_scan
from lodestack.session import stage_table

CAP = 1000
STEP_DAYS = 30
FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def is_day(ts: Column) -> Column:
    """Midnight: such a bound is meant as a whole day."""
    return ts == F.date_trunc("day", ts)


def span_text(ts: Column) -> Column:
    return F.date_format(ts, FORMAT)


def query_text(start: Column, end: Column, which: Column) -> Column:
    """A bound as the search wants it: a date when both bounds are days, else date and time."""
    return F.when(is_day(start) & is_day(end), F.date_format(which, "yyyy-MM-dd")).otherwise(span_text(which))


def span_file(start: Column, end: Column) -> Column:
    return F.concat(span_text(start), F.lit("-"), span_text(end), F.lit(".jsonl"))


def _shift(ts: Column, seconds: Column | int) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(ts.cast("timestamp")) + seconds)


def last_second(start: Column, end: Column) -> Column:
    """Inclusive upper bound in seconds: a day-mode span includes its whole last day."""
    return F.when(is_day(start) & is_day(end), _shift(end, 86399)).otherwise(end)


def make_spans(bounds: DataFrame, days: int = STEP_DAYS) -> DataFrame:
    """Spans of ``days`` + 1 calendar days from ``first`` while they start before ``limit``."""
    starts = F.expr(f"explode(sequence(cast(first as timestamp), cast(limit as timestamp), interval {days + 1} days))")
    spans = bounds.select(starts.alias("start"), "limit").filter(F.col("start") < F.col("limit").cast("timestamp"))
    return spans.select("start", F.expr(f"start + interval {days} days").alias("end"))


def cumulative_counts(df: DataFrame, ts: str) -> DataFrame:
    """(day, sec, upto): how many rows of ``df`` fall on or before each second that has any. One pass over the rows.

    Rows are counted per second map-side; a day is summed on its own (86,400 rows at most), days by a calendar of totals.
    """
    seconds = df.groupBy(F.date_trunc("second", F.col(ts).cast("timestamp")).alias("sec")).agg(F.count(F.lit(1)).alias("n"))
    seconds = stage_table(seconds.filter("sec is not null").withColumn("day", F.to_date("sec")), "seconds")
    days = seconds.groupBy("day").agg(F.sum("n").alias("n"))
    calendar = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("day", F.coalesce(F.sum("n").over(calendar), F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("day").orderBy("sec").rowsBetween(Window.unboundedPreceding, 0))
    return seconds.select("day", "sec", inside.alias("inside")).join(before, "day").select("day", "sec", (F.col("before") + F.col("inside")).alias("upto"))


def upto(cumulative: DataFrame, points: DataFrame) -> DataFrame:
    """(at, upto): the cumulative count at each distinct point in time, by as-of look-ups: first within the point's day, for
    points before all seconds of their day from the last day before. Sorted once, no second meets more than one point."""
    asked = points.select(F.to_date("at").alias("day"), F.col("at").alias("sec"), F.lit(None).cast("long").alias("upto"), F.lit(1).alias("kind")).distinct()
    # Of the seconds only the days that are asked for matter, of the others their last count.
    wanted = cumulative.join(asked.select("day").distinct(), "day", "left_semi").select("day", "sec", "upto", F.lit(0).alias("kind"))
    latest = Window.partitionBy("day").orderBy("sec", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = wanted.unionAll(asked).withColumn("upto", F.last("upto", True).over(latest)).filter("kind = 1")
    ends = cumulative.groupBy("day").agg(F.max("upto").alias("end"))
    days = ends.unionAll(asked.select("day", F.lit(None).cast("long"))).groupBy("day").agg(F.max("end").alias("end"))
    calendar = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("day", F.last("end", True).over(calendar).alias("before"))
    return found.join(before, "day").select(F.col("sec").alias("at"), F.coalesce("upto", "before", F.lit(0)).alias("upto"))


def _counted(cumulative: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (start, end, last and others) with ``cnt``, the rows from start to last."""
    ends = F.array(F.struct(_shift(F.col("start"), -1).alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("last").alias("at"), F.lit(1).alias("sign")))
    edges = spans.select(*spans.columns, F.inline(ends))
    at = upto(cumulative, edges.select("at"))
    return edges.join(at, "at").groupBy(*spans.columns).agg(F.sum(F.col("sign") * F.col("upto")).alias("cnt"))


def count_spans(df: DataFrame, ts: str, spans: DataFrame) -> DataFrame:
    """Number of rows per span (start, end): the difference of two cumulative counts. Empty spans count 0."""
    bounded = spans.select("start", "end", last_second(F.col("start"), F.col("end")).alias("last"))
    return _counted(cumulative_counts(df, ts), bounded).select("start", "end", "cnt")


def halves(spans: DataFrame) -> DataFrame:
    """Cut every span (start, end, whole) in two: by whole days, one day into twice twelve hours, other spans by seconds.

    ``whole`` says that the bounds are days; a span of one second at midnight is not.
    """
    start, end, whole = F.col("start"), F.col("end"), F.col("whole")
    seconds = F.unix_timestamp("end") - F.unix_timestamp("start")
    one = whole & (start == end)
    middle = F.when(one, _shift(start, 43200)).when(whole, _shift(start, F.floor(F.floor(seconds / 86400) / 2) * 86400)).otherwise(_shift(start, F.floor(seconds / 2)))
    cut = spans.select(
        "start", middle.alias("_mid"), F.when(whole & ~one, 86400).otherwise(1).alias("_gap"), F.when(one, _shift(start, 86399)).otherwise(end).alias("_stop"), (whole & ~one).alias("whole")
    )
    first = F.struct("start", F.col("_mid").alias("end"), "whole")
    second = F.struct(_shift(F.col("_mid"), F.col("_gap")).alias("start"), F.col("_stop").alias("end"), "whole")
    return cut.select(F.inline(F.array(first, second)))


def split_spans(df: DataFrame, ts: str, spans: DataFrame, cap: int = CAP) -> DataFrame:
    """Halve spans until each holds at most ``cap`` rows or is one second wide (at most about 25 rounds).

    The rows are read once, for the cumulative counts; a round looks up the ends of the open spans.
    """
    cumulative = stage_table(cumulative_counts(df, ts), "cumulative")
    is_whole = is_day(F.col("start")) & is_day(F.col("end"))
    done, open_spans = [], spans.select("start", "end", is_whole.alias("whole"))
    while True:
        last = F.when(F.col("whole"), _shift(F.col("end"), 86399)).otherwise(F.col("end"))
        counted = stage_table(_counted(cumulative, open_spans.withColumn("last", last)).drop("last"), "counted")
        over = (F.col("cnt") > cap) & (F.col("whole") | (F.col("start") < F.col("end")))
        done.append(counted.filter(~over).select("start", "end", "cnt"))
        todo = counted.filter(over)
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done)
        open_spans = halves(todo)


# Caps that one block of running totals spans.
BLOCK_CAPS = 256


def _next_breaks(totals: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """keys, at, next: where the pack that starts at ``at`` ends, that is the first later span whose running total exceeds what
    was there before by more than ``cap`` (null: never). An as-of look-up among running totals, block by block."""
    later = totals.select(*keys, F.col("upto").alias("x"), F.lit(0).alias("kind"), F.col("at").alias("s"))
    asked = totals.select(*keys, (F.col("upto") - F.col("cnt") + cap).alias("x"), F.lit(1).alias("kind"), F.col("at").alias("s"))
    rows = later.unionAll(asked).withColumn("block", F.floor(F.col("x") / (max(cap, 1) * BLOCK_CAPS)))
    first = F.min(F.when(F.col("kind") == 0, F.col("s")))
    inside = first.over(Window.partitionBy(*keys, "block").orderBy(F.desc("x"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    above = F.min("m").over(Window.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy(*keys, "block").agg(first.alias("m")).select(*keys, "block", above.alias("above"))
    return rows.withColumn("inside", inside).filter("kind = 1").join(blocks, [*keys, "block"]).select(*keys, F.col("s").alias("at"), F.coalesce("inside", "above").alias("next"))


def pack_spans(spans: DataFrame, keys: list[str], cap: int = CAP) -> DataFrame:
    """Merge neighbouring spans greedily while the running total stays within ``cap``: keys, start, end, cnt.

    No key is folded in a row: every span looks up where a pack that starts with it would end, and pointer doubling finds in a
    logarithmic number of rounds which spans the packs that begin at the first one really start with. ``start`` is unique per
    key, counts are not negative.
    """
    items = spans.select(*keys, F.unix_timestamp("start").alias("at"), "start", "end", "cnt")
    totals = stage_table(prefix_scan(items, keys, "at", {"upto": ("sum", F.col("cnt"), True)}, bits=20), "totals")
    # A span that is over the cap by itself breaks where it starts, and what follows it, empty spans too, is another pack.
    full = totals.filter(F.col("cnt") > cap).select(*keys, "at")
    fitting = totals.join(full, [*keys, "at"], "left_anti")
    jump = _next_breaks(totals, keys, cap)
    after = prefix_scan(totals.withColumn("_back", -F.col("at")), keys, "_back", {"next": ("min", F.col("at"), False)}, bits=20)
    alone = after.join(full, [*keys, "at"], "left_semi").select(*keys, "at", "next")
    jump = jump.join(fitting.select(*keys, "at"), [*keys, "at"], "left_semi").select(*keys, "at", "next").unionAll(alone)
    jump = stage_table(jump.filter("next is not null"), "jumps")
    starts = stage_table(totals.groupBy(*keys).agg(F.min("at").alias("at")), "starts")
    while not jump.isEmpty():
        reached = jump.join(starts, [*keys, "at"], "left_semi").select(*keys, F.col("next").alias("at"))
        starts = stage_table(starts.unionAll(reached).distinct(), "starts")
        twice = jump.select(*keys, F.col("at").alias("next"), F.col("next").alias("far"))
        jump = stage_table(jump.join(twice, [*keys, "next"]).select(*keys, "at", F.col("far").alias("next")), "jumps")
    marked = totals.join(starts.withColumn("_start", F.col("at")), [*keys, "at"], "left")
    packs = prefix_scan(marked, keys, "at", {"_pack": ("max", F.col("_start"), True)}, bits=20)
    return packs.groupBy(*keys, "_pack").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("cnt").alias("cnt")).drop("_pack")

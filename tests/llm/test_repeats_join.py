import math

from pyspark.sql import functions as F

from lodestack.llm import bwt_dedup
from lodestack.llm.common import only_known


def test_repeated_runs_are_looked_up_not_paired(spark):
    """Runs are kept by a semi join with their groups: one row per copy of a text, however many copies there are."""
    text = "".join(f"w{i * 7919 % 10007} " for i in range(150))
    df = spark.createDataFrame([(i, text) for i in range(30)], "row long, text string")
    ranges = bwt_dedup.repeated_ranges(df)
    runs = ranges.groupBy("row").count().collect()
    assert len(runs) == 30 and len({r["count"] for r in runs}) == 1
    plan = ranges._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join LeftSemi" in line and "run#" in line for line in plan.splitlines())


def test_rows_of_unknown_keys_are_left_out_before_the_shuffle(spark):
    rows = spark.range(-3000, 3000).select((F.col("id") % 2000 * 7919).alias("key"), F.col("id").alias("n")).unionAll(spark.sql("select cast(null as long), 9999L"))
    keys = spark.range(-300, 300).select((F.col("id") * 5 * 7919).alias("key"))
    expected = [n for n in range(-3000, 3000) if n % 5 == 0 and -300 <= math.fmod(n, 2000) / 5 < 300]
    for limit, bits in ((10_000, 27), (10, 27), (10, 15)):
        got = only_known(rows, keys, "key", limit, bits)
        assert got.columns == ["key", "n"]
        assert sorted(r.n for r in got.collect()) == expected
    joined = only_known(rows, keys, "key", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in joined and "LeftSemi" in joined


def test_the_map_is_asked_before_the_look_up(spark):
    """The semi join, and its shuffle, stand above the join with the map; where the map may decide alone there is none."""
    rows = spark.range(20_000).select((F.col("id") * 7919).alias("key"), F.col("id").alias("n"))
    keys = spark.range(300).select((F.col("id") * 5 * 7919).alias("key"))
    lines = only_known(rows, keys, "key", 10)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    semi, marked = (next(i for i, line in enumerate(lines) if word in line) for word in ("LeftSemi", "getbit"))
    assert semi < marked
    loose = only_known(rows, keys, "key", 10, exact=False)
    assert "LeftSemi" not in loose._jdf.queryExecution().optimizedPlan().toString()
    found = {r.n for r in loose.collect()}
    assert found >= set(range(0, 1500, 5)) and len(found) < 6000
    full = only_known(spark.range(20_000).select((F.col("id") * 7919).alias("key")), spark.range(20_000).select((F.col("id") * 7919).alias("key")), "key", 10, 15, exact=False)
    assert "LeftSemi" in full._jdf.queryExecution().optimizedPlan().toString() and full.count() == 20_000

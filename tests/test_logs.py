import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestack.operators import runs, skew, spans, split
from lodestack.operators.skew import rank_cut


def replay(rows, limit=5, evaluated=True):
    """One run, epoch by epoch."""
    best_ppl, best_score, a, b = 1e6, -1.0, 0, 0 if evaluated else 1_000_000
    flags, stop = [], None
    for epoch, ppl, score in rows:
        if ppl < best_ppl:
            a, best_ppl, p = 0, ppl, True
        else:
            a, p = a + 1, False
            if stop is None and a > limit and b > limit:
                stop = epoch
        s = score > best_score
        if s:
            b, best_score = 0, score
        else:
            b += 1
            if stop is None and a > limit and b > limit:
                stop = epoch
        flags.append((epoch, p, s, a, b))
    return flags, stop


@pytest.mark.parametrize("bits", [2, 5, 16])
def test_run_logs_against_replay(spark, bits):
    rng = random.Random(bits)
    data = [(r, e, rng.choice([1, 2, 3, 4, 5]) * 1.0, rng.randint(0, 6) * 1.0) for r in range(4) for e in range(70 if r else 7)]
    log = spark.createDataFrame(data, "run_id long, epoch long, ppl double, score double")
    stalled = runs.patience(runs.best_so_far(log, bits=bits), bits=bits)
    stops = {r.run_id: r.stop_epoch for r in runs.early_stop(stalled).collect()}
    for run in range(4):
        flags, stop = replay([d[1:] for d in data if d[0] == run])
        got = [(r.epoch, r.ppl_improved, r.score_improved, r.ppl_stall, r.score_stall) for r in stalled.filter(F.col("run_id") == run).orderBy("epoch").collect()]
        assert got == flags
        assert stops.get(run) == stop


def test_running_loss(spark):
    steps = spark.createDataFrame([(1, s, 0.5) for s in range(6)], "r long, step long, loss double")
    got = [x.train_loss for x in runs.running_loss(steps, ["r"], accumulate=2, bits=1).orderBy("step").collect()]
    assert got == [round(0.5 * n * 2 / (n + 1), 4) for n in (2, 4, 6)]


def brute_pack(counts, cap):
    out, acc = [], 0
    for c in counts:
        if out and acc + c <= cap:
            acc += c
            out[-1] += c
        else:
            out.append(c)
            acc = c
    return out


@pytest.mark.parametrize("seed,top", [(1, 400), (2, 30), (3, 1500)])
def test_pack_spans(spark, seed, top):
    rng = random.Random(seed)
    keys = {k: [rng.choice([0, rng.randint(0, top), 1000, 1001]) for _ in range(n)] for k, n in enumerate((60, 1, 200, 3))}
    day = lambda i: datetime(2020, 1, 1) + timedelta(days=i)
    rows = [(k, day(i), day(i), c) for k, counts in keys.items() for i, c in enumerate(counts)]
    packed = spans.pack_spans(spark.createDataFrame(rows, "k long, start timestamp, end timestamp, cnt long"), ["k"]).orderBy("k", "start").collect()
    for k, counts in keys.items():
        mine = [r for r in packed if r.k == k]
        assert [r.cnt for r in mine] == brute_pack(counts, 1000)
        assert [r.start for r in mine[1:]] == [r.end + timedelta(days=1) for r in mine[:-1]]
    assert spans.pack_spans(spark.createDataFrame([], "k long, start timestamp, end timestamp, cnt long"), ["k"]).collect() == []


def test_counts_of_spans_at_all_edges(spark):
    rng = random.Random(5)
    base = datetime(2024, 2, 1)
    times = [base + timedelta(seconds=rng.randint(0, 86400 * 9)) for _ in range(300)] + [base, base + timedelta(days=3)] * 4 + [None]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp")
    edges = [base + timedelta(days=d) for d in range(-2, 12)] + [t + timedelta(seconds=x) for t in times[:20] for x in (-1, 0, 1)]
    asked = [(a, b) for a, b in (sorted(rng.sample(edges, 2)) for _ in range(80))] + [(base, base), (times[0], times[0])]
    got = {(r.start, r.end): r.cnt for r in spans.count_spans(df, "ts", spark.createDataFrame(list(set(asked)), "start timestamp, end timestamp")).collect()}
    assert got.keys() == set(asked)
    for (a, b), n in got.items():
        last = b + timedelta(seconds=86399) if (a.hour, a.minute, a.second, b.hour, b.minute, b.second) == (0,) * 6 else b
        assert n == sum(t is not None and a <= t <= last for t in times)


def test_a_second_at_midnight_is_not_a_day(spark):
    times = [datetime(2024, 1, 1)] * 9 + [datetime(2024, 1, 1, 0, 0, 1)] * 9 + [datetime(2024, 1, 1, 5)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp")
    whole = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 1))], "start timestamp, end timestamp")
    out = spans.split_spans(df, "ts", whole, cap=5).collect()
    assert sum(r.cnt for r in out) == 19 and sorted(r.cnt for r in out if r.cnt) == [1, 9, 9]


def test_split_spans_covers_everything_once(spark):
    rng = random.Random(2)
    times = [datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 86400 * 20 - 1)) for _ in range(400)]
    times += [datetime(2024, 1, 5, 12, 0, 7)] * 300  # a burst within one second
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp")
    bounds = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 21))], "first timestamp, limit timestamp")
    out = spans.split_spans(df, "ts", spans.make_spans(bounds), cap=50).collect()
    assert sum(r.cnt for r in out) == len(times)
    wide = [r for r in out if r.cnt > 50]
    assert [(r.start, r.end, r.cnt) for r in wide] == [(datetime(2024, 1, 5, 12, 0, 7),) * 2 + (300,)]
    ends = sorted((r.start, r.end) for r in out)
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_exact_split_and_sample(spark):
    one = split.split_exact(spark.range(1237).repartition(1), "id")
    sizes = {r.split: r["count"] for r in one.groupBy("split").count().collect()}
    assert sizes == {"train": 989, "valid": 123, "test": 125}
    many = split.split_exact(spark.range(1237).repartition(64), "id")
    assert one.exceptAll(many).count() == 0
    assert split.sample_exact(spark.range(1237), "id", share=0.1).count() == 123
    assert split.sample_exact(spark.range(30), "id", n=5000).count() == 30
    tiny = {r.split: r["count"] for r in split.split_exact(spark.range(5), "id").groupBy("split").count().collect()}
    assert tiny == {"train": 4, "test": 1}


@pytest.mark.parametrize("few", [0, 30, 10_000])
def test_radix_ranks_of_shared_prefixes(spark, monkeypatch, few):
    """Digests that agree in many digits go down several levels."""
    monkeypatch.setattr(skew, "FEW", few)
    rng = random.Random(3)
    digests = sorted({"0" * rng.choice([0, 4, 9, 30, 31]) + f"{rng.getrandbits(128):032x}" for _ in range(400)}, key=lambda d: d[:32])
    digests = sorted({d[:32] for d in digests})
    rows = spark.createDataFrame([(d,) for d in digests], "h string").repartition(7)
    ranks = [0, 1, 2, 150, len(digests) - 1, len(digests), len(digests) + 1]
    cuts = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(rank_cut(rows, "h", lambda n: [r if r < 10**6 else n for r in ranks]))]).first()
    assert list(cuts) == [digests[r - 1] if 1 <= r <= len(digests) else None for r in ranks]
    assert split.sample_exact(spark.range(0), "id", n=3).count() == 0


def test_groups_stay_together(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 500).cast("string").alias("g"))
    out = split.split_by_group(rows, "g")
    assert out.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    sizes = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert 0.7 < sizes["train"] / 4000 < 0.9 and sizes["valid"] > 200 and sizes["test"] > 200

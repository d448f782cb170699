"""Order-dependent primitives against brute force, with blocks small enough to be crossed."""

import random

import pytest
from pyspark.sql import functions as F

from counterlake.model import SnapshotSpec
from counterlake.operators.delta import counter_delta
from counterlake.operators.ticks import asof_join, previous_present, previous_tick


def history(seed):
    """Objects with gaps, missing sizes and long runs of missing sizes."""
    rng = random.Random(seed)
    rows = []
    for obj in range(12):
        present = 0.97 if obj < 6 else 0.6
        missing = 0.85 if obj % 3 == 0 else 0.3
        for tick in range(1, 60):
            if rng.random() < present:
                size = None if rng.random() < missing else rng.randrange(1000)
                rows.append((1, tick, obj, rng.randrange(100), size))
    return rows


@pytest.mark.parametrize("block", [1, 3, 8, 256])
def test_previous_tick_and_carry(spark, block):
    rows = history(block)
    df = spark.createDataFrame(rows, "server_id int, sample_id int, obj int, v int, size int")
    got = {(r.obj, r.sample_id): r for r in previous_tick(
        df, ("server_id", "obj"), ("v", "size"), carry=("size",), block=block).collect()}
    assert len(got) == len(rows)
    by_key = {(o, t): (v, s) for _, t, o, v, s in rows}
    carried = {}
    for _, t, o, _v, s in sorted(rows):
        carried[o, t] = s if s is not None else carried.get((o, t - 1))
    for (o, t), row in got.items():
        assert row.size_carried == carried[o, t]
        before = by_key.get((o, t - 1))
        if before is None:
            assert row.prev is None
        else:
            assert (row.prev.v, row.prev.size) == (before[0], carried[o, t - 1])


@pytest.mark.parametrize("block", [64, 100, 256])
def test_carry_over_blocks_of_several_words(spark, block):
    """Long histories: measurements are rare and gaps fall anywhere, also at the ends of blocks."""
    rng = random.Random(block)
    rows = []
    for obj, (gaps, measured) in enumerate([(0, 0.004), (0.003, 0.006), (0.01, 0.02), (0.003, 0), (0.3, 0.3)]):
        edges = {block * n + d for n in range(9) for d in (-1, 0)} if obj == 2 else ()
        rows += [(obj, t, rng.randrange(99) if rng.random() < measured else None)
                 for t in range(900) if rng.random() >= gaps and not (t in edges and rng.random() < 0.3)]
    df = spark.createDataFrame(rows, "obj int, sample_id int, size int")
    carried = {}
    for o, t, s in rows:
        carried[o, t] = s if s is not None else carried.get((o, t - 1))
    got = previous_tick(df, ("obj",), ("size",), carry=("size",), block=block).collect()
    assert {(r.obj, r.sample_id): r.size_carried for r in got} == carried


@pytest.mark.parametrize("block", [1, 5, 256])
def test_previous_present_spans_gaps(spark, block):
    rows = history(7)
    df = spark.createDataFrame(rows, "server_id int, sample_id int, obj int, v int, size int")
    got = previous_present(df, ("obj",), ("v", "size"), block=block).collect()
    last = {}
    expected = {}
    for _, t, o, v, s in sorted(rows, key=lambda r: (r[2], r[1])):
        expected[o, t] = last.get(o)
        last[o] = (v, s)
    for r in got:
        assert (tuple(r.prev) if r.prev else None) == expected[r.obj, r.sample_id]


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_asof_join(spark, width):
    rng = random.Random(3)
    left = [(k, i, rng.randrange(500)) for k in "ab" for i in range(80)]
    right = [(k, t, t * 10) for k in "ab" for t in rng.sample(range(500), 25)]
    ldf = spark.createDataFrame(left, "k string, i int, t int").withColumn(
        "at", F.timestamp_seconds("t"))
    rdf = spark.createDataFrame(right, "k string, t int, p int").withColumn(
        "since", F.timestamp_seconds("t"))
    got = {(r.k, r.i): r.p for r in asof_join(ldf, rdf, ("k",), "at", "since", ("p",),
                                              width).collect()}
    for k, i, t in left:
        known = [(rt, p) for rk, rt, p in right if rk == k and rt <= t]
        assert got[k, i] == (max(known)[1] if known else None)


SPEC = SnapshotSpec("x", ("obj",), ("c",), {"size": "growth"}, epoch="epoch")


def test_delta_cases(spark):
    rows = [
        (1, 1, 1, 10, 5, "a"),    # first tick: full value
        (1, 2, 1, 15, 7, "a"),    # normal tick
        (1, 3, 1, 4, 9, "b"),     # epoch change: counter restarts, growth continues
        (1, 4, 1, 6, 9, None),    # unknown epoch: full value
        (1, 5, 1, 8, 9, None),
        (1, 7, 1, 20, 12, "c"),   # missing tick: full value
        (1, 7, 2, 3, 1, "c"),     # new object
    ]
    df = spark.createDataFrame(rows, "server_id int, sample_id int, obj int, c long, size long, "
                                     "epoch string")
    got = {(r.obj, r.sample_id): (r.c, r.growth) for r in counter_delta(df, SPEC).collect()}
    assert got == {(1, 1): (10, 5), (1, 2): (5, 2), (1, 3): (4, 2), (1, 4): (6, 9),
                   (1, 5): (8, 9), (1, 7): (20, 12), (2, 7): (3, 1)}
    same = {(r.obj, r.sample_id): r.c
            for r in counter_delta(df, SPEC, null_epoch="same").collect()}
    assert same[1, 5] == 2
    null = {(r.obj, r.sample_id): r.c
            for r in counter_delta(df, SPEC, first_tick="null").collect()}
    assert null[1, 1] is None and null[1, 7] is None and null[1, 3] == 4


def test_increments_of_an_epoch_sum_to_its_last_value(spark):
    rows = [(1, t, o, 3 * t + o, t, "e") for o in range(5) for t in range(1, 40)]
    df = spark.createDataFrame(rows, "server_id int, sample_id int, obj int, c long, size long, "
                                     "epoch string")
    sums = counter_delta(df, SPEC, block=4).groupBy("obj").agg(F.sum("c").alias("s")).collect()
    assert {r.obj: r.s for r in sums} == {o: 3 * 39 + o for o in range(5)}

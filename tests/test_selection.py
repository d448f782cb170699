"""Top-k selection against the literal form, and the plans it produces."""

import random

from counterlake.operators import topk
from counterlake.operators.topk import Metric, rank_long, ranked, top_keys


def frame(spark, n=400):
    rng = random.Random(1)
    rows = [(t, o, rng.randrange(30), rng.choice([None, rng.random()]))
            for t in (1, 2) for o in range(n)]
    return rows, spark.createDataFrame(rows, "g int, obj int, a long, b double")


METRICS = (Metric("a", "a"), Metric("b", "b", exact=False, keep="b IS NOT NULL"))


def literal(rows, k):
    keep = set()
    for g in {r[0] for r in rows}:
        group = [r for r in rows if r[0] == g]
        for value, need in ((2, False), (3, True)):
            order = sorted(group, key=lambda r: (r[value] is None, -(r[value] or 0), r[1]))
            keep |= {(g, r[1]) for r in order[:k] if not (need and r[value] is None)}
    return keep


def test_union_of_top_k_equals_literal_form(spark):
    rows, df = frame(spark)
    got = {(r.g, r.obj) for r in top_keys(df, ("g",), ("obj",), METRICS, 7).collect()}
    assert got == literal(rows, 7)


def test_large_k_takes_the_salted_path(spark, monkeypatch):
    rows, df = frame(spark)
    monkeypatch.setattr(topk, "GROUP_LIMIT", 5)
    got = {(r.g, r.obj) for r in top_keys(df, ("g",), ("obj",), METRICS, 50).collect()}
    assert got == literal(rows, 50)


def test_plan_limits_before_the_shuffle(spark):
    _, df = frame(spark)
    plan = rank_long(df, ("g",), ("obj",), METRICS, 7)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "SinglePartition" not in plan
    assert "Partial" in plan or "partial" in plan or plan.count("WindowGroupLimit") >= 2


def test_ranked_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(1, o, 5) for o in range(9)], "g int, obj int, v int")
    got = [r.obj for r in ranked(df, ["g"], "v DESC, obj", ["obj"], 3).orderBy("rank").collect()]
    assert got == [0, 1, 2]

"""Every ranking keeps the object that was made for it, and dictionaries aggregate by hashing."""

import pytest

from counterlake.operators import dictionary, marking
from counterlake.operators.topk import top_keys

# by hand: object -> the columns in which it leads; everything else is zero
WINNERS = {
    "FUNCTION_METRICS": {1: {"calls": 9}, 2: {"total_time": 9.0}, 3: {"self_time": 9.0}},
    "INDEX_METRICS": {1: {"idx_blks_read": 9}, 2: {"idx_blks_hit": 99}, 3: {"table_dml": 9}, 4: {"table_vacuums": 3, "relsize_carried": 10}},
    "TABLE_METRICS": {
        1: {"seq_scan": 2, "relsize": 100}, 2: {"n_tup_ins": 90}, 3: {"n_tup_upd": 20, "n_tup_del": 20}, 4: {"heap_blks_read": 2, "tidx_blks_read": 7},
        5: {"toast_blks_hit": 500}, 6: {"n_dead_tup": 5}, 7: {"n_mod_since_analyze": 5}, 8: {"autovacuum_count": 3}, 9: {"analyze_count": 3}},
    "STATEMENT_METRICS": {
        1: {"calls": 9}, 2: {"total_plan_time": 50.0}, 3: {"total_exec_time": 60.0}, 4: {"total_plan_time": 40.0, "total_exec_time": 40.0},
        5: {"shared_blks_hit": 99}, 6: {"shared_blks_read": 50}, 7: {"shared_blks_dirtied": 9}, 8: {"shared_blks_written": 9},
        9: {"temp_blks_read": 9}, 10: {"local_blks_written": 9}, 11: {"blk_write_time": 9.0}, 12: {"wal_bytes": 9}},
    "USAGE_METRICS": {1: {"plan_system_time": 9.0}, 2: {"exec_user_time": 9.0}, 3: {"plan_reads": 9, "plan_user_time": 1.0}, 4: {"exec_writes": 9}},
}
ALWAYS = {"TABLE_METRICS": {"n_live_tup": 10}}
SIDE = ("seq_scan", "n_tup_ins", "n_tup_upd", "n_tup_del", "relsize")


@pytest.mark.parametrize("kind", WINNERS)
def test_each_ranking_keeps_its_object(spark, kind):
    metrics, winners = getattr(marking, kind), WINNERS[kind]
    assert len(metrics) == len(winners)
    names = sorted({c for w in winners.values() for c in w} | set(ALWAYS.get(kind, {})))
    extra = {"INDEX_METRICS": ["idx_scan", "total_scans"], "USAGE_METRICS": ["exec_system_time", "exec_reads", "plan_writes"]}
    names += [c for c in extra.get(kind, []) if c not in names]
    if kind == "TABLE_METRICS":
        names += [c for k in ("heap", "idx", "toast", "tidx") for c in (f"{k}_blks_read", f"{k}_blks_hit") if c not in names]
        names += [c for c in ("vacuum_count", "autoanalyze_count") if c not in names]
    if kind == "STATEMENT_METRICS":
        names += ["local_blks_read", "temp_blks_written", "blk_read_time"]
    real = {c for c in names if "time" in c}
    objects = {**winners, 90: {}, 91: {}}
    rows = [(1, o, *[{**ALWAYS.get(kind, {}), **w}.get(c, 0.0 if c in real else 0) for c in names]) for o, w in objects.items()]
    df = spark.createDataFrame(rows, "g int, obj int, " + ", ".join(f"{c} {'double' if c in real else 'long'}" for c in names))
    if kind == "TABLE_METRICS":
        df = df.selectExpr("*", "CAST(NULL AS struct<" + ",".join(f"{c}:bigint" for c in SIDE) + ">) AS side")
    got = {r.obj for r in top_keys(df, ("g",), ("obj",), metrics, 1).collect()}
    assert got - {1} == set(winners) - {1}  # object 1 may also win rankings that no object leads


def test_dictionaries_take_the_newest_names_by_hashing(spark):
    rows = [(1, 1, 7, "a", None), (1, 2, 7, "b", "x"), (1, 3, 7, "a", None), (1, 1, 8, "c", "y"), (2, 1, 7, None, "z")]
    history = spark.createDataFrame(rows, "server_id int, sample_id int, obj int, name string, more string")
    samples = history.select("server_id", "sample_id").distinct()
    found = dictionary.from_history(history, ("server_id", "obj"), ("name", "more"), samples)
    assert sorted(map(tuple, found.collect()), key=str) == [
        (1, 7, "a", None, None), (1, 8, "c", "y", 1), (2, 7, None, "z", None)]
    renamed = dictionary.propagate_names(history, ("server_id", "obj"), "name")
    assert {(r.server_id, r.obj, r.name) for r in renamed.collect()} == {(1, 7, "a"), (1, 8, "c"), (2, 7, None)}
    for df in (found, renamed):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan and "max_by" not in plan
    none = history.limit(0)
    assert dictionary.from_history(none, ("server_id", "obj"), ("name",), samples).count() == 0

"""A stream cut into many batches gives the batch result; late rows are set aside; a batch played again changes nothing."""

import uuid
from datetime import datetime, timedelta

import pytest

from counterlake.model import SnapshotSpec
from counterlake.operators.delta import counter_delta
from counterlake.operators.settings import COMPARED, SETTING_KEY, STORED, capture_changes
from counterlake.streaming import deltas
from counterlake.streaming.ledger import Ledger
from fixtures.stream_queries import as_stream, drain

SPEC = SnapshotSpec("x", ("obj",), ("c",), {"size": "growth"}, carry=("size",), epoch="epoch")
SCHEMA = "server_id int, sample_id int, obj int, c long, size long, epoch timestamp"
BIG = 2**60 + 1  # above what a double holds exactly
EARLY, LATER = datetime(2024, 1, 1), datetime(2024, 1, 6, 12)
ROWS = [(1, t, o, BIG + t * 5 + o, None if t % 3 == 0 else t * 7, EARLY if t < 6 else LATER)
        for t in range(1, 11) for o in range(6) if not (o == 2 and t == 4)]
CUTS = ((1, 3), (4, 4), (5, 8), (9, 10))
LATE = [(1, 2, 0, 999, 999, EARLY), (1, 10, 1, 5, 5, LATER), (1, None, 1, 5, 5, LATER)]
COLUMNS = ["server_id", "sample_id", "obj", "c", "size", "growth"]


def parts(spark, path, groups, schema):
    for rows in groups:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return as_stream(spark.read.schema(schema).parquet(path), files_per_trigger=1)


def rows_of(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_stream_equals_batch_over_many_triggers(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    groups = [[r for r in ROWS if low <= r[1] <= high] for low, high in CUTS]
    ledger = drain(parts(spark, path, [*groups, LATE], SCHEMA), deltas.counter_deltas(SPEC, block=4))
    want = counter_delta(spark.createDataFrame(ROWS, SCHEMA), SPEC, block=4)
    assert rows_of(ledger.read("increments"), COLUMNS) == rows_of(want, COLUMNS)
    assert rows_of(ledger.read("late"), ["obj", "c"]) == rows_of(spark.createDataFrame(LATE, SCHEMA), ["obj", "c"])
    assert ledger.read("state").count() == 6 and len(ledger.batches()) == 5


def test_a_batch_played_again_changes_nothing(spark, tmp_path):
    ledger, step = Ledger(spark, f"{tmp_path}/ledger"), deltas.counter_deltas(SPEC)
    batches = [spark.createDataFrame([r for r in ROWS if low <= r[1] <= high], SCHEMA) for low, high in CUTS]
    for n, batch in enumerate(batches[:2]):
        ledger.apply(batch, n, step)

    def broken(batch, stored, hold):
        tables = step(batch, stored, hold)
        tables["state"] = tables["state"].selectExpr("*", "CAST(raise_error('lost') AS int) AS x")
        return tables

    with pytest.raises(Exception):  # the increments are written, the state is not
        ledger.apply(batches[2], 2, broken)
    assert ledger.batches() == [0, 1]
    before = rows_of(ledger.read("increments"), COLUMNS)
    assert len(before) == len([r for r in ROWS if r[1] <= 4])
    for n, batch in ((2, batches[2]), (2, batches[2]), (1, batches[1]), (3, batches[3]), (3, batches[3])):
        ledger.apply(batch, n, step)
    want = counter_delta(spark.createDataFrame(ROWS, SCHEMA), SPEC)
    assert rows_of(ledger.read("increments"), COLUMNS) == rows_of(want, COLUMNS)


def test_steps_run_without_python(spark):
    batch = spark.createDataFrame(ROWS[:4], SCHEMA)
    first = deltas.counter_deltas(SPEC)(batch, lambda name: None, lambda rows: rows)
    again = deltas.counter_deltas(SPEC, keep_ticks=3)(batch, first.get, lambda rows: rows)
    for tables in (first, again):
        for df in tables.values():
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert again["increments"].count() == 0 and again["late"].count() == 4


def test_objects_that_stop_reporting_leave_the_state(spark, tmp_path):
    ledger, step = Ledger(spark, f"{tmp_path}/ledger"), deltas.counter_deltas(SPEC, keep_ticks=2)
    ledger.apply(spark.createDataFrame([(1, 1, 7, 5, 1, EARLY), (1, 1, 8, 5, 1, EARLY)], SCHEMA), 0, step)
    ledger.apply(spark.createDataFrame([(1, 3, 8, 9, 1, EARLY)], SCHEMA), 1, step)
    ledger.apply(spark.createDataFrame([], SCHEMA), 2, step)
    assert [r.obj for r in ledger.read("state").collect()] == [8]


def test_setting_changes_equal_the_batch_log(spark, tmp_path):
    schema = ("server_id int, sample_id int, sample_time timestamp, setting_scope int, name string, setting string, reset_val string,"
              " boot_val string, unit string, sourcefile string, sourceline int, pending_restart boolean")
    values = ["a", "a", "b", None, "b", "c", "c", "a"]
    rows = [(1, t, EARLY + timedelta(hours=t), 1, n, v, v, "0", None if t < 5 else "kB", "f", t // 4, False)
            for n in ("x", "y") for t, v in enumerate(values) if (n, t) != ("y", 0)]
    groups = [[r for r in rows if low <= r[1] < low + 2] for low in range(0, 8, 2)] + [rows[:1]]
    ledger = drain(parts(spark, f"{tmp_path}/settings", groups, schema), deltas.setting_changes(block=2))
    want = capture_changes(spark.createDataFrame(rows, schema), refresh_on_version=False)
    columns = [*SETTING_KEY, "first_seen", *STORED]
    assert set(COMPARED) <= set(STORED) and rows_of(ledger.read("changes"), columns) == rows_of(want, columns)
    assert ledger.read("late").count() == 1


def test_every_row_is_in_a_window_or_set_aside(spark, tmp_path):
    schema = "id int, at timestamp, k string, v long"
    at = lambda h: None if h is None else EARLY + timedelta(hours=h)
    hours = [[0, 1, 5, 11], [13, 2, 25], [3, 24, 14], [50, 30], [26, 49, 12, None], [47, 51]]
    rows = [[(10 * n + i, at(h), "ab"[i % 2], 2**54 + i) for i, h in enumerate(batch)] for n, batch in enumerate(hours)]
    step = deltas.window_sums("at", ("k",), ("v", "one"), "12 hours", "6 hours")
    stream = parts(spark, f"{tmp_path}/windows", rows, schema).selectExpr("*", "1L AS one")
    ledger = drain(stream, step, states=("open", "latest"))
    # by hand: the newest time before each batch, less six hours
    late, sums, newest = set(), {}, None
    for batch in rows:
        for key, when, k, v in batch:
            start = None if when is None else EARLY + timedelta(hours=12 * int((when - EARLY).total_seconds() // 43_200))
            if when is None or (newest is not None and start + timedelta(hours=12) <= newest - timedelta(hours=6)):
                late.add(key)
            else:
                total = sums.setdefault((start, k), [0, 0])
                total[0] += v
                total[1] += 1
        newest = max([w for _, w, _, _ in batch if w is not None] + ([newest] if newest else []))
    closed, open_ = ledger.read("closed").collect(), ledger.read("open").collect()
    got = {(r.window_start, r.k): [r.v, r.one] for r in [*closed, *open_]}
    assert got == sums and len(got) == len(closed) + len(open_)
    assert {r.id for r in ledger.read("late").collect()} == late and late
    assert all(r.window_end <= newest - timedelta(hours=6) for r in closed) and closed and open_

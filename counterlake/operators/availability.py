"""Which statistics an interval has: one aggregate row per server and interval."""

from __future__ import annotations

from pyspark.sql import DataFrame

from counterlake.model import SERVER, TICK, Interval, Repository, grouped, tag_intervals

SESSION_COLUMNS = ("session_time", "active_time", "idle_in_transaction_time", "sessions",
                   "sessions_abandoned", "sessions_fatal", "sessions_killed")
JIT_COUNTS = ("jit_functions", "jit_inlining_count", "jit_optimization_count",
              "jit_emission_count")
GROUP = (SERVER, "interval_no")


def _flag(condition: str, name: str) -> str:
    return f"coalesce({condition}, false) AS {name}"


def _total(column: str) -> str:
    return f"coalesce(sum({column}), 0)"


def _features(df: DataFrame, intervals: list[Interval], flags: list[str]) -> DataFrame:
    return grouped(tag_intervals(df, intervals), GROUP, flags)


def statements_available(samples: DataFrame, totals: DataFrame,
                         intervals: list[Interval]) -> DataFrame:
    """Every sample of the interval has statement totals."""
    measured = totals.select(SERVER, TICK).distinct().selectExpr("*", "1 AS _has")
    rows = samples.select(SERVER, TICK).join(measured, [SERVER, TICK], "left")
    return _features(rows, intervals, ["count(*) = count(_has) AS statements"])


def statement_features(totals: DataFrame, intervals: list[Interval]) -> DataFrame:
    """Planning times, WAL and JIT of statements."""
    jit = " + ".join(_total(c) for c in JIT_COUNTS)
    return _features(totals, intervals, [
        _flag("sum(total_plan_time) > 0", "planning_times"),
        _flag("sum(wal_bytes) > 0", "statement_wal"), _flag(f"{jit} > 0", "jit")])


def database_features(databases: DataFrame, intervals: list[Interval]) -> DataFrame:
    """IO timing and session statistics."""
    times = f"{_total('blk_read_time')} + {_total('blk_write_time')} > 0"
    sessions = " OR ".join(f"count({c}) > 0" for c in SESSION_COLUMNS)
    return _features(databases, intervals, [_flag(times, "io_times"),
                                            f"({sessions}) AS sessions"])


def wal_available(wal: DataFrame, intervals: list[Interval]) -> DataFrame:
    return _features(wal, intervals, ["count(wal_bytes) > 0 AS wal"])


def waits_available(waits: DataFrame, intervals: list[Interval]) -> DataFrame:
    return _features(waits, intervals, ["count(*) > 0 AS waits"])


def functions_available(totals: DataFrame, intervals: list[Interval]) -> DataFrame:
    return _features(totals, intervals, [
        _flag("sum(calls) > 0", "functions"),
        _flag("sum(CASE WHEN trg_fn THEN calls END) > 0", "trigger_functions")])


def usage_available(totals: DataFrame, intervals: list[Interval]) -> DataFrame:
    """CPU use is positive in every sample of the interval (execution; planning)."""
    per_tick = grouped(tag_intervals(totals, intervals), (*GROUP, TICK), [
        "sum(exec_user_time) > 0 AS _exec", "sum(plan_user_time) > 0 AS _plan"])
    lengths = " ".join(f"WHEN {n} THEN {i.end - i.start}" for n, i in enumerate(intervals, 1))
    expected = f"CASE interval_no {lengths} END"
    return grouped(per_tick, GROUP, [f"count_if(_exec) = {expected} AS usage_exec",
                                     f"count_if(_plan) = {expected} AS usage_plan"])


def features(repo: Repository, intervals: list[Interval]) -> DataFrame:
    """All predicates, one row per server and interval; missing tables give False."""
    base = tag_intervals(repo.samples.select(SERVER, TICK), intervals).select(*GROUP).distinct()
    parts = []
    if repo.statement_totals is not None:
        parts += [statements_available(repo.samples, repo.statement_totals, intervals),
                  statement_features(repo.statement_totals, intervals)]
    if repo.databases is not None:
        parts.append(database_features(repo.databases, intervals))
    if repo.wal is not None:
        parts.append(wal_available(repo.wal, intervals))
    if repo.waits is not None:
        parts.append(waits_available(repo.waits, intervals))
    if repo.function_totals is not None:
        parts.append(functions_available(repo.function_totals, intervals))
    if repo.usage_totals is not None:
        parts.append(usage_available(repo.usage_totals, intervals))
    for part in parts:
        base = base.join(part, list(GROUP), "left")
    return base.selectExpr(*GROUP, *[_flag(c, c) for c in base.columns if c not in GROUP])

"""Report sections as declarations over interval relations.

A ranked section names its relation, key, columns and order; ``single_section`` and
``diff_section`` turn that into a plan. Both read the facts once, whatever the number of
intervals, and rank per server, so one job serves all servers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterlake.functions.text import short_hash, size_pretty
from counterlake.model import (SERVER, TICK, Interval, Repository, grouped, pct, ratio, scan, sums,
                               tag_intervals, zero)
from counterlake.operators import stats
from counterlake.operators.availability import JIT_COUNTS, SESSION_COLUMNS
from counterlake.operators.intervals import durations
from counterlake.operators.topk import Metric, ranked, top_rows

Relation = Callable[[Repository, list[Interval]], DataFrame]


@dataclass(frozen=True)
class Section:
    """One ranked listing.

    order       Spark SQL expressions, largest first; the key breaks ties
    where       rows that take part
    chosen_by   when set, a row is listed if any of these metrics ranks within top-n
                (``where`` is then applied after ranking)
    diff_by     metric compared between two intervals (default: the first of ``order``)
    diff_order  metric whose sum orders the comparison (default: the first of ``order``)
    diff_where  SQL over columns suffixed _1 and _2; default: the summed order metric is > 0
    diff_sum    compare by the sum only (top-n of the sum instead of top-n of either)
    diff        the section has a two-interval form
    """

    id: str
    title: str
    relation: str
    key: tuple[str, ...]
    labels: tuple[str, ...]
    values: tuple[str, ...]
    order: tuple[str, ...]
    where: str = "true"
    chosen_by: tuple[str, ...] = ()
    diff_by: str | None = None
    diff_order: str | None = None
    diff_where: str | None = None
    diff_sum: bool = False
    diff: bool = True


# --- relations that add something to the interval relations -------------------------------

def _at_end(facts: DataFrame, intervals: list[Interval], key: Sequence[str],
            columns: Sequence[str]
            ) -> DataFrame:
    """Gauges at the last sample of each interval."""
    return _ends_of(facts, intervals).selectExpr("interval_no", SERVER, *key, *columns)


def _ends_of(facts: DataFrame, intervals: list[Interval]) -> DataFrame:
    """Rows of the last samples, read from the blocks of those samples only."""
    return tag_intervals(facts, [Interval(i.end - 1, i.end, i.server_ids) for i in intervals])


_SIZE = ("relsize", "relpages_bytes")


def _tables_with_size(repo: Repository, intervals: list[Interval]) -> DataFrame:
    own = _at_end(repo.tables, intervals, ("datid", "relid"), (*_SIZE, "true AS at_end"))
    side = _at_end(repo.tables, intervals, ("datid",),
                   ("relid AS reltoastrelid", *[f"{c} AS side_{c}" for c in _SIZE]))
    on = ["interval_no", SERVER, "datid"]
    return (stats.top_tables(repo, intervals).join(own, [*on, "relid"], "left")
            .join(side, [*on, "reltoastrelid"], "left"))


def _indexes_with_size(repo: Repository, intervals: list[Interval]) -> DataFrame:
    own = _at_end(repo.indexes, intervals, ("datid", "indexrelid"), (*_SIZE, "true AS at_end"))
    rows = stats.top_indexes(repo, intervals).join(
        own, ["interval_no", SERVER, "datid", "indexrelid"], "left")
    return rows.selectExpr("*", "tbl_n_tup_upd - coalesce(tbl_n_tup_hot_upd, 0) AS tbl_n_ind_upd")


def tables_at_end(repo: Repository, intervals: list[Interval],
                  min_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """Live, dead and modified rows at the end of the interval, of tables above ``min_bytes``."""
    users = _ends_of(repo.databases, intervals).filter("NOT datistemplate").selectExpr(
        "interval_no", SERVER, "datid", "datname AS dbname")
    facts = _ends_of(repo.tables, intervals).filter(
        f"coalesce(relsize, relpages_bytes) > {min_bytes}").join(
        users, ["interval_no", SERVER, "datid"])
    rows = facts.selectExpr(
        "interval_no", SERVER, "datid", "relid", "dbname", "tablespaceid", "n_live_tup",
        "n_dead_tup", "n_mod_since_analyze", *_SIZE, "relkind",
        *[(f"date_format({c}, 'yyyy-MM-dd HH:mm:ss')" if c in repo.tables.columns else "CAST(NULL AS STRING)") + f" AS {c}"
          for c in ("last_autovacuum", "last_autoanalyze")],
        "nullif(coalesce(n_live_tup, 0) + coalesce(n_dead_tup, 0), 0) AS n_tup")
    rows = rows.selectExpr("*", "n_dead_tup * 100 div n_tup AS dead_pct",
                           "n_mod_since_analyze * 100 div n_tup AS mods_pct").drop("n_tup")
    return stats.table_names(rows, repo)


def _wait_shares(repo: Repository, intervals: list[Interval]) -> DataFrame:
    waits = stats.wait_stats_ms(repo, intervals)
    totals = grouped(waits, stats.SPAN, [f"sum({c}) AS all_{c}" for c in stats.WAIT_TIMES])
    shares = waits.join(totals, list(stats.SPAN)).selectExpr(
        *waits.columns, *[f"{pct(c, f'all_{c}')} AS {c}_pct" for c in stats.WAIT_TIMES])
    return stats.in_seconds(shares, stats.WAIT_TIMES)


RELATIONS: dict[str, Relation] = {
    "statements": stats.top_statements,
    "statements_by_text": lambda r, i: stats.top_statements(r, i, by_text=True),
    "usage": stats.top_usage,
    "usage_by_text": lambda r, i: stats.top_usage(r, i, by_text=True),
    "tables": _tables_with_size,
    "indexes": _indexes_with_size,
    "io_tables": stats.top_io_tables,
    "io_indexes": stats.top_io_indexes,
    "functions": stats.top_functions,
    "trigger_functions": lambda r, i: stats.top_functions(r, i, trigger=True),
    "waits": _wait_shares,
    "tables_at_end": tables_at_end,
}


# --- declarations ------------------------------------------------------------------------

STMT = ("queryid", "toplevel", "datid", "userid")
STMT_LABELS = ("dbname", "username")
TABLE = ("datid", "relid")
TABLE_LABELS = ("dbname", "tablespacename", "schemaname", "relname")
INDEX = ("datid", "relid", "indexrelid")
INDEX_LABELS = (*TABLE_LABELS, "indexrelname")
FUNC = ("datid", "funcid")
FUNC_LABELS = ("dbname", "schemaname", "funcname", "funcargs")
_ROW_CHANGES = ("n_tup_ins", "n_tup_upd", "n_tup_del", "n_tup_hot_upd")
_SIDE_CHANGES = tuple(f"side_{c}" for c in _ROW_CHANGES)


def _sum0(*columns: str) -> str:
    return " + ".join(f"coalesce({c}, 0)" for c in columns)


def _stmt(id: str, title: str, values: tuple[str, ...], order: tuple[str, ...], where: str,
          **more) -> Section:
    return Section(id, title, more.pop("relation", "statements"), STMT, STMT_LABELS, values,
                   order, where, **more)


_DML = _sum0("n_tup_ins", "n_tup_upd", "n_tup_del",
             "side_n_tup_ins", "side_n_tup_upd", "side_n_tup_del")
_UPD_DEL = _sum0("n_tup_upd", "n_tup_del", "side_n_tup_upd", "side_n_tup_del")
_SCANNED = _sum0("best_scan_bytes", "best_side_scan_bytes")
_SCANNED_SIZED = _sum0("scan_bytes_by_size", "side_scan_bytes_by_size")
_TEMP = _sum0("temp_blks_read", "temp_blks_written", "local_blks_read", "local_blks_written")
_FUNC_VALUES = ("calls", "total_time", "self_time", "m_time", "m_stime")
_FETCHED = "coalesce(blks_fetch, 0)"
_READ = "coalesce(blks_read, 0)"
_INDEX_DML = _sum0("tbl_n_tup_ins", "tbl_n_tup_upd", "tbl_n_tup_del")

SECTIONS: tuple[Section, ...] = (
    Section("q9_all", "Wait events", "waits", ("event_type", "event"), (),
            ("tot_waited", "tot_waited_pct"), ("tot_waited",), "tot_waited > 0",
            diff_sum=True),
    Section("q9_stmt", "Wait events of statements", "waits", ("event_type", "event"), (),
            ("stmt_waited", "stmt_waited_pct"), ("stmt_waited",), "stmt_waited > 0",
            diff_sum=True),
    _stmt("q10", "Statements by elapsed time",
          ("total_time", "total_time_pct", "total_plan_time", "total_exec_time",
           "blk_read_time", "blk_write_time", "user_time", "system_time", "calls", "plans"),
          ("total_time",), "true", diff_where="true"),
    _stmt("q11", "Statements by planning time",
          ("plans", "total_plan_time", "plan_time_pct", "min_plan_time", "max_plan_time",
           "mean_plan_time", "stddev_plan_time", "total_exec_time", "calls"),
          ("total_plan_time", "total_exec_time"), "true", diff_where="true"),
    _stmt("q12", "Statements by execution time",
          ("calls", "total_exec_time", "total_exec_time_pct", "exec_time_pct", "blk_read_time",
           "blk_write_time", "min_exec_time", "max_exec_time", "mean_exec_time",
           "stddev_exec_time", "rows", "user_time", "system_time"),
          ("total_exec_time", "total_time"), "true", diff_where="true"),
    _stmt("q13", "Statements by executions",
          ("calls", "calls_pct", "rows", "mean_exec_time", "min_exec_time", "max_exec_time",
           "stddev_exec_time", "total_exec_time"),
          ("calls", "total_time"), "true", diff_where="true"),
    _stmt("q14", "Statements by IO wait",
          ("total_time", "io_time", "io_time_pct", "blk_read_time", "blk_write_time",
           "shared_blks_read", "local_blks_read", "temp_blks_read", "shared_blks_written",
           "local_blks_written", "temp_blks_written", "calls"),
          ("io_time", "total_time"), "io_time > 0"),
    _stmt("q15", "Statements by shared blocks fetched",
          ("total_time", "rows", "shared_blks_fetched", "shared_blks_fetched_pct",
           "shared_hit_pct", "calls"),
          ("shared_blks_fetched",), "shared_blks_fetched > 0"),
    _stmt("q16", "Statements by shared blocks read",
          ("total_time", "rows", "shared_blks_read", "read_pct", "shared_hit_pct", "calls"),
          ("shared_blks_read",), "shared_blks_read > 0"),
    _stmt("q17", "Statements by shared blocks dirtied",
          ("total_time", "rows", "shared_blks_dirtied", "dirtied_pct", "shared_hit_pct",
           "wal_bytes", "wal_bytes_pct", "calls"),
          ("shared_blks_dirtied",), "shared_blks_dirtied > 0"),
    _stmt("q18", "Statements by shared blocks written",
          ("total_time", "rows", "shared_blks_written", "tot_written_pct",
           "backend_written_pct", "shared_hit_pct", "calls"),
          ("shared_blks_written",), "shared_blks_written > 0"),
    _stmt("q19", "Statements by WAL size",
          ("wal_bytes", "wal_bytes_pct", "shared_blks_dirtied", "wal_fpi", "wal_records"),
          ("wal_bytes",), "wal_bytes > 0"),
    _stmt("q20", "Statements by temporary and local IO",
          ("total_time", "rows", "local_blks_fetched", "local_hit_pct", "temp_blks_written",
           "temp_written_total_pct", "temp_blks_read", "temp_read_total_pct",
           "local_blks_written", "local_written_total_pct", "local_blks_read",
           "local_read_total_pct", "calls"),
          (_TEMP,), f"{_TEMP} > 0"),
    _stmt("q21", "Statements by JIT time",
          ("jit_total_time", "jit_functions", "jit_generation_time", "jit_inlining_count",
           "jit_inlining_time", "jit_optimization_count", "jit_optimization_time",
           "jit_emission_count", "jit_emission_time", "total_plan_time", "total_exec_time",
           "io_time", "blk_read_time", "blk_write_time", "jit_count"),
          ("jit_total_time",), "jit_count > 0", chosen_by=("total_exec_time", "total_time"),
          diff_where="coalesce(jit_count_1, 0) + coalesce(jit_count_2, 0) > 0"),
    _stmt("q22", "Statements by CPU time",
          ("plan_user_time", "exec_user_time", "user_time_pct", "plan_system_time",
           "exec_system_time", "system_time_pct"),
          ("cpu_time",), "cpu_time > 0", relation="usage", diff_by="exec_cpu_time"),
    _stmt("q23", "Statements by file system IO",
          ("plan_reads", "exec_reads", "reads_pct", "plan_writes", "exec_writes",
           "writes_pct"),
          ("io_bytes",), "io_bytes > 0", relation="usage", diff_by="exec_io_bytes"),
    Section("q25", "Tables by sequentially scanned bytes", "tables", TABLE, TABLE_LABELS,
            ("seq_scan", "best_scan_bytes", "idx_scan", "idx_tup_fetch", *_ROW_CHANGES,
             "side_seq_scan", "best_side_scan_bytes", "side_idx_scan", "side_idx_tup_fetch",
             *_SIDE_CHANGES, "scan_bytes_by_size", "side_scan_bytes_by_size"),
            (_SCANNED,), f"{_SCANNED} > 0",
            diff_by=_SCANNED_SIZED, diff_order=_SCANNED_SIZED),
    Section("q26", "Tables by blocks fetched", "io_tables", TABLE, TABLE_LABELS,
            ("heap_blks_fetch", "heap_blks_fetch_pct", "idx_blks_fetch", "idx_blks_fetch_pct",
             "toast_blks_fetch", "toast_blks_fetch_pct", "tidx_blks_fetch",
             "tidx_blks_fetch_pct"),
            (_FETCHED,), f"{_FETCHED} > 0"),
    Section("q27", "Tables by blocks read", "io_tables", TABLE, TABLE_LABELS,
            ("heap_blks_read", "heap_blks_read_pct", "idx_blks_read", "idx_blks_read_pct",
             "toast_blks_read", "toast_blks_read_pct", "tidx_blks_read", "tidx_blks_read_pct",
             "hit_pct"),
            (_READ,), f"{_READ} > 0"),
    Section("q28", "Tables by DML", "tables", TABLE, TABLE_LABELS,
            (*_ROW_CHANGES, "seq_scan", "seq_tup_read", "idx_scan", "idx_tup_fetch",
             *_SIDE_CHANGES, "side_seq_scan", "side_seq_tup_read", "side_idx_scan",
             "side_idx_tup_fetch"),
            (_DML,), f"{_DML} > 0"),
    Section("q29", "Tables by updates and deletes", "tables", TABLE, TABLE_LABELS,
            ("n_tup_upd", "n_tup_del", "n_tup_hot_upd", "vacuum_count", "autovacuum_count",
             "analyze_count", "autoanalyze_count", "side_n_tup_upd", "side_n_tup_del",
             "side_n_tup_hot_upd", "side_vacuum_count", "side_autovacuum_count"),
            (_UPD_DEL,), f"{_UPD_DEL} > 0", diff_by=_sum0("n_tup_upd", "n_tup_del"),
            diff_order=_sum0("n_tup_upd", "n_tup_del")),
    Section("q30", "Growing tables", "tables", TABLE, TABLE_LABELS,
            (*_ROW_CHANGES, "best_growth", "relsize", "relpages_bytes", *_SIDE_CHANGES,
             "best_side_growth", "side_relsize", "side_relpages_bytes"),
            (_sum0("best_growth", "best_side_growth"),),
            f"at_end AND {_sum0('best_growth', 'best_side_growth')} > 0"),
    Section("q31", "Indexes by blocks fetched", "io_indexes", INDEX, INDEX_LABELS,
            ("idx_scan", "idx_blks_fetch", "idx_blks_fetch_pct"),
            ("idx_blks_fetch",), "idx_blks_fetch > 0"),
    Section("q32", "Indexes by blocks read", "io_indexes", INDEX, INDEX_LABELS,
            ("idx_scan", "idx_blks_read", "idx_blks_read_pct", "idx_blks_hit_pct"),
            ("idx_blks_read",), "idx_blks_read > 0"),
    Section("q33", "Growing indexes", "indexes", INDEX, INDEX_LABELS,
            ("best_growth", "relsize", "relpages_bytes", "tbl_n_tup_ins", "tbl_n_tup_upd",
             "tbl_n_tup_del", "tbl_n_tup_hot_upd"),
            ("best_growth",), "at_end AND best_growth > 0"),
    Section("q34", "Unused indexes", "indexes", INDEX, INDEX_LABELS,
            ("best_growth", "relsize", "relpages_bytes", "tbl_n_tup_ins", "tbl_n_ind_upd",
             "tbl_n_tup_del"),
            (_INDEX_DML,),
            f"at_end AND coalesce(idx_scan, 0) = 0 AND NOT indisunique AND {_INDEX_DML} > 0",
            diff=False),
    Section("q35", "Functions by time", "functions", FUNC, FUNC_LABELS, _FUNC_VALUES,
            ("total_time",), "total_time > 0"),
    Section("q36", "Functions by calls", "functions", FUNC, FUNC_LABELS, _FUNC_VALUES,
            ("calls",), "calls > 0"),
    Section("q37", "Trigger functions by time", "trigger_functions", FUNC, FUNC_LABELS,
            _FUNC_VALUES, ("total_time",), "total_time > 0"),
    Section("q38", "Tables by vacuums", "tables", TABLE, TABLE_LABELS,
            ("vacuum_count", "autovacuum_count", *_ROW_CHANGES),
            (_sum0("vacuum_count", "autovacuum_count"),),
            f"{_sum0('vacuum_count', 'autovacuum_count')} > 0"),
    Section("q39", "Tables by analyzes", "tables", TABLE, TABLE_LABELS,
            ("analyze_count", "autoanalyze_count", *_ROW_CHANGES),
            (_sum0("analyze_count", "autoanalyze_count"),),
            f"{_sum0('analyze_count', 'autoanalyze_count')} > 0"),
    Section("q40", "Indexes by estimated vacuum load", "indexes", INDEX, INDEX_LABELS,
            ("vacuum_bytes", "vacuum_count", "autovacuum_count", "mean_index_size",
             "mean_table_size", "mean_index_pages", "mean_table_pages"),
            ("vacuum_bytes",), f"{_sum0('vacuum_count', 'autovacuum_count')} > 0",
            diff_where=f"{_sum0('vacuum_count_1', 'autovacuum_count_1')} + "
                       f"{_sum0('vacuum_count_2', 'autovacuum_count_2')} > 0"),
    Section("q41", "Tables by dead rows", "tables_at_end", TABLE,
            ("dbname", "schemaname", "relname"),
            ("n_live_tup", "n_dead_tup", "dead_pct", "last_autovacuum", "relsize", "relpages_bytes"),
            ("dead_pct",), "n_dead_tup > 0", diff=False),
    Section("q42", "Tables by modified rows", "tables_at_end", TABLE,
            ("dbname", "schemaname", "relname"),
            ("n_live_tup", "n_dead_tup", "n_mod_since_analyze", "mods_pct", "last_autoanalyze",
             "relsize", "relpages_bytes"),
            ("mods_pct",),
            "relkind IN ('r', 'm') AND n_mod_since_analyze > 0 AND n_live_tup + n_dead_tup > 0",
            diff=False),
)
BY_ID = {s.id: s for s in SECTIONS}
TOPN = 20


# --- plans -------------------------------------------------------------------------------

def null_if_zero(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """SQL that shows zero as NULL for the numeric ones among ``columns``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [f"nullif({c}, 0) AS {c}" if isinstance(types[c], T.NumericType) else c
            for c in columns]


def _metric(df: DataFrame, column: str, keep: str = "true") -> Metric:
    exact = isinstance(df.schema[column].dataType, (T.LongType, T.IntegerType, T.ShortType))
    return Metric(column, column, keep=keep, exact=exact)


def single_section(relation: DataFrame, section: Section, topn: int = TOPN) -> DataFrame:
    """Top rows of one interval per server: ord, key, labels, values (zero shown as NULL)."""
    group = [SERVER, "interval_no"]
    names = [f"_o{n}" for n in range(len(section.order))]
    shown = [*group, *section.key, *section.labels, *section.values]
    order = ", ".join([*[f"{n} DESC NULLS LAST" for n in names], *section.key])
    sorts = [f"{e} AS {n}" for e, n in zip(section.order, names)]
    if section.chosen_by:
        extra = [c for c in section.chosen_by if c not in shown]
        rows = relation.selectExpr(*shown, *extra, *sorts)
        metrics = [_metric(rows, m, section.where) for m in section.chosen_by]
        out = top_rows(rows, group, section.key, metrics, topn, order)
    else:
        rows = relation.filter(section.where).selectExpr(*shown, *sorts)
        out = ranked(rows, group, order, section.key, topn, out="ord")
    return out.selectExpr(SERVER, "interval_no", "ord", *section.key, *section.labels,
                          *null_if_zero(out, section.values))


def side_by_side(relation: DataFrame, key: Sequence[str], labels: Sequence[str],
                 values: Sequence[str]) -> DataFrame:
    """One row per key with the values of interval 1 and 2 (NULL where absent). This is the
    full outer join of the two intervals, expressed as one grouped aggregation."""
    def of(n: int, column: str) -> str:
        return f"max(CASE WHEN interval_no = {n} THEN {column} END)"

    return grouped(relation, (SERVER, *key), [
        *[f"coalesce({of(1, c)}, {of(2, c)}) AS {c}" for c in labels],
        *[f"{of(n, c)} AS {c}_{n}" for c in values for n in (1, 2)]])


def diff_section(relation: DataFrame, section: Section, topn: int = TOPN) -> DataFrame:
    """Rows that rank within top-n in either interval, ordered by the sum of both."""
    compared = section.chosen_by or (section.diff_by or section.order[0],)
    marks = [f"_by{n}" for n in range(len(compared))]
    rows = relation.selectExpr(
        SERVER, "interval_no", *section.key, *section.labels, *section.values,
        f"{section.diff_order or section.order[0]} AS _sort",
        *[f"{e} AS {m}" for e, m in zip(compared, marks)])
    # numbers decide which keys are shown; labels and values are read for those alone
    where = section.diff_where or "_sum > 0"
    asked = [v for v in section.values if re.search(rf"\b{v}_[12]\b", where)]
    both = side_by_side(rows, section.key, (), (*asked, "_sort", *marks))
    both = both.selectExpr("*", "coalesce(_sort_1, 0) + coalesce(_sort_2, 0) AS _sum")
    order = ", ".join(["_sum DESC", *section.key])
    if section.diff_sum:
        out = ranked(both.filter(where), [SERVER], order, section.key, topn, out="ord")
    else:
        keep = where if section.chosen_by else "true"
        if not section.chosen_by:
            both = both.filter(where)
        metrics = [_metric(both, f"{m}_{n}", keep) for m in marks for n in (1, 2)]
        out = top_rows(both, [SERVER], section.key, metrics, topn, order)
    key = (SERVER, *section.key)
    chosen = F.broadcast(out.select("ord", *[F.col(c).alias(f"_of_{c}") for c in key]))
    shown = side_by_side(rows.join(chosen, _same(key)), (*section.key, "ord"), section.labels, section.values)
    values = [f"{v}_{n}" for v in section.values for n in (1, 2)]
    return shown.selectExpr(SERVER, "ord", *section.key, *section.labels, *null_if_zero(shown, values))


# --- what a section can list ---------------------------------------------------------------

#: Buckets of keys for each listed row.
BUCKETS = 64
Ranking = tuple[str, str]  # value, condition under which a row takes part


def _ranked_value(df: DataFrame, column: str) -> str:
    return f"CAST({column} AS {'BIGINT' if _metric(df, column).exact else 'DOUBLE'})"


def _within(df: DataFrame, group: Sequence[str], key: Sequence[str], rankings: Sequence[Ranking], k: int) -> DataFrame:
    """The rows that can be among the k first of any ranking, and few others, in two passes for all rankings and no sort.

    The largest values of different buckets of keys belong to different rows, so the k-th of them is not above the k-th value
    of the group. Rows as large as this bound stay, and all that take part where fewer than k buckets have a value. So
    ranking what stays gives the same k first rows.
    """
    if k < 1:
        return df
    values = [f"CASE WHEN {where} THEN {value} END AS _v{n}" for n, (value, where) in enumerate(rankings)]
    bucket = f"pmod(xxhash64({', '.join(key)}), {BUCKETS * k}) AS _bucket"
    largest = grouped(df.selectExpr(*group, bucket, *values), (*group, "_bucket"),
                      [f"max(_v{n}) AS _v{n}" for n in range(len(values))])
    bounds = grouped(largest, group, [f"try_element_at(sort_array(collect_list(_v{n}), false), {k}) AS _v{n}"
                                      for n in range(len(values))])
    bounds = bounds.withColumnsRenamed({c: f"_of_{c}" for c in group})
    near = " OR ".join(f"(({where}) AND (_v{n} IS NULL OR {value} >= _v{n}))" for n, (value, where) in enumerate(rankings))
    # one row per server (and interval)
    return df.join(F.broadcast(bounds), _same(group)).filter(near).select(*df.columns)


def _same(columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in columns])


def listable(relation: DataFrame, specs: Sequence[Section], topn: int = TOPN) -> DataFrame:
    """The rows of a relation that ``single_section`` can list for any of ``specs``, and few others."""
    rankings: list[Ranking] = []
    for spec in specs:
        rankings += ([(_ranked_value(relation, m), "true") for m in spec.chosen_by] if spec.chosen_by
                     else [(spec.order[0], spec.where)])
    return _within(relation, (SERVER, "interval_no"), specs[0].key, list(dict.fromkeys(rankings)), topn)


def listable_keys(relation: DataFrame, specs: Sequence[Section], topn: int = TOPN) -> DataFrame:
    """The keys that ``diff_section`` can list for any of ``specs``, and few others, as ``_of_`` columns: the numbers that all
    of them compare stand side by side after one shuffle."""
    names: dict[str, str] = {}

    def named(expression: str) -> str:
        if expression in relation.columns:
            return names.setdefault(expression, expression)
        return names.setdefault(expression, f"_e{len(names)}")

    asked = []
    for spec in specs:
        sort = named(spec.diff_order or spec.order[0])
        marks = [named(e) for e in spec.chosen_by or (spec.diff_by or spec.order[0],)]
        total = f"(coalesce({sort}_1, 0) + coalesce({sort}_2, 0))"
        where = spec.diff_where or "_sum > 0"
        for v in spec.values:
            if re.search(rf"\b{v}_[12]\b", where):
                named(v)
        asked.append((spec, marks, total, re.sub(r"\b_sum\b", total, where)))
    key = specs[0].key
    rows = relation.selectExpr(SERVER, "interval_no", *key, *[e if e == n else f"{e} AS {n}" for e, n in names.items()])
    both = side_by_side(rows, key, (), tuple(names.values()))
    rankings: list[Ranking] = []
    for spec, marks, total, where in asked:
        rankings += ([(total, where)] if spec.diff_sum else
                     [(_ranked_value(both, f"{m}_{n}"), "true" if spec.chosen_by else where) for m in marks for n in (1, 2)])
    found = _within(both, (SERVER,), key, list(dict.fromkeys(rankings)), topn)
    return found.select(*[F.col(c).alias(f"_of_{c}") for c in (SERVER, *key)])


def with_keys(relation: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of a relation whose key is among ``keys`` (``_of_`` columns)."""
    return relation.join(keys, _same([c.removeprefix("_of_") for c in keys.columns]), "left_semi")


def columns_of(section: Section) -> set[str]:
    """Names of the relation's columns that the section reads (and other words of its expressions)."""
    expressions = (*section.values, *section.order, *section.chosen_by, section.where, section.diff_by or "",
                   section.diff_order or "")
    return {*section.key, *section.labels, *re.findall(r"[a-z_]\w*", " ".join(expressions))}


def section(repo: Repository, section_id: str, intervals: list[Interval], topn: int = TOPN,
            by_text: bool = False) -> DataFrame:
    """A ranked section for one interval, or the comparison of two."""
    spec = BY_ID[section_id]
    name = spec.relation
    if by_text and name in ("statements", "usage"):
        name = f"{name}_by_text"
    if name.startswith("statements"):
        relation = stats.top_statements(repo, intervals, name.endswith("by_text"), columns=columns_of(spec))
    else:
        relation = RELATIONS[name](repo, intervals)
    if len(intervals) == 1:
        return single_section(relation, spec, topn).drop("interval_no")
    return diff_section(relation, spec, topn)


# --- sections with a total row -----------------------------------------------------------

def _rollup(rows: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """Sums per name and over all names; the grouping id tells the total from a NULL name."""
    return rows.sparkSession.sql(
        f"""SELECT interval_no, {SERVER},
              CASE WHEN grouping({name}) = 1 THEN 'Total' ELSE {name} END AS {name},
              grouping({name}) = 1 AS is_total, {', '.join(values)}
            FROM {{rows}} GROUP BY interval_no, {SERVER}, ROLLUP({name})""", rows=rows)


def _single_or_diff(rows: DataFrame, intervals: list[Interval], name: str) -> DataFrame:
    values = [c for c in rows.columns if c not in (SERVER, "interval_no", name, "is_total")]
    shown = rows.selectExpr(SERVER, "interval_no", name, "is_total", *null_if_zero(rows, values))
    if len(intervals) == 1:
        return shown.drop("interval_no")
    return side_by_side(shown, (name, "is_total"), (), values)


DB_VALUES = ("xact_commit", "xact_rollback", "blks_read", "blks_hit", "tup_returned",
             "tup_fetched", "tup_inserted", "tup_updated", "tup_deleted", "temp_files",
             "temp_bytes", "datsize_delta", "deadlocks", "checksum_failures", "blk_read_time",
             "blk_write_time")


def database_section(repo: Repository, intervals: list[Interval]) -> DataFrame:
    """Database statistics with a total row, hit ratio, and size at the end sample."""
    sizes = _at_end(repo.databases, intervals, ("datid",), ("datsize",))
    rows = stats.dbstats_ms(repo, intervals).join(sizes, ["interval_no", SERVER, "datid"],
                                                  "left")
    hit = pct("sum(blks_hit)", "sum(blks_hit) + sum(blks_read)")
    rows = _rollup(rows, "dbname", [*sums((*DB_VALUES, "datsize")), f"{hit} AS blks_hit_pct"])
    return _single_or_diff(stats.in_seconds(rows, stats.DB_TIMES), intervals, "dbname")


def session_section(repo: Repository, intervals: list[Interval]) -> DataFrame:
    rows = _rollup(stats.dbstats_sessions(repo, intervals), "dbname", sums(SESSION_COLUMNS))
    return _single_or_diff(rows, intervals, "dbname")


STMT_DB_VALUES = ("calls", "plans", "total_exec_time", "total_plan_time", "blk_read_time",
                  "blk_write_time", "trg_fn_total_time", "shared_gets", "local_gets",
                  "shared_blks_dirtied", "local_blks_dirtied", "temp_blks_read",
                  "temp_blks_written", "local_blks_read", "local_blks_written", "statements",
                  "wal_bytes")


def statement_db_section(repo: Repository, intervals: list[Interval]) -> DataFrame:
    rows = _rollup(stats.statements_dbstats_ms(repo, intervals), "dbname", sums(STMT_DB_VALUES))
    return _single_or_diff(stats.in_seconds(rows, stats.STATEMENT_DB_TIMES), intervals, "dbname")


def jit_db_section(repo: Repository, intervals: list[Interval]) -> DataFrame:
    """JIT work per database; databases without JIT are left out."""
    used = " + ".join(zero(c) for c in JIT_COUNTS)
    rows = stats.statements_dbstats_ms(repo, intervals).filter(f"{used} > 0")
    columns = ("calls", "total_exec_time", *stats.JIT_COUNTERS, *stats.JIT_TIMES)
    rows = _rollup(rows, "dbname", sums(columns))
    return _single_or_diff(stats.in_seconds(rows, stats.STATEMENT_DB_TIMES), intervals, "dbname")


def wait_type_section(repo: Repository, intervals: list[Interval]) -> DataFrame:
    """Waits per event type with a total row and shares of all waits."""
    waits = stats.wait_stats_ms(repo, intervals)
    columns = stats.WAIT_TIMES
    totals = grouped(waits, stats.SPAN, [f"sum({c}) AS all_{c}" for c in columns])
    rows = _rollup(waits, "event_type", sums(columns)).join(totals, list(stats.SPAN)).selectExpr(
        SERVER, "interval_no", "event_type", "is_total", *columns,
        *[f"{pct(c, f'all_{c}')} AS {c}_pct" for c in columns])
    return _single_or_diff(stats.in_seconds(rows, columns), intervals, "event_type")


# --- sections without a ranking ----------------------------------------------------------

def _metric_list(rows: DataFrame, columns: Sequence[str], intervals: list[Interval]
                 ) -> DataFrame:
    """(server, metric, value) with zero and NULL shown as NULL."""
    pairs = ", ".join(f"'{c}', nullif(CAST({c} AS DOUBLE), 0D)" for c in columns)
    long = rows.selectExpr(SERVER, "interval_no",
                           f"stack({len(columns)}, {pairs}) AS (metric, value)")
    if len(intervals) == 1:
        return long.drop("interval_no")
    return side_by_side(long, ("metric",), (), ("value",))


def cluster_section(repo: Repository, intervals: list[Interval]) -> DataFrame:
    rows = stats.cluster_stats(repo, intervals)
    return _metric_list(rows, [c for c in rows.columns if c not in stats.SPAN], intervals)


def wal_section(repo: Repository, intervals: list[Interval]) -> DataFrame:
    """WAL sums, rates per second, and write and sync duty in percent of the interval."""
    spans = None
    for n, interval in enumerate(intervals, 1):
        one = durations(repo.samples, interval).selectExpr("*", f"{n} AS interval_no")
        spans = one if spans is None else spans.unionByName(one)
    wal = stats.wal_stats(repo, intervals)
    seconds = "duration_sec"
    rows = wal.join(spans, list(stats.SPAN), "left").selectExpr(
        *wal.columns,
        *[f"{ratio(c, seconds)} AS {c}_per_sec" for c in ("wal_bytes", "wal_write", "wal_sync")],
        *[f"{ratio(f'CAST({c}_time AS DOUBLE) / 10', seconds)} AS {c}_duty_pct"
          for c in ("wal_write", "wal_sync")])
    return _metric_list(rows, [c for c in rows.columns if c not in stats.SPAN], intervals)


def tablespace_section(repo: Repository, intervals: list[Interval]) -> DataFrame:
    """Growth of tablespaces and their size at the end sample."""
    sizes = _at_end(repo.tablespaces, intervals, ("tablespaceid",), ("size",))
    rows = stats.tablespace_stats(repo, intervals).join(
        sizes, ["interval_no", SERVER, "tablespaceid"], "left")
    values = ("size", "size_delta")
    names = ("tablespacename", "tablespacepath")
    rows = rows.selectExpr(SERVER, "interval_no", "tablespaceid", *names,
                           *null_if_zero(rows, values))
    if len(intervals) == 1:
        return rows.drop("interval_no").select(
            "*", *[size_pretty(F.col(c)).alias(f"{c}_text") for c in values])
    return side_by_side(rows, ("tablespaceid",), names, values)


def statement_texts(repo: Repository, intervals: list[Interval],
                    listed: DataFrame | None = None, by_text: bool = False,
                    max_length: int | None = None, per_query: int | None = 3) -> DataFrame:
    """Newest texts of each query id seen in the closed intervals, at most ``per_query`` (None: all).

    ``listed`` restricts the ids to (server_id, datid, userid, queryid) shown in a report.
    """
    query = short_hash(F.col("queryid_md5")) if by_text else F.col("queryid")
    facts = scan(repo.statements, intervals, closed=True).withColumn("queryid", query)
    if listed is not None:
        facts = facts.join(listed, [c for c in (SERVER, "datid", "userid", "queryid") if c in listed.columns], "left_semi")
    pairs = facts.select(SERVER, "queryid", "queryid_md5").distinct()
    texts = pairs.join(repo.stmt_list, [SERVER, "queryid_md5"])
    order = "last_sample_id DESC NULLS FIRST, queryid_md5 DESC"
    group = [SERVER, "queryid"]
    if per_query is None:
        by = ", ".join(group)
        best = texts.selectExpr("*", f"row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS ord")
    else:
        best = ranked(texts, group, order, ["queryid_md5"], per_query, out="ord")
    shown = F.col("query") if max_length is None else F.left("query", F.lit(max_length))
    return best.select(*group, "ord",
                       F.count(F.lit(1)).over(W.partitionBy(*group)).alias("row_span"),
                       "queryid_md5", shown.alias("query"))

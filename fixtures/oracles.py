"""Oracle SQL (DuckDB) for the interval relations and sections.

Written in the plainest relational form: self-joins on the previous tick, literal
``least(rank, ...) <= n`` selection, FULL OUTER JOIN comparison. The Spark plans use none of these.
"""

from __future__ import annotations

from counterlake.model import (DATABASE_COUNTERS, INDEX_COUNTERS, FUNCTION_COUNTERS,
                               STATEMENT_SUMS, TABLE_COUNTERS, USAGE_FIELDS, USAGE_SUMS)
from counterlake.operators.stats import JIT_COUNTERS, JIT_TIMES, SIZES, TABLE_SUMS
from counterlake.plans.sections import DB_VALUES, STMT_DB_VALUES, Section
from fixtures.projection import TICKS, duck_with

ONE = f"SELECT 1 AS interval_no, 0 AS s, {TICKS} AS e"
TWO = f"SELECT 1 AS interval_no, 0 AS s, 15 AS e UNION ALL SELECT 2, 15, {TICKS}"
IN_SPAN = "JOIN spans ON sample_id > s AND sample_id <= e"
SPAN = "interval_no, server_id"
SESSIONS = ("session_time", "active_time", "idle_in_transaction_time", "sessions",
            "sessions_abandoned", "sessions_fatal", "sessions_killed")


def total(c: str) -> str:
    return f"CAST(sum({c}) AS BIGINT)"


def sums(columns, prefix: str = "") -> str:
    return ", ".join(f"{total(prefix + c)} AS {c}" for c in columns)


def pct(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) * 100 / NULLIF(CAST({b} AS DOUBLE), 0)"


def ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)"


def sec(c: str) -> str:
    return f"CAST({c} AS DOUBLE) / 1000"


X: dict[str, str] = {}
_db = [c for c in DATABASE_COUNTERS if c not in SESSIONS and c != "conflicts"]
_db_plain = [c for c in _db if c not in ("blk_read_time", "blk_write_time")]
X["x_db"] = f"""SELECT * REPLACE ({sec('blk_read_time')} AS blk_read_time,
  {sec('blk_write_time')} AS blk_write_time) FROM x_db_ms"""
X["x_db_ms"] = f"""SELECT {SPAN}, datid, datname AS dbname, {sums(_db_plain)},
  {sums(('blk_read_time', 'blk_write_time'))}, {sums(('checksum_failures', 'datsize_delta'))} FROM databases {IN_SPAN}
  WHERE NOT datistemplate GROUP BY {SPAN}, datid, datname"""
X["x_sessions"] = f"""SELECT {SPAN}, datid, datname AS dbname, {sums(SESSIONS)}
  FROM databases {IN_SPAN} WHERE NOT datistemplate GROUP BY {SPAN}, datid, datname"""
_cl = ("checkpoints_timed", "checkpoints_req", "checkpoint_write_time", "checkpoint_sync_time",
       "buffers_checkpoint", "buffers_clean", "maxwritten_clean", "buffers_backend",
       "buffers_backend_fsync", "buffers_alloc", "wal_size")
X["x_cluster"] = f"""SELECT {SPAN}, {sums(_cl)}, {sums(('archived_count', 'failed_count'))}
  FROM cluster LEFT JOIN archiver USING (server_id, sample_id) {IN_SPAN} GROUP BY {SPAN}"""
_wal = ("wal_records", "wal_fpi", "wal_bytes", "wal_buffers_full", "wal_write", "wal_sync",
        "wal_write_time", "wal_sync_time")
X["x_wal"] = f"SELECT {SPAN}, {sums(_wal)} FROM wal {IN_SPAN} GROUP BY {SPAN}"
X["x_spaces"] = f"""SELECT {SPAN}, tablespaceid, tablespacename, tablespacepath,
  {sums(('size_delta',))} FROM tablespaces JOIN tablespaces_list USING (server_id, tablespaceid)
  {IN_SPAN} GROUP BY {SPAN}, tablespaceid, tablespacename, tablespacepath"""
X["x_waits"] = f"""SELECT * REPLACE ({sec('tot_waited')} AS tot_waited,
  {sec('stmt_waited')} AS stmt_waited) FROM x_waits_ms"""
X["x_waits_ms"] = f"""SELECT {SPAN}, event_type, event, {sums(('tot_waited', 'stmt_waited'))} FROM waits {IN_SPAN} GROUP BY {SPAN}, event_type, event"""

# --- totals over all objects --------------------------------------------------------------
X["table_totals"] = f"""SELECT server_id, sample_id, datid, tablespaceid, relkind,
  {sums((*TABLE_COUNTERS, 'relsize_diff'))} FROM tables
  GROUP BY server_id, sample_id, datid, tablespaceid, relkind"""
X["index_totals"] = f"""SELECT server_id, sample_id, datid, tablespaceid,
  {sums((*INDEX_COUNTERS, 'relsize_diff'))} FROM indexes
  GROUP BY server_id, sample_id, datid, tablespaceid"""
X["function_totals"] = f"""SELECT server_id, sample_id, datid, trg_fn,
  {sums(('calls', 'total_time'))} FROM functions GROUP BY server_id, sample_id, datid, trg_fn"""
X["statement_totals"] = f"""SELECT server_id, sample_id, datid, {sums(STATEMENT_SUMS)},
  count(*) AS statements FROM statements JOIN databases d USING (server_id, sample_id, datid)
  GROUP BY server_id, sample_id, datid""".replace("sum(blk_", "sum(statements.blk_")
X["usage_totals"] = f"""SELECT server_id, sample_id, datid, {sums(USAGE_SUMS)},
  count(*) AS statements FROM usage JOIN databases d USING (server_id, sample_id, datid)
  WHERE toplevel GROUP BY server_id, sample_id, datid"""

# --- tables and indexes -------------------------------------------------------------------
# Newest name of each database inside a span, and the samples at which it is a user database.
X["x_dbnames"] = f"""SELECT {SPAN}, datid, arg_max(datname, sample_id) AS dbname FROM databases
  {IN_SPAN} GROUP BY ALL"""
X["user_ticks"] = """SELECT server_id, sample_id, datid, stats_reset AS epoch FROM databases
  WHERE NOT datistemplate"""
# A sample of a table concerns its object twice: as itself and as the side table of a main table.
_PART = ", ".join(("sample_id", *TABLE_SUMS, *SIZES))
X["table_parts"] = f"""SELECT server_id, datid, relid AS object, 'own' AS part, tablespaceid,
    reltoastrelid, {_PART} FROM tables WHERE relkind IN ('r', 'm')
  UNION ALL
  SELECT server_id, datid, object, 'side', NULL, NULL, {_PART}
  FROM tables NATURAL JOIN (SELECT server_id, datid, sample_id, reltoastrelid AS relid,
    relid AS object FROM tables WHERE relkind IN ('r', 'm'))"""


def of_part(part: str, aggregate: str) -> str:
    return f"{aggregate} FILTER (part = '{part}')"


def part_sum(part: str, expr: str) -> str:
    return f"CAST({of_part(part, f'sum({expr})')} AS BIGINT)"


def _part_columns() -> str:
    out = []
    for part, name in (("own", ""), ("side", "side_")):
        out += [f"{part_sum(part, c)} AS {name}{c}" for c in TABLE_SUMS]
        known = of_part(part, "bool_and(coalesce(seq_scan, 0) = 0 OR relsize IS NOT NULL)")
        out += [f"{part_sum(part, 'relsize_diff')} AS {name}growth",
                f"{part_sum(part, 'relpages_bytes_diff')} AS {name}page_growth",
                f"{part_sum(part, 'seq_scan * relsize')} AS {name}scan_bytes_by_size",
                f"{part_sum(part, 'seq_scan * relpages_bytes')} AS {name}scan_bytes_by_pages",
                f"coalesce({known}, TRUE) AS {name}scan_sizes_known"]
    return ", ".join(out)


X["x_tables_inside"] = f"""SELECT {SPAN}, datid, object AS relid, {_part_columns()},
  arg_max(tablespaceid, sample_id) FILTER (part = 'own') AS tablespaceid,
  arg_max(reltoastrelid, sample_id) FILTER (part = 'own') AS reltoastrelid
  FROM table_parts SEMI JOIN user_ticks USING (server_id, sample_id, datid) {IN_SPAN}
  GROUP BY ALL"""
# Sizes at both ends: the extreme samples of a part are also extreme among its sized samples.
X["x_tables_ends"] = f"""SELECT {SPAN}, datid, object AS relid,
  coalesce(bool_and(sized) FILTER (part = 'own'), FALSE) AS ends_sized,
  coalesce(bool_and(sized) FILTER (part = 'side'), FALSE) AS side_ends_sized FROM (
    SELECT interval_no, server_id, datid, object, part, relsize IS NOT NULL AS sized FROM table_parts
    JOIN spans ON sample_id BETWEEN s AND e
    WINDOW object_part AS (PARTITION BY interval_no, server_id, datid, object, part)
    QUALIFY sample_id IN (min(sample_id) OVER object_part, max(sample_id) OVER object_part))
  GROUP BY ALL"""


def better(flag: str, first: str, second: str, out: str) -> str:
    return f"if({flag}, {first}, {second}) AS {out}"


X["x_tables"] = f"""SELECT t.*, ends_sized, side_ends_sized, schemaname, relname, tablespacename, dbname,
  {', '.join(better(f'{p}ends_sized', f'{p}growth', f'{p}page_growth', f'best_{p}growth') for p in ('', 'side_'))},
  {', '.join(better(f'{p}scan_sizes_known', f'{p}scan_bytes_by_size', f'{p}scan_bytes_by_pages', f'best_{p}scan_bytes') for p in ('', 'side_'))}
  FROM x_tables_inside t JOIN x_tables_ends USING (interval_no, server_id, datid, relid)
  JOIN x_dbnames USING (interval_no, server_id, datid)
  JOIN (SELECT server_id, datid, relid, schemaname, relname FROM tables_list)
    USING (server_id, datid, relid)
  JOIN (SELECT server_id, tablespaceid, tablespacename FROM tablespaces_list)
    USING (server_id, tablespaceid)"""
X["x_tables_sized"] = """SELECT x.*, l.relsize, l.relpages_bytes, l.server_id IS NOT NULL AS at_end,
  m.relsize AS side_relsize, m.relpages_bytes AS side_relpages_bytes
  FROM x_tables x JOIN spans USING (interval_no)
  LEFT JOIN tables l ON l.server_id = x.server_id AND l.sample_id = e AND l.datid = x.datid
    AND l.relid = x.relid
  LEFT JOIN tables m ON m.server_id = x.server_id AND m.sample_id = e AND m.datid = x.datid
    AND m.relid = x.reltoastrelid"""
# An index shows its table, and the index of a side table the main table with a mark.
X["index_names"] = """SELECT i.server_id, i.datid, i.indexrelid, t.relid, i.indexrelname,
  coalesce(m.schemaname, t.schemaname) AS schemaname,
  coalesce(m.relname || '(TOAST)', t.relname) AS relname
  FROM indexes_list i JOIN tables_list t ON (t.server_id, t.datid) = (i.server_id, i.datid)
  LEFT JOIN tables_list m ON (m.server_id, m.datid, m.reltoastrelid) = (t.server_id, t.datid, t.relid)"""
_names_ix = """JOIN index_names USING (server_id, datid, relid, indexrelid)
  JOIN (SELECT server_id, tablespaceid, tablespacename FROM tablespaces_list)
    USING (server_id, tablespaceid)
  JOIN x_dbnames USING (interval_no, server_id, datid)"""
_CHANGES = ("n_tup_ins", "n_tup_upd", "n_tup_del", "n_tup_hot_upd")
# Index samples beside those of their table; vacuums is how often the index was read in whole.
X["index_samples"] = f"""SELECT server_id, sample_id, datid, relid, indexrelid, tablespaceid, indisunique,
  idx_scan, idx_blks_read, idx_blks_hit, relsize, relpages_bytes, relsize_diff, relpages_bytes_diff, of_table
  FROM indexes LEFT JOIN (SELECT server_id, sample_id, datid, relid, struct_pack(
    {', '.join(f'{c} := {c}' for c in (*_CHANGES, 'vacuum_count', 'autovacuum_count', 'relsize', 'relpages_bytes'))},
    vacuums := coalesce(vacuum_count, 0) + coalesce(autovacuum_count, 0)) AS of_table FROM tables)
  USING (server_id, sample_id, datid, relid)"""


def mean_while_vacuumed(expr: str, out: str) -> str:
    return f"CAST(round(avg(CASE WHEN of_table.vacuums > 0 THEN {expr} END)) AS BIGINT) AS {out}"


X["x_indexes_inside"] = f"""SELECT {SPAN}, datid, relid, indexrelid,
  arg_max(indisunique, sample_id) AS indisunique, arg_max(tablespaceid, sample_id) AS tablespaceid,
  {sums(('idx_scan', 'idx_blks_read'))}, {total('idx_blks_read + idx_blks_hit')} AS idx_blks_fetch,
  {total('relsize_diff')} AS growth, {total('relpages_bytes_diff')} AS page_growth,
  {', '.join(f"{total(f'of_table.{c}')} AS tbl_{c}" for c in _CHANGES)},
  {', '.join(f"{total(f'of_table.{c}')} AS {c}" for c in ('vacuum_count', 'autovacuum_count'))},
  {total('of_table.vacuums * relsize')} AS vacuum_bytes_by_size,
  {total('of_table.vacuums * relpages_bytes')} AS vacuum_bytes_by_pages,
  {mean_while_vacuumed('relsize', 'mean_index_size')},
  {mean_while_vacuumed('of_table.relsize', 'mean_table_size')},
  {mean_while_vacuumed('relpages_bytes', 'mean_index_pages')},
  {mean_while_vacuumed('of_table.relpages_bytes', 'mean_table_pages')},
  coalesce(bool_and(relsize IS NOT NULL) FILTER (of_table.vacuums > 0), TRUE) AS vacuum_sizes_known
  FROM index_samples SEMI JOIN user_ticks USING (server_id, sample_id, datid) {IN_SPAN}
  WHERE of_table IS NOT NULL GROUP BY ALL"""
X["x_indexes_ends"] = f"""SELECT {SPAN}, datid, indexrelid, bool_and(sized) AS ends_sized FROM (
    SELECT interval_no, server_id, datid, indexrelid, relsize IS NOT NULL AS sized FROM indexes
    JOIN spans ON sample_id BETWEEN s AND e
    WINDOW one_index AS (PARTITION BY interval_no, server_id, datid, indexrelid)
    QUALIFY sample_id IN (min(sample_id) OVER one_index, max(sample_id) OVER one_index)) GROUP BY ALL"""
X["x_indexes"] = f"""SELECT x.*, ends_sized, indexrelname, schemaname, relname, tablespacename, dbname,
  {better('ends_sized', 'growth', 'page_growth', 'best_growth')},
  {better('vacuum_sizes_known', 'vacuum_bytes_by_size', 'vacuum_bytes_by_pages', 'vacuum_bytes')}
  FROM x_indexes_inside x JOIN x_indexes_ends USING (interval_no, server_id, datid, indexrelid) {_names_ix}"""
X["x_indexes_sized"] = """SELECT x.*, l.relsize, l.relpages_bytes, l.server_id IS NOT NULL AS at_end,
  tbl_n_tup_upd - coalesce(tbl_n_tup_hot_upd, 0) AS tbl_n_ind_upd
  FROM x_indexes x JOIN spans USING (interval_no)
  LEFT JOIN indexes l ON l.server_id = x.server_id AND l.sample_id = e AND l.datid = x.datid
    AND l.indexrelid = x.indexrelid"""
# Blocks in the long form: one row for each kind of block, read or found in memory.
_kinds = ("heap", "idx", "toast", "tidx")
X["block_counts"] = " UNION ALL ".join(
    f"SELECT server_id, sample_id, datid, relid, tablespaceid, relkind, '{k}' AS kind, "
    f"{k}_blks_read AS reads, {k}_blks_hit AS hits FROM tables" for k in _kinds)
X["all_blocks"] = f"""SELECT {SPAN}, {total('heap_blks_read')} + {total('idx_blks_read')} AS all_read,
  {total('heap_blks_read + heap_blks_hit')} + {total('idx_blks_read + idx_blks_hit')} AS all_fetched
  FROM table_totals {IN_SPAN} GROUP BY ALL"""
# Objects whose database was not reset while they were seen.
_STEADY = "HAVING count(DISTINCT epoch) = 1"
_by_kind = ", ".join(f"CAST(sum(reads) FILTER (kind = '{k}') AS BIGINT) AS {k}_blks_read, "
                     f"CAST(coalesce(sum(reads) FILTER (kind = '{k}'), 0) + coalesce(sum(hits) FILTER (kind = '{k}'), 0)"
                     f" AS BIGINT) AS {k}_blks_fetch" for k in _kinds)
X["x_io_tables"] = f"""WITH b AS (SELECT {SPAN}, datid, relid, {_by_kind},
    CAST(coalesce(sum(reads), 0) AS BIGINT) AS blks_read,
    CAST(coalesce(sum(reads), 0) + coalesce(sum(hits), 0) AS BIGINT) AS blks_fetch,
    CAST(coalesce(sum(hits), 0) AS BIGINT) AS found
    FROM block_counts JOIN user_ticks USING (server_id, sample_id, datid) {IN_SPAN}
    WHERE relkind IN ('r', 'm') GROUP BY ALL {_STEADY}),
  c AS (SELECT {SPAN}, datid, relid, {sums(('seq_scan', 'idx_scan'))}, arg_max(tablespaceid, sample_id) AS tablespaceid
    FROM tables SEMI JOIN user_ticks USING (server_id, sample_id, datid) {IN_SPAN} GROUP BY ALL)
  SELECT b.* EXCLUDE (found), seq_scan, idx_scan, tablespaceid,
    {', '.join(f"{pct(f'{k}_blks_read', 'all_read')} AS {k}_blks_read_pct, {pct(f'{k}_blks_fetch', 'all_fetched')} AS {k}_blks_fetch_pct" for k in _kinds)},
    {pct('found', 'blks_fetch')} AS hit_pct, schemaname, relname, tablespacename, dbname
  FROM b JOIN c USING (interval_no, server_id, datid, relid)
  LEFT JOIN all_blocks USING (interval_no, server_id) JOIN x_dbnames USING (interval_no, server_id, datid)
  JOIN (SELECT server_id, datid, relid, schemaname, relname FROM tables_list) USING (server_id, datid, relid)
  JOIN (SELECT server_id, tablespaceid, tablespacename FROM tablespaces_list) USING (server_id, tablespaceid)"""
X["x_io_indexes"] = f"""WITH x AS (SELECT {SPAN}, datid, relid, indexrelid, arg_max(tablespaceid, sample_id) AS tablespaceid,
    {sums(('idx_scan', 'idx_blks_read'))}, coalesce({total('idx_blks_hit')}, 0) AS found,
    coalesce({total('idx_blks_read')}, 0) + coalesce({total('idx_blks_hit')}, 0) AS idx_blks_fetch
    FROM indexes JOIN user_ticks USING (server_id, sample_id, datid) {IN_SPAN} GROUP BY ALL {_STEADY})
  SELECT x.* EXCLUDE (found), {pct('idx_blks_read', 'all_read')} AS idx_blks_read_pct,
    {pct('found', 'idx_blks_fetch')} AS idx_blks_hit_pct, {pct('idx_blks_fetch', 'all_fetched')} AS idx_blks_fetch_pct,
    indexrelname, tablespacename, schemaname, relname, dbname
  FROM x
  LEFT JOIN all_blocks USING (interval_no, server_id) {_names_ix}"""


def _functions(trigger: str) -> str:
    return f"""SELECT interval_no, server_id, f.datid, funcid, db.datname AS dbname,
  {total('f.calls')} AS calls, {sec('sum(f.total_time)')} AS total_time,
  {sec('sum(f.self_time)')} AS self_time,
  {ratio('sum(f.total_time)', 'sum(f.calls)')} / 1000 AS m_time,
  {ratio('sum(f.self_time)', 'sum(f.calls)')} / 1000 AS m_stime, schemaname, funcname, funcargs
  FROM functions f JOIN databases db USING (server_id, sample_id, datid)
  JOIN (SELECT server_id, datid, funcid, schemaname, funcname, funcargs FROM funcs_list)
    USING (server_id, datid, funcid) {IN_SPAN}
  WHERE {trigger} f.trg_fn AND NOT db.datistemplate
  GROUP BY interval_no, server_id, f.datid, funcid, db.datname, schemaname, funcname, funcargs"""


X["x_functions"] = _functions("NOT")
X["x_trigger_functions"] = _functions("")

# --- statements ---------------------------------------------------------------------------
_n = "NULLIF(sum({w}), 0)"


def _mean(m: str, w: str) -> str:
    return f"sum(st.{m} * st.{w}) / CAST(NULLIF(sum(st.{w}), 0) AS DOUBLE)"


def _dev(sd: str, m: str, w: str) -> str:
    return (f"sqrt(greatest(sum((power(st.{sd}, 2) + power(st.{m}, 2)) * st.{w})"
            f" / CAST(NULLIF(sum(st.{w}), 0) AS DOUBLE) - power({_mean(m, w)}, 2), 0))")


X["x_stmt_tot"] = f"""SELECT {SPAN}, coalesce({total('total_plan_time')}, 0) + {total('total_exec_time')} AS time,
  {sums(('blk_read_time', 'blk_write_time', 'shared_blks_hit', 'shared_blks_read',
         'shared_blks_dirtied', 'temp_blks_read', 'temp_blks_written', 'local_blks_read',
         'local_blks_written', 'calls', 'plans'))} FROM statement_totals {IN_SPAN} GROUP BY {SPAN}"""
X["x_bgw"] = f"""SELECT {SPAN}, {total('buffers_checkpoint')} + {total('buffers_clean')}
  + {total('buffers_backend')} AS written, {total('buffers_backend')} AS backend,
  {total('wal_size')} AS wal_size FROM cluster {IN_SPAN} GROUP BY {SPAN}"""
_hash = ("CAST(CASE WHEN ('0x' || left(st.queryid_md5, 16))::UBIGINT >= 9223372036854775808::UBIGINT"
         " THEN ('0x' || left(st.queryid_md5, 16))::UBIGINT::HUGEINT - 18446744073709551616::HUGEINT"
         " ELSE ('0x' || left(st.queryid_md5, 16))::UBIGINT::HUGEINT END AS BIGINT)")


def _statements(query: str) -> str:
    used = [(c, f"coalesce({total(f'kc.exec_{c}')}, 0) + coalesce({total(f'kc.plan_{c}')}, 0)")
            for c in ("user_time", "system_time", "reads", "writes")]
    return f"""SELECT interval_no, st.server_id, st.datid, st.userid, {query} AS queryid, st.toplevel,
  arg_max(db.datname, st.sample_id) AS dbname,
  {', '.join(f"{total('st.' + c)} AS {c}" for c in STATEMENT_SUMS)},
  min(st.min_exec_time) AS min_exec_time, max(st.max_exec_time) AS max_exec_time,
  {_mean('mean_exec_time', 'calls')} AS mean_exec_time,
  {_dev('stddev_exec_time', 'mean_exec_time', 'calls')} AS stddev_exec_time,
  min(st.min_plan_time) AS min_plan_time, max(st.max_plan_time) AS max_plan_time,
  {_mean('mean_plan_time', 'plans')} AS mean_plan_time,
  {_dev('stddev_plan_time', 'mean_plan_time', 'plans')} AS stddev_plan_time,
  {', '.join(f"{e} AS {c}" for c, e in used)}
  FROM statements st JOIN databases db USING (server_id, sample_id, datid)
  LEFT JOIN usage kc USING (server_id, sample_id, userid, datid, queryid, toplevel) {IN_SPAN}
  GROUP BY interval_no, st.server_id, st.datid, st.userid, {query}, st.toplevel"""


def _statement_columns(base: str) -> str:
    time = "(s.total_exec_time + coalesce(s.total_plan_time, 0))"
    fetched = "(s.shared_blks_hit + s.shared_blks_read)"
    io = "(s.blk_read_time + s.blk_write_time)"
    jit = "(s.jit_generation_time + s.jit_inlining_time + s.jit_optimization_time + s.jit_emission_time)"
    shares = ", ".join(
        f"{pct(f's.{k}_blks_{op}', f't.{k}_blks_{op}')} AS {k}_{op}_total_pct"
        for k in ("temp", "local") for op in ("read", "written"))
    plain = ", ".join(f"s.{c}" for c in (
        "plans", "calls", "min_exec_time", "max_exec_time", "mean_exec_time", "stddev_exec_time",
        "min_plan_time", "max_plan_time", "mean_plan_time", "stddev_plan_time", "rows",
        "shared_blks_hit", "shared_blks_read", "shared_blks_dirtied", "shared_blks_written",
        "local_blks_hit", "local_blks_read", "local_blks_dirtied", "local_blks_written",
        "temp_blks_read", "temp_blks_written", "wal_records", "wal_fpi", "wal_bytes",
        "user_time", "system_time", "reads", "writes", *JIT_COUNTERS))
    return f"""SELECT interval_no, server_id, s.datid, s.userid, s.queryid, s.toplevel, s.dbname, {plain},
  {pct('s.plans', 't.plans')} AS plans_pct, {pct('s.calls', 't.calls')} AS calls_pct,
  {sec(time)} AS total_time, {pct(time, 't.time')} AS total_time_pct,
  {sec('s.total_plan_time')} AS total_plan_time, {pct('s.total_plan_time', time)} AS plan_time_pct,
  {sec('s.total_exec_time')} AS total_exec_time,
  {pct('s.total_exec_time', 't.time')} AS total_exec_time_pct,
  {pct('s.total_exec_time', time)} AS exec_time_pct,
  {pct('s.shared_blks_hit', fetched)} AS shared_hit_pct,
  {pct('s.shared_blks_read', 't.shared_blks_read')} AS read_pct, {fetched} AS shared_blks_fetched,
  {pct(fetched, '(t.shared_blks_hit + t.shared_blks_read)')} AS shared_blks_fetched_pct,
  {pct('s.shared_blks_dirtied', 't.shared_blks_dirtied')} AS dirtied_pct,
  {pct('s.shared_blks_written', 'b.written')} AS tot_written_pct,
  {pct('s.shared_blks_written', 'b.backend')} AS backend_written_pct,
  {pct('s.local_blks_hit', '(s.local_blks_hit + s.local_blks_read)')} AS local_hit_pct,
  s.local_blks_hit + s.local_blks_read AS local_blks_fetched,
  {sec('s.blk_read_time')} AS blk_read_time, {sec('s.blk_write_time')} AS blk_write_time,
  {sec(io)} AS io_time, {pct(io, '(t.blk_read_time + t.blk_write_time)')} AS io_time_pct, {shares},
  {pct('s.wal_bytes', 'b.wal_size')} AS wal_bytes_pct,
  {', '.join(f"{sec('s.' + c)} AS {c}" for c in JIT_TIMES)}, {sec(jit)} AS jit_total_time,
  {' + '.join(f'coalesce(s.{c}, 0)' for c in JIT_COUNTERS)} AS jit_count,
  s.temp_blks_read + s.temp_blks_written + s.local_blks_read + s.local_blks_written AS temp_io_blks,
  r.username FROM {base} s LEFT JOIN x_stmt_tot t USING (interval_no, server_id)
  LEFT JOIN x_bgw b USING (interval_no, server_id)
  JOIN roles_list r USING (server_id, userid)"""


X["x_stmt_sums"] = _statements("st.queryid")
X["x_statements"] = _statement_columns("x_stmt_sums")
X["x_stmt_text_sums"] = _statements(_hash)
X["x_statements_by_text"] = _statement_columns("x_stmt_text_sums")
_shared = ("user_time", "system_time", "reads", "writes")
X["x_usage_tot"] = f"""SELECT {SPAN}, {', '.join(f"coalesce({total(f'exec_{c}')}, 0) + coalesce({total(f'plan_{c}')}, 0) AS {c}" for c in _shared)}
  FROM usage_totals {IN_SPAN} GROUP BY {SPAN}"""


def _usage(query: str) -> str:
    return f"""SELECT interval_no, st.server_id, st.datid, st.userid, {query} AS queryid, st.toplevel,
  arg_max(db.datname, st.sample_id) AS dbname, {sums(USAGE_SUMS, 'st.')}
  FROM usage st JOIN databases db USING (server_id, sample_id, datid) {IN_SPAN}
  GROUP BY interval_no, st.server_id, st.datid, st.userid, {query}, st.toplevel"""


def _usage_columns(base: str) -> str:
    both = {c: f"(coalesce(u.exec_{c}, 0) + coalesce(u.plan_{c}, 0))" for c in USAGE_FIELDS}
    return f"""SELECT u.*, {', '.join(f"{pct(both[c], f't.{c}')} AS {c}_pct" for c in _shared)},
  {both['user_time']} + {both['system_time']} AS cpu_time,
  coalesce(u.exec_user_time, 0) + coalesce(u.exec_system_time, 0) AS exec_cpu_time,
  {both['reads']} + {both['writes']} AS io_bytes,
  coalesce(u.exec_reads, 0) + coalesce(u.exec_writes, 0) AS exec_io_bytes, r.username
  FROM {base} u LEFT JOIN x_usage_tot t USING (interval_no, server_id)
  JOIN roles_list r USING (server_id, userid)"""


X["x_usage_sums"] = _usage("st.queryid")
X["x_usage"] = _usage_columns("x_usage_sums")
X["x_usage_text_sums"] = _usage(_hash)
X["x_usage_by_text"] = _usage_columns("x_usage_text_sums")
_st_seconds = ("total_exec_time", "total_plan_time", "blk_read_time", "blk_write_time", *JIT_TIMES)
X["x_stmt_db"] = f"""SELECT * REPLACE (
  {', '.join(f"{sec(c)} AS {c}" for c in (*_st_seconds, 'trg_fn_total_time'))}) FROM x_stmt_db_ms"""
X["x_stmt_db_ms"] = f"""SELECT interval_no, st.server_id, st.datid, db.datname AS dbname,
  {sums(('calls', 'plans', *_st_seconds), 'st.')}, {total('g.total_time')} AS trg_fn_total_time,
  {total('st.shared_blks_hit')} + {total('st.shared_blks_read')} AS shared_gets,
  {total('st.local_blks_hit')} + {total('st.local_blks_read')} AS local_gets,
  {sums(('shared_blks_dirtied', 'local_blks_dirtied', 'temp_blks_read', 'temp_blks_written',
         'local_blks_read', 'local_blks_written', 'statements', 'wal_bytes', *JIT_COUNTERS), 'st.')}
  FROM statement_totals st LEFT JOIN function_totals g ON g.server_id = st.server_id
    AND g.sample_id = st.sample_id AND g.datid = st.datid AND g.trg_fn
  JOIN databases db ON db.server_id = st.server_id AND db.sample_id = st.sample_id
    AND db.datid = st.datid
  JOIN spans ON st.sample_id > s AND st.sample_id <= e
  GROUP BY interval_no, st.server_id, st.datid, db.datname"""
X["x_wait_shares"] = f"""SELECT w.* REPLACE ({sec('w.tot_waited')} AS tot_waited,
  {sec('w.stmt_waited')} AS stmt_waited), {pct('w.tot_waited', 't.a')} AS tot_waited_pct,
  {pct('w.stmt_waited', 't.b')} AS stmt_waited_pct FROM x_waits_ms w JOIN (
    SELECT {SPAN}, sum(tot_waited) AS a, sum(stmt_waited) AS b FROM x_waits_ms GROUP BY {SPAN}) t
  USING (interval_no, server_id)"""
X["x_at_end"] = """SELECT interval_no, server_id, t.datid, t.relid, db.datname AS dbname, n_live_tup,
  n_dead_tup, n_mod_since_analyze, t.relsize, t.relpages_bytes, relkind, schemaname, relname,
  (n_dead_tup * 100) // NULLIF(coalesce(n_live_tup, 0) + coalesce(n_dead_tup, 0), 0) AS dead_pct,
  (n_mod_since_analyze * 100) // NULLIF(coalesce(n_live_tup, 0) + coalesce(n_dead_tup, 0), 0) AS mods_pct,
  strftime(last_autovacuum, '%Y-%m-%d %H:%M:%S') AS last_autovacuum,
  strftime(last_autoanalyze, '%Y-%m-%d %H:%M:%S') AS last_autoanalyze
  FROM tables t JOIN databases db USING (server_id, sample_id, datid) JOIN spans ON sample_id = e
  JOIN (SELECT server_id, datid, relid, schemaname, relname FROM tables_list)
    USING (server_id, datid, relid)
  WHERE NOT db.datistemplate AND coalesce(t.relsize, t.relpages_bytes) > 5 * 1024 * 1024"""

RELATION = {
    "statements": "x_statements", "statements_by_text": "x_statements_by_text",
    "usage": "x_usage", "usage_by_text": "x_usage_by_text", "tables": "x_tables_sized",
    "indexes": "x_indexes_sized", "io_tables": "x_io_tables", "io_indexes": "x_io_indexes",
    "functions": "x_functions", "trigger_functions": "x_trigger_functions",
    "waits": "x_wait_shares", "tables_at_end": "x_at_end",
}


def x_sql(sql: str, spans: str = ONE) -> str:
    return duck_with(sql, {**X, "spans": spans})


def _null0(v: str, out: str | None = None) -> str:
    return v if v.startswith("last_") else f"NULLIF({v}, 0) AS {out or v}"


def single_sql(section: Section, topn: int) -> str:
    x = RELATION[section.relation]
    key = ", ".join(section.key)
    order = ", ".join(f"({o}) DESC NULLS LAST" for o in section.order)
    shown = ", ".join([*section.key, *section.labels, *[_null0(v) for v in section.values]])
    if section.chosen_by:
        ranks = ", ".join(f"row_number() OVER (PARTITION BY server_id ORDER BY {m} DESC NULLS LAST, "
                          f"{key}) AS rn{n}" for n, m in enumerate(section.chosen_by))
        least = ", ".join(f"rn{n}" for n in range(len(section.chosen_by)))
        source = (f"(SELECT * FROM (SELECT *, {ranks} FROM {x}) WHERE least({least}) <= {topn} "
                  f"AND {section.where})")
        limit = ""
    else:
        source, limit = f"(SELECT * FROM {x} WHERE {section.where})", f"WHERE ord <= {topn}"
    return x_sql(f"""SELECT server_id, ord, {shown} FROM (SELECT *, CAST(row_number() OVER (
      PARTITION BY server_id ORDER BY {order}, {key}) AS INT) AS ord FROM {source}) {limit}""")


def diff_sql(section: Section, topn: int) -> str:
    x = RELATION[section.relation]
    by = section.chosen_by or (section.diff_by or section.order[0],)
    marks = ", ".join(f"({e}) AS by{n}" for n, e in enumerate(by))
    sort = section.diff_order or section.order[0]
    on = ("server_id", *section.key)
    side = "SELECT *, ({sort}) AS srt, {marks} FROM {x} WHERE interval_no = {i}"
    a, b = (side.format(sort=sort, marks=marks, x=x, i=i) for i in (1, 2))
    columns = [f"coalesce(a.{c}, b.{c}) AS {c}" for c in (*on, *section.labels)]
    columns += [f"{s}.{v} AS {v}_{n}" for v in section.values for n, s in ((1, "a"), (2, "b"))]
    columns += [f"{s}.by{m} AS by{m}_{n}" for m in range(len(by)) for n, s in ((1, "a"), (2, "b"))]
    columns.append("coalesce(a.srt, 0) + coalesce(b.srt, 0) AS _sum")
    joined = f"""SELECT {', '.join(columns)} FROM ({a}) a FULL OUTER JOIN ({b}) b
      ON {' AND '.join(f'a.{c} = b.{c}' for c in on)}"""
    where = section.diff_where or "_sum > 0"
    key = ", ".join(section.key)
    if section.diff_sum:
        kept = f"SELECT * FROM ({joined}) WHERE {where}"
        limit = f"WHERE ord <= {topn}"
    else:
        names = [f"by{m}_{n}" for m in range(len(by)) for n in (1, 2)]
        ranks = ", ".join(f"row_number() OVER (PARTITION BY server_id ORDER BY {c} DESC NULLS LAST, "
                          f"{key}) AS rn_{c}" for c in names)
        least = ", ".join(f"rn_{c}" for c in names)
        limit = ""
        if section.chosen_by:
            kept = (f"SELECT * FROM (SELECT *, {ranks} FROM ({joined})) "
                    f"WHERE least({least}) <= {topn} AND ({where})")
        else:
            kept = (f"SELECT * FROM (SELECT *, {ranks} FROM ({joined}) WHERE {where}) "
                    f"WHERE least({least}) <= {topn}")
    shown = ", ".join([*section.key, *section.labels,
                       *[_null0(f"{v}_{n}") for v in section.values for n in (1, 2)]])
    return x_sql(f"""SELECT server_id, ord, {shown} FROM (SELECT *, CAST(row_number() OVER (
      PARTITION BY server_id ORDER BY _sum DESC, {key}) AS INT) AS ord FROM ({kept})) {limit}""", TWO)


# --- sections with totals -----------------------------------------------------------------
def _rollup(x: str, name: str, exprs: dict[str, str]) -> str:
    cols = ", ".join(f"{e} AS {c}" for c, e in exprs.items())
    return f"""SELECT interval_no, server_id,
      CASE WHEN grouping({name}) = 1 THEN 'Total' ELSE {name} END AS {name},
      grouping({name}) = 1 AS is_total, {cols} FROM {x}
      GROUP BY GROUPING SETS ((interval_no, server_id, {name}), (interval_no, server_id))"""


def _plain(inner: str, name: str, values, diff: bool) -> str:
    if not diff:
        return x_sql(f"SELECT server_id, {name}, is_total, {', '.join(_null0(v) for v in values)} "
                     f"FROM ({inner})")
    cols = ", ".join(f"NULLIF({s}.{v}, 0) AS {v}_{n}" for v in values
                     for n, s in ((1, "a"), (2, "b")))
    return x_sql(f"""SELECT coalesce(a.server_id, b.server_id) AS server_id,
      coalesce(a.{name}, b.{name}) AS {name}, coalesce(a.is_total, b.is_total) AS is_total, {cols}
      FROM (SELECT * FROM ({inner}) WHERE interval_no = 1) a
      FULL OUTER JOIN (SELECT * FROM ({inner}) WHERE interval_no = 2) b
      ON a.server_id = b.server_id AND a.{name} = b.{name} AND a.is_total = b.is_total""", TWO)


def _sum_of(c: str, doubles) -> str:
    return sec(total(c)) if c in doubles else total(c)


def database_sql(diff: bool) -> str:
    x = """(SELECT x.*, l.datsize FROM x_db_ms x JOIN spans USING (interval_no) LEFT JOIN databases l
      ON l.server_id = x.server_id AND l.datid = x.datid AND l.sample_id = e)"""
    exprs = {c: _sum_of(c, ("blk_read_time", "blk_write_time")) for c in (*DB_VALUES, "datsize")}
    exprs["blks_hit_pct"] = pct("sum(blks_hit)", "sum(blks_hit) + sum(blks_read)")
    return _plain(_rollup(x, "dbname", exprs), "dbname", list(exprs), diff)


def session_sql(diff: bool) -> str:
    exprs = {c: total(c) for c in SESSIONS}
    return _plain(_rollup("x_sessions", "dbname", exprs), "dbname", list(exprs), diff)


def statement_db_sql(diff: bool) -> str:
    doubles = ("total_exec_time", "total_plan_time", "blk_read_time", "blk_write_time",
               "trg_fn_total_time")
    exprs = {c: _sum_of(c, doubles) for c in STMT_DB_VALUES}
    return _plain(_rollup("x_stmt_db_ms", "dbname", exprs), "dbname", list(exprs), diff)


def jit_db_sql(diff: bool) -> str:
    used = " + ".join(f"coalesce({c}, 0)" for c in JIT_COUNTERS)
    columns = ("calls", "total_exec_time", *JIT_COUNTERS, *JIT_TIMES)
    exprs = {c: _sum_of(c, ("total_exec_time", *JIT_TIMES)) for c in columns}
    x = f"(SELECT * FROM x_stmt_db_ms WHERE {used} > 0)"
    return _plain(_rollup(x, "dbname", exprs), "dbname", list(exprs), diff)


def wait_type_sql(diff: bool) -> str:
    inner = _rollup("x_waits_ms", "event_type", {"tot_waited": total("tot_waited"),
                                                "stmt_waited": total("stmt_waited")})
    shares = f"""SELECT r.* REPLACE ({sec('r.tot_waited')} AS tot_waited,
      {sec('r.stmt_waited')} AS stmt_waited), {pct('r.tot_waited', 't.a')} AS tot_waited_pct,
      {pct('r.stmt_waited', 't.b')} AS stmt_waited_pct FROM ({inner}) r JOIN (
        SELECT interval_no, server_id, sum(tot_waited) AS a, sum(stmt_waited) AS b FROM x_waits_ms
        GROUP BY interval_no, server_id) t USING (interval_no, server_id)"""
    return _plain(shares, "event_type",
                  ("tot_waited", "stmt_waited", "tot_waited_pct", "stmt_waited_pct"), diff)


def _metric_list(x: str, columns: dict[str, str], diff: bool) -> str:
    rows = " UNION ALL ".join(
        f"SELECT interval_no, server_id, '{name}' AS metric, NULLIF(CAST({e} AS DOUBLE), 0) AS value FROM {x}"
        for name, e in columns.items())
    if not diff:
        return x_sql(f"SELECT server_id, metric, value FROM ({rows})")
    return x_sql(f"""SELECT coalesce(a.server_id, b.server_id) AS server_id,
      coalesce(a.metric, b.metric) AS metric, a.value AS value_1, b.value AS value_2
      FROM (SELECT * FROM ({rows}) WHERE interval_no = 1) a FULL OUTER JOIN
      (SELECT * FROM ({rows}) WHERE interval_no = 2) b
      ON a.server_id = b.server_id AND a.metric = b.metric""", TWO)


def cluster_sql(diff: bool) -> str:
    return _metric_list("x_cluster", {c: c for c in (*_cl, "archived_count", "failed_count")}, diff)


def wal_sql(diff: bool) -> str:
    x = """(SELECT x.*, epoch(b.sample_time) - epoch(a.sample_time) AS dur FROM x_wal x
      JOIN spans USING (interval_no)
      LEFT JOIN samples a ON a.server_id = x.server_id AND a.sample_id = s
      LEFT JOIN samples b ON b.server_id = x.server_id AND b.sample_id = e)"""
    columns = {c: c for c in _wal}
    columns.update({
        "wal_bytes_per_sec": ratio("wal_bytes", "dur"), "wal_write_per_sec": ratio("wal_write", "dur"),
        "wal_sync_per_sec": ratio("wal_sync", "dur"),
        "wal_write_duty_pct": ratio("(CAST(wal_write_time AS DOUBLE) / 10)", "dur"),
        "wal_sync_duty_pct": ratio("(CAST(wal_sync_time AS DOUBLE) / 10)", "dur")})
    return _metric_list(x, columns, diff)


def size_text(c: str) -> str:
    """Size with units in plain SQL, for the values that occur here."""
    def unit(power: int) -> str:
        return f"floor(({c} + {1 << (10 * power - 1)}) / {1 << (10 * power)})"
    return f"""CASE WHEN {c} IS NULL THEN NULL WHEN {c} < 10240 THEN {c} || ' bytes'
      WHEN {unit(1)} < 10240 THEN CAST({unit(1)} AS BIGINT) || ' kB'
      WHEN {unit(2)} < 10240 THEN CAST({unit(2)} AS BIGINT) || ' MB'
      WHEN {unit(3)} < 10240 THEN CAST({unit(3)} AS BIGINT) || ' GB'
      ELSE CAST({unit(4)} AS BIGINT) || ' TB' END"""


def tablespace_sql(diff: bool) -> str:
    x = """(SELECT x.*, NULLIF(l.size, 0) AS size FROM x_spaces x JOIN spans USING (interval_no)
      LEFT JOIN tablespaces l ON l.server_id = x.server_id AND l.sample_id = e
        AND l.tablespaceid = x.tablespaceid)"""
    if not diff:
        return x_sql(f"""SELECT server_id, tablespaceid, tablespacename, tablespacepath, size,
          NULLIF(size_delta, 0) AS size_delta, {size_text('size')} AS size_text,
          {size_text('NULLIF(size_delta, 0)')} AS size_delta_text FROM {x}""")
    both = ", ".join(f"coalesce(a.{c}, b.{c}) AS {c}" for c in
                     ("server_id", "tablespaceid", "tablespacename", "tablespacepath"))
    return x_sql(f"""SELECT {both}, a.size AS size_1, b.size AS size_2,
      NULLIF(a.size_delta, 0) AS size_delta_1, NULLIF(b.size_delta, 0) AS size_delta_2
      FROM (SELECT * FROM {x} WHERE interval_no = 1) a FULL OUTER JOIN
      (SELECT * FROM {x} WHERE interval_no = 2) b
      ON a.server_id = b.server_id AND a.tablespaceid = b.tablespaceid""", TWO)

"""The driver's tables seen as a workload repository.

Both engines derive the same relations from the same SQL; only a few date and array spellings
differ per dialect. Amounts are whole numbers, so sums are exact in any order.

* ``li``: one row per lineitem row. Tick = 84-day period of the ship date (1..30), database =
  return flag, user = line status, query = part, table = supplier (its side table takes line
  numbers from 5), index = table and line number. Server = parity of the order key.
* ``ev``: one row per event. Tick = day of month (1..30), database = event type, function = user.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from counterlake.model import (ARCHIVER_COUNTERS, CLUSTER_COUNTERS, DATABASE_COUNTERS,
                               FUNCTION_COUNTERS, INDEX_COUNTERS, STATEMENT_SUMS,
                               TABLE_COUNTERS, USAGE_SUMS, WAL_COUNTERS, Repository)
from counterlake.operators import totals
from counterlake.session import materialise, partitions

TICKS = 30
PAGE = 65536
SOURCES = ("lineitem", "events", "orders", "documents", "conversations", "region", "nation",
           "customer", "supplier", "part")


def _s(expr: str) -> str:
    return f"CAST(sum({expr}) AS BIGINT)"


def _if(cond: str, expr: str = "1") -> str:
    return _s(f"CASE WHEN {cond} THEN {expr} ELSE 0 END")


def _only(cond: str, value: str) -> str:
    """The counter exists for some objects only, and is NULL for the others."""
    return f"CASE WHEN {cond} THEN {value} END"


def _tick(date: str) -> str:
    return f"CAST(1 + floor({{days:{date}}} / 84) AS INT)"


# datid of the databases whose counters restart every ten ticks: 'error' and 'R'
EPOCH = "CASE WHEN datid IN (101, 82) THEN floor((sample_id - 1) / 10) ELSE 0 END"
SERVER_EPOCH = "floor((sample_id - 1) / 10)"

TABLE_INC = {
    "seq_scan": "CAST(count(*) AS BIGINT)", "seq_tup_read": _s("qty"),
    "idx_scan": _only("relid % 4 <> 3", _if("ln IN (1, 3, 5, 7)")),
    "idx_tup_fetch": _only("relid % 4 <> 3", _s("disc")),
    "n_tup_ins": _if("ln IN (3, 6)", "qty"), "n_tup_upd": _if("ln IN (1, 4, 7)", "qty"),
    "n_tup_del": _if("ln IN (2, 5)", "qty"), "n_tup_hot_upd": _if("ln IN (1, 4, 7)", "tax"),
    "vacuum_count": _if("disc = 0"), "autovacuum_count": _if("disc = 1"),
    "analyze_count": _if("tax = 0"), "autoanalyze_count": _if("tax = 1"),
    # tables without an index or a side table have no such counters
    "heap_blks_read": _s("disc"), "heap_blks_hit": _s("qty"),
    "idx_blks_read": _only("relid % 4 <> 3", _s("tax")),
    "idx_blks_hit": _only("relid % 4 <> 3", _s("disc * 2")),
    "toast_blks_read": _only("relid % 10 = 0", _if("ln > 2", "disc")),
    "toast_blks_hit": _only("relid % 10 = 0", _if("ln > 2", "qty")),
    "tidx_blks_read": _only("relid % 10 = 0", _if("ln > 3", "tax")),
    "tidx_blks_hit": _only("relid % 10 = 0", _if("ln > 3", "disc")),
}
INDEX_INC = {
    "idx_scan": _if("ln <> 1", "qty"), "idx_tup_read": _s("qty * 2"), "idx_tup_fetch": _s("qty"),
    "idx_blks_read": _s("disc"), "idx_blks_hit": _s("qty + tax"),
}
FUNCTION_INC = {"calls": "CAST(count(*) AS BIGINT)", "total_time": _s("cents"),
                "self_time": _s("k")}
STATEMENT_INC = {
    "plans": _if("ln IN (2, 4, 6)"), "total_plan_time": _s("qty"),
    "calls": "CAST(count(*) AS BIGINT)", "total_exec_time": _s("price"), "rows": _s("qty"),
    "shared_blks_hit": _s("qty * 3"), "shared_blks_read": _s("disc"),
    "shared_blks_dirtied": _s("tax"), "shared_blks_written": _if("ln IN (1, 3)", "disc"),
    "local_blks_hit": _s("ln"), "local_blks_read": _if("ln > 5", "disc"),
    "local_blks_dirtied": _if("ln > 5", "tax"), "local_blks_written": _if("ln > 6", "tax"),
    "temp_blks_read": _if("ln = 2", "disc"), "temp_blks_written": _if("ln = 3", "tax"),
    "blk_read_time": _s("disc * 10"), "blk_write_time": _s("tax * 10"),
    "wal_records": _if("ln < 4", "qty"), "wal_fpi": _if("ln < 3"),
    "wal_bytes": _if("ln < 4", "price"), "jit_functions": _if("ln = 7", "qty"),
    "jit_generation_time": _if("ln = 7", "price"), "jit_inlining_count": _if("ln = 7", "disc"),
    "jit_inlining_time": _if("ln = 7", "disc * 7"), "jit_optimization_count": _if("ln = 7"),
    "jit_optimization_time": _if("ln = 7", "tax * 5"), "jit_emission_count": _if("ln = 7", "tax"),
    "jit_emission_time": _if("ln = 7", "tax * 3"),
}
USAGE_INC = {name: _s({
    "user_time": "disc + 1", "system_time": "tax + 1", "minflts": "qty", "majflts": "ln",
    "nswaps": "disc", "reads": "qty * 4", "writes": "tax * 8", "msgsnds": "ln",
    "msgrcvs": "ln", "nsignals": "tax", "nvcsws": "disc", "nivcsws": "qty"}[
        name.split("_", 1)[1]] + (" + qty" if name.startswith("exec") else "")) for name in USAGE_SUMS}
DATABASE_FROM_LI = {
    "xact_commit": _s("1"), "xact_rollback": _if("disc = 0"), "blks_read": _s("disc"),
    "blks_hit": _s("qty"), "tup_returned": _s("qty * 2"), "tup_fetched": _s("qty"),
    "tup_inserted": _if("ln IN (3, 6)", "qty"), "tup_updated": _if("ln IN (1, 4, 7)", "qty"),
    "tup_deleted": _if("ln IN (2, 5)", "qty"), "conflicts": _if("tax = 3"),
    "temp_files": _if("tax = 4"), "temp_bytes": _if("tax = 4", "price"),
    "deadlocks": _if("tax = 5"), "blk_read_time": _s("disc * 10"),
    "blk_write_time": _s("tax * 10"), "session_time": _s("price"), "active_time": _s("qty"),
    "idle_in_transaction_time": _s("disc"), "sessions": _s("ln"),
    "sessions_abandoned": _if("ln = 5"), "sessions_fatal": _if("ln = 6"),
    "sessions_killed": _if("ln = 7"), "size_inc": _s("qty * 8192"),
    "checksum_inc": _if("disc = 10 AND tax = 8"),
}
DATABASE_FROM_EV = {
    "xact_commit": _s("1"), "xact_rollback": _if("k < 10"), "blks_read": _s("k"),
    "blks_hit": _s("cents"), "tup_returned": _s("cents * 2"), "tup_fetched": _s("cents"),
    "tup_inserted": _if("k < 30", "cents"), "tup_updated": _if("k >= 70", "cents"),
    "tup_deleted": _if("k = 50", "cents"), "conflicts": _if("k = 3"), "temp_files": _if("k = 4"),
    "temp_bytes": _if("k = 4", "cents"), "deadlocks": _if("k = 5"), "blk_read_time": _s("k"),
    "blk_write_time": _if("k > 50", "k"), "session_time": _s("cents"), "active_time": _s("k"),
    "idle_in_transaction_time": _if("k < 50", "k"), "sessions": _s("1"),
    "sessions_abandoned": _if("k = 6"), "sessions_fatal": _if("k = 7"),
    "sessions_killed": _if("k = 8"), "size_inc": _s("cents"), "checksum_inc": _if("k = 99"),
}
CLUSTER_INC = {name: _s(expr) for name, expr in zip(CLUSTER_COUNTERS, (
    "1", "tax", "price", "disc", "qty", "disc + tax", "ln", "qty * 2", "tax", "qty + ln"))}
WAL_INC = {name: _s(expr) for name, expr in zip(WAL_COUNTERS, (
    "qty", "disc", "price", "tax", "ln", "1", "qty", "disc"))}
ARCHIVER_INC = {"archived_count": "CAST(count(*) AS BIGINT)", "failed_count": _if("k < 5")}


def _cols(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


def _running(columns: Iterable[str], by: str, table: str = "") -> str:
    return ", ".join(
        f"CAST(sum({table}{c}) OVER (PARTITION BY {by} ORDER BY sample_id) AS BIGINT) AS {c}"
        for c in columns)


def _dense(source: str, keys: str, columns: Iterable[str]) -> str:
    """Increments of every tick between the first and the last one of each object."""
    cols = list(columns)
    zeros = ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in cols)
    sums = ", ".join(f"{_s(c)} AS {c}" for c in cols)
    return f"""SELECT {keys}, sample_id, {sums} FROM (
      SELECT {keys}, sample_id, {", ".join(cols)} FROM {source} UNION ALL
      SELECT {keys}, {{explode:f,l}} AS sample_id, {zeros} FROM (
        SELECT {keys}, min(sample_id) AS f, max(sample_id) AS l FROM {source} GROUP BY {keys}))
      GROUP BY {keys}, sample_id"""


REL: dict[str, str] = {}
REL["li"] = f"""SELECT CAST(1 + l_orderkey % 2 AS INT) AS server_id,
  {_tick('l_shipdate')} AS sample_id, CAST(ascii(l_returnflag) AS BIGINT) AS datid,
  l_returnflag AS dbname, CAST(ascii(l_linestatus) AS BIGINT) AS userid,
  l_linestatus AS username, l_partkey AS queryid, l_linenumber <= 4 AS toplevel,
  CAST(l_linenumber AS BIGINT) AS ln, CAST(l_quantity AS BIGINT) AS qty,
  CAST(floor(l_extendedprice) AS BIGINT) AS price,
  CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax,
  CAST(10 * (l_suppkey + 1) + CASE WHEN l_linenumber >= 5 THEN 1 ELSE 0 END AS BIGINT) AS relid,
  CAST(1663 + l_suppkey % 3 AS BIGINT) AS tablespaceid FROM {{lineitem}}"""
REL["ev"] = """SELECT CAST(1 + event_id % 2 AS INT) AS server_id, CAST(day(ts) AS INT) AS sample_id,
  CAST(ascii(event_type) AS BIGINT) AS datid, event_type AS dbname, user_id AS funcid,
  user_id % 5 = 0 AS trg_fn, CAST(round(value * 100) AS BIGINT) AS cents,
  CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, CAST(ts AS DATE) AS on_day
  FROM {events}"""
REL["days"] = """SELECT server_id, sample_id, min(on_day) AS on_day FROM ev
  GROUP BY server_id, sample_id"""
REL["samples"] = """SELECT server_id, sample_id, {midnight:on_day,1} AS sample_time FROM days
  UNION ALL SELECT server_id, 0 AS sample_id, {midnight:min(on_day),0} AS sample_time FROM days
  GROUP BY server_id"""

# --- increments ---------------------------------------------------------------------------
REL["databases_li"] = f"""SELECT server_id, sample_id, datid, min(dbname) AS datname,
  {_cols(DATABASE_FROM_LI)} FROM li GROUP BY server_id, sample_id, datid"""
REL["databases_ev"] = f"""SELECT server_id, sample_id, datid, min(dbname) AS datname,
  {_cols(DATABASE_FROM_EV)} FROM ev GROUP BY server_id, sample_id, datid"""
_DB = ", ".join(["server_id", "sample_id", "datid", "datname", *DATABASE_FROM_LI])
REL["databases_inc"] = f"""SELECT {_DB} FROM databases_li UNION ALL
  SELECT {_DB} FROM databases_ev"""
REL["databases"] = f"""SELECT server_id, sample_id, datid, datname,
  {", ".join(DATABASE_COUNTERS)}, checksum_inc AS checksum_failures,
  CAST(NULL AS TIMESTAMP) AS checksum_last_failure, size_inc * 16 AS datsize,
  size_inc AS datsize_delta, FALSE AS datistemplate, {{epoch:{EPOCH}}} AS stats_reset
  FROM databases_inc"""
REL["tablespaces_inc"] = f"""SELECT server_id, sample_id, tablespaceid, {_s('qty * 8192')} AS size_inc
  FROM li GROUP BY server_id, sample_id, tablespaceid"""
REL["tablespaces"] = """SELECT server_id, sample_id, tablespaceid, size_inc * 3 AS size,
  size_inc AS size_delta FROM tablespaces_inc"""
REL["cluster_inc"] = f"""SELECT server_id, sample_id, {_cols(CLUSTER_INC)}, {_s('price')} AS wal_inc
  FROM li GROUP BY server_id, sample_id"""
REL["cluster"] = f"""SELECT server_id, sample_id, {", ".join(CLUSTER_COUNTERS)},
  wal_inc AS wal_size, {{epoch:{SERVER_EPOCH}}} AS stats_reset FROM cluster_inc"""
REL["wal_inc_rows"] = f"""SELECT server_id, sample_id, {_cols(WAL_INC)} FROM li
  GROUP BY server_id, sample_id"""
REL["wal"] = f"""SELECT server_id, sample_id, {", ".join(WAL_COUNTERS)},
  {{epoch:{SERVER_EPOCH}}} AS stats_reset FROM wal_inc_rows"""
REL["archiver_inc"] = f"""SELECT server_id, sample_id, {_cols(ARCHIVER_INC)} FROM ev
  GROUP BY server_id, sample_id"""
REL["archiver"] = f"""SELECT server_id, sample_id, {", ".join(ARCHIVER_COUNTERS)},
  {{epoch:floor((sample_id - 1) / 12)}} AS stats_reset FROM archiver_inc"""
REL["wait_profile"] = """SELECT server_id, sample_id, dbname AS event_type,
  concat('event_', CAST(k % 4 AS STRING)) AS event, funcid % 3 AS queryid, cents AS samples_seen
  FROM ev"""
REL["waits"] = f"""SELECT server_id, sample_id, event_type, event, {_s('samples_seen * 10')} AS tot_waited,
  CAST(sum(CASE WHEN queryid <> 0 THEN samples_seen * 10 END) AS BIGINT) AS stmt_waited
  FROM wait_profile GROUP BY server_id, sample_id, event_type, event"""
_TABLE_ATTRS = """CASE WHEN relid % 10 = 1 THEN 't' ELSE 'r' END AS relkind,
  CASE WHEN relid % 10 = 0 THEN relid + 1 END AS reltoastrelid"""
REL["tables_inc"] = f"""SELECT server_id, sample_id, datid, relid, min(tablespaceid) AS tablespaceid,
  {_cols(TABLE_INC)}, {_s('qty')} AS size_inc, {_s('disc * qty')} AS dead, {_s('tax * qty')} AS mods
  FROM li GROUP BY server_id, sample_id, datid, relid"""
_SIZES = f"""CASE WHEN sample_id % 4 <> 0 THEN size_inc * {PAGE} END AS relsize,
  size_inc * {PAGE} + 8192 AS relpages_bytes,
  CASE WHEN sample_id % 4 <> 0 THEN size_inc * 64 END AS relsize_diff,
  size_inc * 60 AS relpages_bytes_diff"""
REL["tables"] = f"""SELECT server_id, sample_id, datid, relid, tablespaceid, {_TABLE_ATTRS},
  {", ".join(TABLE_COUNTERS)}, size_inc * 10 AS n_live_tup, dead AS n_dead_tup,
  mods AS n_mod_since_analyze, CASE WHEN autovacuum_count > 0 THEN {{epoch:sample_id}} END AS last_autovacuum,
  CASE WHEN autoanalyze_count > 0 THEN {{epoch:sample_id - 1}} END AS last_autoanalyze, {_SIZES} FROM tables_inc"""
REL["indexes_inc"] = f"""SELECT server_id, sample_id, datid, relid, relid * 10 + ln AS indexrelid,
  min(tablespaceid) AS tablespaceid, {_cols(INDEX_INC)}, {_s('qty')} AS size_inc
  FROM li GROUP BY server_id, sample_id, datid, relid, ln"""
REL["indexes"] = f"""SELECT server_id, sample_id, datid, relid, indexrelid, tablespaceid,
  indexrelid % 10 = 2 AS indisunique, {", ".join(INDEX_COUNTERS)}, {_SIZES} FROM indexes_inc"""
REL["functions"] = f"""SELECT server_id, sample_id, datid, funcid, trg_fn, {_cols(FUNCTION_INC)}
  FROM ev GROUP BY server_id, sample_id, datid, funcid, trg_fn"""
_STMT_KEYS = "server_id, sample_id, datid, userid, queryid, toplevel"
REL["statements_inc"] = f"""SELECT {_STMT_KEYS}, min(username) AS username, {_cols(STATEMENT_INC)},
  CAST(min(price) AS DOUBLE) AS min_exec_time, CAST(max(price) AS DOUBLE) AS max_exec_time,
  CAST(floor(sum(price) / count(*)) AS DOUBLE) AS mean_exec_time,
  CAST(floor((max(price) - min(price)) / 2) AS DOUBLE) AS stddev_exec_time,
  CAST(min(qty) AS DOUBLE) AS min_plan_time, CAST(max(qty) AS DOUBLE) AS max_plan_time,
  CAST(floor(sum(qty) / count(*)) AS DOUBLE) AS mean_plan_time,
  CAST(floor((max(qty) - min(qty)) / 2) AS DOUBLE) AS stddev_plan_time
  FROM li GROUP BY {_STMT_KEYS}"""
_MOMENTS = ", ".join(f"{m}_{p}_time" for p in ("exec", "plan")
                     for m in ("min", "max", "mean", "stddev"))
# every query has up to five texts, one per seven ticks
_QTEXT = """concat('select  *\n from part_', CAST(queryid AS STRING), ' /* v',
  CAST(CAST(floor(sample_id / 7) AS INT) AS STRING), ' */')"""
_QNORM = _QTEXT.replace("  *\n ", " * ")
REL["statements"] = f"""SELECT {_STMT_KEYS}, username, md5({_QNORM}) AS queryid_md5,
  {", ".join(STATEMENT_SUMS)}, {_MOMENTS} FROM statements_inc"""
REL["statement_texts"] = f"SELECT {_STMT_KEYS}, {_QTEXT} AS query FROM statements_inc"
REL["usage"] = f"""SELECT {_STMT_KEYS}, min(md5({_QNORM})) AS queryid_md5, {_cols(USAGE_INC)}
  FROM li GROUP BY {_STMT_KEYS}"""

# --- dictionaries -------------------------------------------------------------------------
REL["tables_list"] = f"""SELECT server_id, datid, relid, {_TABLE_ATTRS},
  concat('schema_', CAST(datid AS STRING)) AS schemaname,
  concat('table_', CAST(relid AS STRING)) AS relname FROM tables_inc
  GROUP BY server_id, datid, relid"""
REL["indexes_list"] = """SELECT server_id, datid, relid, indexrelid,
  concat('ix_', CAST(indexrelid AS STRING)) AS indexrelname FROM indexes_inc
  GROUP BY server_id, datid, relid, indexrelid"""
REL["funcs_list"] = """SELECT server_id, datid, funcid,
  concat('schema_', CAST(datid AS STRING)) AS schemaname,
  concat('fn_', CAST(funcid AS STRING)) AS funcname, 'bigint' AS funcargs FROM functions
  GROUP BY server_id, datid, funcid"""
REL["roles_list"] = "SELECT server_id, userid, min(username) AS username FROM li GROUP BY server_id, userid"
REL["tablespaces_list"] = """SELECT server_id, tablespaceid,
  concat('space_', CAST(tablespaceid AS STRING)) AS tablespacename,
  concat('/data/', CAST(tablespaceid AS STRING)) AS tablespacepath FROM tablespaces_inc
  GROUP BY server_id, tablespaceid"""
REL["stmt_list"] = f"""SELECT server_id, md5({_QNORM}) AS queryid_md5, min({_QNORM}) AS query,
  CASE WHEN max(sample_id) < {TICKS} THEN CAST(max(sample_id) AS INT) END AS last_sample_id
  FROM statements_inc GROUP BY server_id, md5({_QNORM})"""

# --- cumulative snapshots -----------------------------------------------------------------
_DB_CUM = [*DATABASE_COUNTERS, "size_inc", "checksum_inc"]
REL["databases_dense"] = _dense("databases_inc", "server_id, datid, datname", _DB_CUM)
REL["databases_snap"] = f"""SELECT server_id, sample_id, datid, datname,
  {_running(DATABASE_COUNTERS, f"server_id, datid, {EPOCH}")},
  CAST(sum(size_inc) OVER (PARTITION BY server_id, datid ORDER BY sample_id) AS BIGINT) AS datsize,
  CAST(sum(checksum_inc) OVER (PARTITION BY server_id, datid ORDER BY sample_id) AS BIGINT)
    AS checksum_failures, FALSE AS datistemplate, {{epoch:{EPOCH}}} AS stats_reset
  FROM databases_dense"""
REL["tablespaces_snap"] = f"""SELECT server_id, sample_id, tablespaceid,
  CAST(sum(size_inc) OVER (PARTITION BY server_id, tablespaceid ORDER BY sample_id) AS BIGINT) AS size
  FROM tablespaces_inc"""
REL["cluster_snap"] = f"""SELECT server_id, sample_id,
  {_running(CLUSTER_COUNTERS, f"server_id, {SERVER_EPOCH}")},
  CAST(sum(wal_inc) OVER (PARTITION BY server_id ORDER BY sample_id) AS BIGINT) AS wal_size,
  {{epoch:{SERVER_EPOCH}}} AS stats_reset FROM cluster_inc"""
REL["wal_snap"] = f"""SELECT server_id, sample_id,
  {_running(WAL_COUNTERS, f"server_id, {SERVER_EPOCH}")},
  {{epoch:{SERVER_EPOCH}}} AS stats_reset FROM wal_inc_rows"""
REL["archiver_snap"] = f"""SELECT server_id, sample_id,
  {_running(ARCHIVER_COUNTERS, "server_id, floor((sample_id - 1) / 12)")},
  {{epoch:floor((sample_id - 1) / 12)}} AS stats_reset FROM archiver_inc"""
_SNAP_SIZES = f"""CASE WHEN sample_id % 4 <> 0 THEN {PAGE} * CAST(sum(size_inc)
    OVER (PARTITION BY KEYS ORDER BY sample_id) AS BIGINT) END AS relsize,
  8192 + {PAGE} * CAST(sum(size_inc) OVER (PARTITION BY KEYS ORDER BY sample_id) AS BIGINT)
    AS relpages_bytes"""
_TK = "server_id, datid, relid"
REL["tables_dense"] = _dense("tables_inc", f"{_TK}, tablespaceid",
                             [*TABLE_COUNTERS, "size_inc", "dead", "mods"])
REL["tables_snap"] = f"""SELECT server_id, sample_id, datid, relid, tablespaceid, {_TABLE_ATTRS},
  {_running(TABLE_COUNTERS, f"{_TK}, {EPOCH}")}, size_inc * 10 AS n_live_tup, dead AS n_dead_tup,
  mods AS n_mod_since_analyze, {_SNAP_SIZES.replace('KEYS', _TK)} FROM tables_dense"""
_IK = "server_id, datid, relid, indexrelid"
REL["indexes_dense"] = _dense("indexes_inc", f"{_IK}, tablespaceid", [*INDEX_COUNTERS, "size_inc"])
REL["indexes_snap"] = f"""SELECT server_id, sample_id, datid, relid, indexrelid, tablespaceid,
  indexrelid % 10 = 2 AS indisunique, {_running(INDEX_COUNTERS, f"{_IK}, {EPOCH}")},
  {_SNAP_SIZES.replace('KEYS', _IK)} FROM indexes_dense"""
_FK = "server_id, datid, funcid, trg_fn"
REL["functions_dense"] = _dense("functions", _FK, FUNCTION_COUNTERS)
REL["functions_snap"] = f"""SELECT server_id, sample_id, datid, funcid, trg_fn,
  {_running(FUNCTION_COUNTERS, f"{_FK}, {EPOCH}")} FROM functions_dense"""

# --- settings, baselines, servers, texts --------------------------------------------------
_OBS = "server_id, sample_id, setting_scope, name, setting, reset_val, boot_val, unit, sourcefile, sourceline, pending_restart"
REL["order_settings"] = f"""SELECT CAST(1 + o_orderkey % 2 AS INT) AS server_id,
  {_tick('o_orderdate')} AS sample_id, o_orderpriority AS name,
  {{max_by:o_orderstatus,o_orderkey}} AS setting, max(o_orderkey) % 2 = 0 AS pending_restart
  FROM {{orders}} GROUP BY CAST(1 + o_orderkey % 2 AS INT), {_tick('o_orderdate')}, o_orderpriority"""
REL["observed_raw"] = """SELECT server_id, sample_id, 1 AS setting_scope, name, setting,
  setting AS reset_val, 'O' AS boot_val, 'unit' AS unit, 'main.conf' AS sourcefile,
  1 AS sourceline, pending_restart FROM order_settings
  UNION ALL SELECT server_id, sample_id, 2, 'version',
    concat('v', CAST(CAST(floor(sample_id / 12) AS INT) AS STRING)),
    concat('v', CAST(CAST(floor(sample_id / 12) AS INT) AS STRING)),
    CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS INT), FALSE FROM days
  UNION ALL SELECT server_id, sample_id, 2, 'system_identifier',
    concat('70000', CAST(server_id AS STRING)), concat('70000', CAST(server_id AS STRING)),
    concat('70000', CAST(server_id AS STRING)), CAST(NULL AS STRING), CAST(NULL AS STRING),
    CAST(NULL AS INT), FALSE FROM days
  UNION ALL SELECT server_id, sample_id, 1, 'pg_stat_statements.max', '1000', '1000', '5000',
    CAST(NULL AS STRING), 'main.conf', 2, FALSE FROM days"""
REL["observed_settings"] = f"""SELECT o.server_id, o.sample_id, s.sample_time, setting_scope, name,
  setting, reset_val, boot_val, unit, sourcefile, sourceline, pending_restart
  FROM observed_raw o JOIN samples s ON o.server_id = s.server_id AND o.sample_id = s.sample_id"""
# baselines: one per region (id, name), its samples derived from nation keys
REL["baselines"] = """SELECT 1 AS server_id, CAST(r_regionkey AS INT) AS bl_id, r_name AS bl_name,
  CASE WHEN r_regionkey > 2 THEN {epoch:r_regionkey * 5} END AS keep_until FROM {region}"""
REL["bl_samples"] = """SELECT DISTINCT 1 AS server_id, CAST(1 + n_nationkey AS INT) AS sample_id,
  CAST(n_regionkey AS INT) AS bl_id FROM {nation}"""
REL["servers"] = """SELECT server_id, concat('server_', CAST(server_id AS STRING)) AS server_name,
  {midnight:min(on_day),0} AS server_created,
  CASE WHEN server_id = 2 THEN 12 END AS max_sample_age, max(sample_id) AS last_sample_id
  FROM days GROUP BY server_id"""

# --- the same relations as Spark computes them ----------------------------------------------
# The texts above stay the oracles'. Most keys here hold few rows, so sums taken before a shuffle would only make its rows
# wider: the narrow rows are dealt by object, and sums, densifying and running sums follow in place. Strings are no buffers
# of large aggregations, which would be sorted.


def _dealt(keys: str, source: str = "li") -> str:
    return f"(SELECT /*+ REPARTITION({{parts}}, {keys}) */ * FROM {source})"


def _whole(counters: dict[str, str]) -> str:
    return ", ".join(f"{_s(c)} AS {c}" for c in counters)


def _named_sums(source: str, counters: dict[str, str]) -> str:
    """Sums and the least name of a database: by name first, which leaves few rows to be sorted."""
    keys = "server_id, sample_id, datid"
    return f"""SELECT {keys}, min(dbname) AS datname, {_whole(counters)} FROM (
      SELECT {keys}, dbname, {_cols(counters)} FROM {source} GROUP BY {keys}, dbname) GROUP BY {keys}"""


def _dense_in_place(source: str, keys: str, more: str, columns: Iterable[str]) -> str:
    """``_dense`` where an object has one row a tick: each row is repeated, empty, up to the object's next one."""
    cols = list(columns)
    values = ", ".join(f"CASE WHEN sample_id IS NULL THEN {c} WHEN sample_id = own THEN coalesce({c}, 0) ELSE 0L END AS {c}"
                       for c in cols)
    following = f"lead(sample_id) OVER (PARTITION BY {keys}, {more} ORDER BY sample_id)"
    return f"""SELECT {keys}, {more}, sample_id, {values} FROM (
      SELECT {keys}, {more}, own, {", ".join(cols)}, explode(CASE WHEN own IS NULL THEN array(own)
        ELSE sequence(own, coalesce(following - 1, own)) END) AS sample_id FROM (
      SELECT {keys}, {more}, sample_id AS own, {", ".join(cols)}, {following} AS following FROM {source}))"""


def _one_order(name: str, keys: str) -> str:
    """Running sums of sizes along the order that the running counters have: epochs never fall along ticks."""
    return REL[name].replace(f"OVER (PARTITION BY {keys} ORDER BY sample_id)",
                             f"OVER (PARTITION BY {keys} ORDER BY {EPOCH}, sample_id)")


_STMT_OBJECT = "server_id, datid, userid, queryid, toplevel"
SPARK_REL: dict[str, str] = {
    **REL,
    "databases_li": _named_sums("li", DATABASE_FROM_LI),
    "databases_ev": _named_sums("ev", DATABASE_FROM_EV),
    "tables_inc": REL["tables_inc"].replace("FROM li", f"FROM {_dealt(_TK)}"),
    "indexes_inc": REL["indexes_inc"].replace("FROM li", f"FROM {_dealt(_TK)}"),
    "tables_dense": _dense_in_place("tables_inc", _TK, "tablespaceid", [*TABLE_COUNTERS, "size_inc", "dead", "mods"]),
    # indexes without an id share one key
    "indexes_dense": _dense_in_place(f"""(SELECT {_IK}, tablespaceid, sample_id,
      {", ".join(f"{_s(c)} AS {c}" for c in (*INDEX_COUNTERS, "size_inc"))} FROM indexes_inc
      GROUP BY {_IK}, tablespaceid, sample_id)""", _IK, "tablespaceid", [*INDEX_COUNTERS, "size_inc"]),
    "tables_snap": _one_order("tables_snap", _TK),
    "indexes_snap": _one_order("indexes_snap", _IK),
    "statements_inc": REL["statements_inc"].replace("FROM li", f"FROM {_dealt(_STMT_OBJECT)}"),
    "usage": f"""SELECT {_STMT_KEYS}, md5({_QNORM}) AS queryid_md5, {", ".join(USAGE_INC)} FROM (
      SELECT {_STMT_KEYS}, {_cols(USAGE_INC)} FROM {_dealt(_STMT_OBJECT)} GROUP BY {_STMT_KEYS})""",
    "roles_list": """SELECT server_id, userid, min(username) AS username FROM (
      SELECT DISTINCT server_id, userid, username FROM li) GROUP BY server_id, userid""",
    # the text depends on the query and the tick's seventh; ticks are reduced before texts are made
    "stmt_list": f"""SELECT server_id, md5({_QNORM}) AS queryid_md5, min({_QNORM}) AS query,
      CASE WHEN max(sample_id) < {TICKS} THEN CAST(max(sample_id) AS INT) END AS last_sample_id FROM (
      SELECT server_id, queryid, max(sample_id) AS sample_id FROM li
      GROUP BY server_id, queryid, CAST(floor(sample_id / 7) AS INT)) GROUP BY server_id, md5({_QNORM})""",
}
#: Source bytes of a task where narrow rows are dealt: about 150,000 lineitem rows.
DEALT_BYTES = 3_000_000


def _dialect(text: str, duck: bool) -> str:
    def macro(match: re.Match) -> str:
        name, body = match.group(1), match.group(2)
        if name == "days":
            return (f"date_diff('day', DATE '1995-01-01', CAST({body} AS DATE))" if duck
                    else f"datediff(CAST({body} AS DATE), DATE'1995-01-01')")
        if name == "explode":
            low, high = body.split(",")
            return (f"CAST(unnest(range({low}, {high} + 1)) AS INT)" if duck
                    else f"explode(sequence({low}, {high}))")
        if name == "midnight":
            day, plus = body.rsplit(",", 1)
            return (f"CAST({day} + {plus} AS TIMESTAMP)" if duck
                    else f"CAST(date_add({day}, {plus}) AS TIMESTAMP)")
        if name == "epoch":
            return (f"CAST(DATE '2024-01-01' + CAST({body} AS INT) AS TIMESTAMP)" if duck
                    else f"CAST(date_add(DATE'2024-01-01', CAST({body} AS INT)) AS TIMESTAMP)")
        if name == "max_by":
            value, by = body.split(",")
            return f"arg_max({value}, {by})" if duck else f"max_by({value}, {by})"
        raise ValueError(name)

    text = re.sub(r"\{(\w+):([^{}]+)\}", macro, text)
    if duck:
        text = re.sub(r"\{(\w+)\}", r"\1", text)
        text = re.sub(r"\bAS STRING\b", "AS VARCHAR", text)
    return text


def closure(sql: str, relations: dict[str, str]) -> list[str]:
    """Names of the relations that ``sql`` needs, in dependency order."""
    done: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"(?<![\w{.'])([a-z_]\w*)(?![\w(':])", text)):
            if word in relations and word not in done and word not in pending:
                pending.add(word)
                visit(relations[word])
                done.append(word)

    pending: set[str] = set()
    visit(sql)
    return done


def duck_with(sql: str, more: dict[str, str] | None = None) -> str:
    """``sql`` for DuckDB with the relations it uses as common table expressions."""
    relations = {**REL, **(more or {})}
    names = closure(sql, relations)
    ctes = ",\n".join(f"{n} AS ({_dialect(relations[n], True)})" for n in names)
    return (f"WITH {ctes}\n" if ctes else "") + _dialect(sql, True)


_SCHEMAS: dict[str, StructType] = {}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is inferred once per path."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One relation as a lazy DataFrame over the driver's tables."""
    sql = f"SELECT * FROM {name}"
    ctes = ",\n".join(f"{n} AS ({_dialect(SPARK_REL[n], False)})" for n in closure(sql, SPARK_REL))
    text = f"WITH {ctes}\n{sql}"
    if "{parts}" in text:
        text = text.replace("{parts}", str(partitions(spark, f"{sf_dir}/lineitem.parquet", DEALT_BYTES)))
    used = {s: source(spark, sf_dir, s) for s in SOURCES if "{" + s + "}" in text}
    return spark.sql(text, **used)


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One relation as a stored table: derived and written by Spark on first use in a session,
    as a repository keeps its tables."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _STORED:
        _STORED[at] = materialise(derive(spark, sf_dir, name), name)
    return _STORED[at]


#: Relations with many columns, of which a query reads a few.
WIDE = ("statements", "statement_texts", "usage", "tables", "indexes")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The stored table; a wide relation that is not stored yet is derived with the columns that its reader takes."""
    if name in WIDE and (spark.sparkContext.applicationId, sf_dir, name) not in _STORED:
        return derive(spark, sf_dir, name)
    return relation(spark, sf_dir, name)


FACT_NAMES = ("samples", "databases", "tablespaces", "cluster", "wal", "archiver", "waits",
              "tables", "indexes", "functions", "statements", "usage", "tables_list",
              "indexes_list", "funcs_list", "roles_list", "tablespaces_list", "stmt_list",
              "baselines", "bl_samples", "servers")


TOTALS = {
    "table_totals": (lambda r: totals.table_totals(r.tables), ("tables",)),
    "index_totals": (lambda r: totals.index_totals(r.indexes), ("indexes",)),
    "function_totals": (lambda r: totals.function_totals(r.functions), ("functions",)),
    "statement_totals": (lambda r: totals.statement_totals(r.statements, r.databases),
                         ("statements", "databases")),
    "usage_totals": (lambda r: totals.usage_totals(r.usage, r.databases), ("usage", "databases")),
}


def repository(spark: SparkSession, sf_dir: str,
               names: Iterable[str] = (*FACT_NAMES, *TOTALS)) -> Repository:
    """A repository whose facts are the projected increments of every object."""
    names = list(names)
    wanted = {n for n in names if n not in TOTALS}
    for name in names:
        wanted.update(TOTALS[name][1] if name in TOTALS else ())
    repo = Repository(**{n: view(spark, sf_dir, n) for n in sorted(wanted)})
    return repo.with_tables(**{n: TOTALS[n][0](repo) for n in names if n in TOTALS})

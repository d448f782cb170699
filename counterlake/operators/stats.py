"""Interval relations: facts summed per object over one or several intervals.

Every function reads its facts once for all requested intervals; results carry ``interval_no``.
Facts are reduced to one row per object and interval before names and totals are joined, so
dictionaries and totals meet already aggregated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlake.functions.text import short_hash
from counterlake.model import (DATABASE_COUNTERS, SERVER, STATEMENT_SUMS, TICK, TICK_BLOCK,
                               USAGE_FIELDS, USAGE_SUMS, Interval, Repository, grouped, pct,
                               ratio, scan, sums, tag_intervals, zero)
from counterlake.operators.availability import SESSION_COLUMNS

SPAN = ("interval_no", SERVER)


def _seconds(column: str) -> str:
    return f"CAST({column} AS DOUBLE) / 1000D"


def in_seconds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Millisecond columns as seconds. Sums are taken in milliseconds and converted last, so
    that whole-number inputs give the same result in any order of summation."""
    return df.selectExpr(*[f"{_seconds(c)} AS {c}" if c in columns else c for c in df.columns])


def _with_database(rows: DataFrame, repo: Repository, intervals: list[Interval],
                   user_only: bool = False, how: str = "inner") -> DataFrame:
    """Rows with the epoch of their database at their tick; ``user_only`` leaves templates out.

    The database side holds numbers only and the ticks of the intervals only.
    """
    known = scan(repo.databases, intervals, closed=True)
    if user_only:
        known = known.filter("NOT datistemplate")
    known = known.selectExpr(SERVER, TICK, "datid", "stats_reset AS db_epoch",
                             "true AS in_database")
    return rows.join(known, [SERVER, TICK, "datid"], how)


def _database_names(found: DataFrame, repo: Repository, intervals: list[Interval]) -> DataFrame:
    """Adds dbname, the name at the database's newest sample in the interval.

    Names meet aggregated rows only: strings in an aggregation buffer would force sorting.
    """
    rows = tag_intervals(repo.databases, intervals).selectExpr(*SPAN, TICK, "datid",
                                                               "datname AS dbname")
    # a window and no join with the newest tick: the size of a join is estimated as a product, so that few
    # names would not be broadcast and all objects would be dealt by their database
    newest = f"max({TICK}) OVER (PARTITION BY {', '.join(SPAN)}, datid)"
    names = rows.selectExpr("*", f"{newest} AS _newest").filter(f"{TICK} = _newest")
    return found.join(names.drop(TICK, "_newest"), [*SPAN, "datid"])


def _per_object(rows: DataFrame, intervals: list[Interval], keys: Sequence[str],
                aggregates: Sequence[str], having: str | None = None) -> DataFrame:
    """One row per interval, server and object. The number of a single interval is added behind: as a constant among
    the keys it would be part of the partitioning, and a join by object would have to move the sums again."""
    if len(intervals) > 1:
        return grouped(rows, (*SPAN, *keys), aggregates, having)
    return grouped(rows, (SERVER, *keys), aggregates, having).selectExpr("1 AS interval_no", "*")


def _with_totals(found: DataFrame, totals: DataFrame) -> DataFrame:
    """Objects beside the totals of their server. These are one row per interval and server, and no statistics say so: a
    join by server would bring all objects of a server into one task whenever its sums were ready before the totals."""
    return found.join(F.broadcast(totals), list(SPAN), "left")


# --- databases, cluster, WAL, tablespaces, waits -----------------------------------------

DB_TIMES = ("blk_read_time", "blk_write_time")


def _user_databases(repo: Repository, intervals: list[Interval]) -> DataFrame:
    rows = repo.databases.filter("NOT datistemplate").withColumnRenamed("datname", "dbname")
    return tag_intervals(rows, intervals)


def dbstats_ms(repo: Repository, intervals: list[Interval]) -> DataFrame:
    """Per database: sums of activity and the newest checksum failure."""
    summed = [c for c in DATABASE_COUNTERS if c not in SESSION_COLUMNS and c != "conflicts"]
    return grouped(_user_databases(repo, intervals), (*SPAN, "datid", "dbname"),
                   [*sums((*summed, "checksum_failures", "datsize_delta")),
                    "max(checksum_last_failure) AS checksum_last_failure"])


def dbstats(repo: Repository, intervals: list[Interval]) -> DataFrame:
    return in_seconds(dbstats_ms(repo, intervals), DB_TIMES)


def dbstats_sessions(repo: Repository, intervals: list[Interval]) -> DataFrame:
    return grouped(_user_databases(repo, intervals), (*SPAN, "datid", "dbname"),
                   sums(SESSION_COLUMNS))


def cluster_stats(repo: Repository, intervals: list[Interval]) -> DataFrame:
    """Sums of cluster activity with those of the archiver over the same samples."""
    other = (SERVER, TICK, TICK_BLOCK, "stats_reset", "epoch_restarted")
    own = [c for c in repo.cluster.columns if c not in other]
    rows = tag_intervals(repo.cluster, intervals).select(*SPAN, TICK, *own)
    both = ("archived_count", "failed_count")
    if repo.archiver is not None:
        archived = scan(repo.archiver, intervals).select(SERVER, TICK, *both)
        rows = rows.join(archived, [SERVER, TICK], "left")
    else:
        rows = rows.selectExpr("*", *[f"CAST(NULL AS BIGINT) AS {c}" for c in both])
    return grouped(rows, SPAN, sums((*own, *both)))


def wal_stats(repo: Repository, intervals: list[Interval]) -> DataFrame:
    columns = ("wal_records", "wal_fpi", "wal_bytes", "wal_buffers_full", "wal_write",
               "wal_sync", "wal_write_time", "wal_sync_time")
    return grouped(tag_intervals(repo.wal, intervals), SPAN, sums(columns))


def tablespace_stats(repo: Repository, intervals: list[Interval]) -> DataFrame:
    grown = grouped(tag_intervals(repo.tablespaces, intervals), (*SPAN, "tablespaceid"),
                    sums(["size_delta"]))
    names = repo.tablespaces_list.select(SERVER, "tablespaceid", "tablespacename",
                                         "tablespacepath")
    return grown.join(names, [SERVER, "tablespaceid"])


WAIT_TIMES = ("tot_waited", "stmt_waited")


def wait_stats_ms(repo: Repository, intervals: list[Interval]) -> DataFrame:
    """Waits per event, in total and by statements."""
    return grouped(tag_intervals(repo.waits, intervals), (*SPAN, "event_type", "event"),
                   sums(WAIT_TIMES))


def wait_stats(repo: Repository, intervals: list[Interval]) -> DataFrame:
    return in_seconds(wait_stats_ms(repo, intervals), WAIT_TIMES)


# --- tables and indexes ------------------------------------------------------------------

TABLE_SUMS = ("seq_scan", "seq_tup_read", "idx_scan", "idx_tup_fetch", "n_tup_ins", "n_tup_upd",
              "n_tup_del", "n_tup_hot_upd", "vacuum_count", "autovacuum_count", "analyze_count",
              "autoanalyze_count")
SIZES = ("relsize", "relpages_bytes", "relsize_diff", "relpages_bytes_diff")


def _after_start(intervals: list[Interval]) -> str:
    """True inside the half-open interval, for rows tagged with the closed one."""
    cases = " ".join(f"WHEN {n} THEN {i.start}" for n, i in enumerate(intervals, 1))
    return f"{TICK} > CASE interval_no {cases} END"


def _measured_at_both_ends(size: str, present: str = "true") -> str:
    """The size exists at the first and at the last sample the object has in [start, end]."""
    tick = f"CASE WHEN {present} THEN {TICK} END"
    sized = f"CASE WHEN {present} AND {size} IS NOT NULL THEN {TICK} END"
    return (f"coalesce(max({tick}) = max({sized}) AND min({tick}) = min({sized}), false)")


def _latest(column: str, out: str | None = None) -> str:
    return f"max_by({column}, CASE WHEN _in THEN {TICK} END) AS {out or column}"


def _inside_sum(expr: str, out: str) -> str:
    return f"sum(CASE WHEN _in THEN {expr} END) AS {out}"


def _bytes(count: str, size: str, out: str) -> str:
    product = f"CAST({count} AS DECIMAL(38,0)) * {size}"
    return f"CAST(sum(CASE WHEN _in THEN {product} END) AS BIGINT) AS {out}"


def _better(flag: str, sized: str, paged: str, out: str) -> str:
    return f"CASE WHEN {flag} THEN {sized} ELSE {paged} END AS {out}"


def top_tables(repo: Repository, intervals: list[Interval]) -> DataFrame:
    """Per table: activity of the table and its side table, growth and scanned bytes.

    Sizes measured at both ends of the closed interval decide whether growth is size or page
    based; scanned bytes are size based if a size exists for every tick with scans. Tablespace
    and side table are those of the newest sample.
    """
    facts = tag_intervals(repo.tables, intervals, closed=True).filter(
        "relkind IN ('r', 'm')").select(*SPAN, TICK, "datid", "relid", "tablespaceid",
                                        "reltoastrelid", *TABLE_SUMS, *SIZES)
    side = scan(repo.tables, intervals, closed=True).filter("relkind = 't'").selectExpr(
        SERVER, TICK, "datid", "relid AS reltoastrelid",
        *[f"{c} AS of_side_{c}" for c in (*TABLE_SUMS, *SIZES)], "true AS has_side")
    rows = facts.join(side, [SERVER, TICK, "datid", "reltoastrelid"], "left")
    rows = _with_database(rows, repo, intervals, user_only=True, how="left")
    rows = rows.selectExpr("*", f"({_after_start(intervals)} AND in_database IS NOT NULL) AS _in")

    def all_sized(scans: str, size: str, out: str) -> str:
        known = f"coalesce({scans}, 0) = 0 OR {size} IS NOT NULL"
        return f"bool_and(CASE WHEN _in THEN {known} END) AS {out}"

    found = _per_object(rows, intervals, ("datid", "relid"), [
        _latest("tablespaceid"), _latest("reltoastrelid"),
        *[_inside_sum(c, c) for c in TABLE_SUMS],
        *[_inside_sum(f"of_side_{c}", f"side_{c}") for c in TABLE_SUMS],
        *[column for part, out in (("", ""), ("of_side_", "side_")) for column in (
            _inside_sum(f"{part}relsize_diff", f"{out}growth"),
            _inside_sum(f"{part}relpages_bytes_diff", f"{out}page_growth"),
            _bytes(f"{part}seq_scan", f"{part}relsize", f"{out}scan_bytes_by_size"),
            _bytes(f"{part}seq_scan", f"{part}relpages_bytes", f"{out}scan_bytes_by_pages"),
            all_sized(f"{part}seq_scan", f"{part}relsize", f"{out}scan_sizes_known"))],
        f"{_measured_at_both_ends('relsize')} AS ends_sized",
        f"{_measured_at_both_ends('of_side_relsize', 'has_side')} AS side_ends_sized",
    ], having="count_if(_in) > 0")
    best = found.selectExpr("*", *[column for part in ("", "side_") for column in (
        _better(f"{part}ends_sized", f"{part}growth", f"{part}page_growth", f"best_{part}growth"),
        _better(f"{part}scan_sizes_known", f"{part}scan_bytes_by_size",
                f"{part}scan_bytes_by_pages", f"best_{part}scan_bytes"))])
    return _database_names(table_names(best, repo), repo, intervals)


def table_names(rows: DataFrame, repo: Repository) -> DataFrame:
    names = repo.tables_list.select(SERVER, "datid", "relid", "schemaname", "relname")
    spaces = repo.tablespaces_list.select(SERVER, "tablespaceid", "tablespacename")
    return (rows.join(names, [SERVER, "datid", "relid"])
                .join(spaces, [SERVER, "tablespaceid"]))


def _index_names(rows: DataFrame, repo: Repository) -> DataFrame:
    """Names of index and table; an index of a side table shows the main table's name."""
    indexes = repo.indexes_list.select(SERVER, "datid", "indexrelid", "indexrelname")
    tables = repo.tables_list.selectExpr(SERVER, "datid", "relid", "schemaname AS own_schema",
                                         "relname AS own_name")
    mains = repo.tables_list.filter("reltoastrelid IS NOT NULL").selectExpr(
        SERVER, "datid", "reltoastrelid AS relid", "schemaname AS main_schema",
        "concat(relname, '(TOAST)') AS main_name")
    spaces = repo.tablespaces_list.select(SERVER, "tablespaceid", "tablespacename")
    named = (rows.join(indexes, [SERVER, "datid", "indexrelid"])
                 .join(tables, [SERVER, "datid", "relid"])
                 .join(mains, [SERVER, "datid", "relid"], "left")
                 .join(spaces, [SERVER, "tablespaceid"]))
    return named.selectExpr(*rows.columns, "indexrelname", "tablespacename",
                            "coalesce(main_schema, own_schema) AS schemaname",
                            "coalesce(main_name, own_name) AS relname")


def top_indexes(repo: Repository, intervals: list[Interval]) -> DataFrame:
    """Per index: activity, DML and vacuums of its table, and growth.

    The vacuum columns estimate the bytes that vacuums of the table had to read from the index.
    """
    rows = tag_intervals(repo.indexes, intervals, closed=True).select(
        *SPAN, TICK, "datid", "relid", "indexrelid", "tablespaceid", "indisunique", "idx_scan",
        "idx_blks_read", "idx_blks_hit", *SIZES)
    changes = ("n_tup_ins", "n_tup_upd", "n_tup_del", "n_tup_hot_upd")
    of_table = (*changes, "vacuum_count", "autovacuum_count", "relsize", "relpages_bytes")
    owners = scan(repo.tables, intervals, closed=True).selectExpr(
        SERVER, TICK, "datid", "relid", *[f"{c} AS tbl_{c}" for c in of_table],
        "true AS has_table")
    rows = _with_database(rows.join(owners, [SERVER, TICK, "datid", "relid"], "left"), repo,
                          intervals, user_only=True, how="left")
    inside = f"{_after_start(intervals)} AND in_database IS NOT NULL AND has_table IS NOT NULL"
    rows = rows.selectExpr(
        "*", f"({inside}) AS _in", "coalesce(tbl_vacuum_count, 0) "
        "+ coalesce(tbl_autovacuum_count, 0) AS _vacuums")

    def mean_at_vacuum(size: str, out: str) -> str:
        value = f"CASE WHEN _in AND _vacuums > 0 THEN {size} END"
        return f"CAST(round(avg({value})) AS BIGINT) AS {out}"

    found = _per_object(rows, intervals, ("datid", "relid", "indexrelid"), [
        _latest("indisunique"), _latest("tablespaceid"),
        _inside_sum("idx_scan", "idx_scan"),
        _inside_sum("relsize_diff", "growth"),
        _inside_sum("relpages_bytes_diff", "page_growth"),
        *[_inside_sum(f"tbl_{c}", f"tbl_{c}") for c in changes],
        _inside_sum("idx_blks_read", "idx_blks_read"),
        _inside_sum("idx_blks_hit + idx_blks_read", "idx_blks_fetch"),
        _inside_sum("tbl_vacuum_count", "vacuum_count"),
        _inside_sum("tbl_autovacuum_count", "autovacuum_count"),
        _bytes("_vacuums", "relsize", "vacuum_bytes_by_size"),
        _bytes("_vacuums", "relpages_bytes", "vacuum_bytes_by_pages"),
        mean_at_vacuum("relsize", "mean_index_size"),
        mean_at_vacuum("tbl_relsize", "mean_table_size"),
        mean_at_vacuum("relpages_bytes", "mean_index_pages"),
        mean_at_vacuum("tbl_relpages_bytes", "mean_table_pages"),
        "count_if(_in AND _vacuums > 0 AND relsize IS NOT NULL) = "
        "count_if(_in AND _vacuums > 0) AS vacuum_sizes_known",
        f"{_measured_at_both_ends('relsize')} AS ends_sized",
    ], having="count_if(_in) > 0")
    best = found.selectExpr(
        "*",
        _better("ends_sized", "growth", "page_growth", "best_growth"),
        _better("vacuum_sizes_known", "vacuum_bytes_by_size", "vacuum_bytes_by_pages",
                "vacuum_bytes"))
    return _database_names(_index_names(best, repo), repo, intervals)


def _io_totals(repo: Repository, intervals: list[Interval], null_unless_all: bool) -> DataFrame:
    """Blocks read and fetched by all tables; with ``null_unless_all`` a missing part makes
    the total unknown."""
    parts = [f"sum({c})" for c in ("heap_blks_read", "idx_blks_read", "heap_blks_hit",
                                   "idx_blks_hit")]
    if not null_unless_all:
        parts = [zero(p) for p in parts]
    return grouped(tag_intervals(repo.table_totals, intervals), SPAN,
                   [f"{' + '.join(parts[:2])} AS total_read", f"{' + '.join(parts)} AS total_fetch"])


SAME_EPOCH = "min(db_epoch) = max(db_epoch)"


def top_io_tables(repo: Repository, intervals: list[Interval]) -> DataFrame:
    """Block reads and fetches per table with shares of all reads and fetches.

    Tables whose database was reset inside the interval are left out.
    """
    rows = tag_intervals(repo.tables, intervals).filter("relkind IN ('r', 'm')")
    rows = _with_database(rows, repo, intervals, user_only=True)
    kinds = ("heap", "idx", "toast", "tidx")
    found = _per_object(rows, intervals, ("datid", "relid"), [
        f"max_by(tablespaceid, {TICK}) AS tablespaceid",
        *[f"sum({k}_blks_read) AS {k}_blks_read" for k in kinds],
        *[f"coalesce(sum({k}_blks_read), 0) + coalesce(sum({k}_blks_hit), 0) AS {k}_blks_fetch"
          for k in kinds],
        *sums(("seq_scan", "idx_scan"))], having=SAME_EPOCH)
    fetched = " + ".join(f"{k}_blks_fetch" for k in kinds)
    read = " + ".join(zero(f"{k}_blks_read") for k in kinds)
    out = _with_totals(found, _io_totals(repo, intervals, False)).selectExpr(
        *found.columns,
        *[f"{pct(f'{k}_blks_{part}', f'total_{part}')} AS {k}_blks_{part}_pct"
          for k in kinds for part in ("read", "fetch")],
        f"{fetched} AS blks_fetch", f"{read} AS blks_read",
        f"{pct(f'({fetched}) - ({read})', fetched)} AS hit_pct")
    return _database_names(table_names(out, repo), repo, intervals)


def top_io_indexes(repo: Repository, intervals: list[Interval]) -> DataFrame:
    rows = _with_database(tag_intervals(repo.indexes, intervals), repo, intervals,
                          user_only=True)
    found = _per_object(rows, intervals, ("datid", "relid", "indexrelid"), [
        f"max_by(tablespaceid, {TICK}) AS tablespaceid",
        *sums(("idx_scan", "idx_blks_read", "idx_blks_hit"))], having=SAME_EPOCH)
    fetched = f"({zero('idx_blks_read')} + {zero('idx_blks_hit')})"
    out = _with_totals(found, _io_totals(repo, intervals, True)).selectExpr(
        *[c for c in found.columns if c != "idx_blks_hit"],
        f"{fetched} AS idx_blks_fetch",
        f"{pct('idx_blks_read', 'total_read')} AS idx_blks_read_pct",
        f"{pct('idx_blks_hit', fetched)} AS idx_blks_hit_pct",
        f"{pct(fetched, 'total_fetch')} AS idx_blks_fetch_pct")
    return _database_names(_index_names(out, repo), repo, intervals)


# --- functions ---------------------------------------------------------------------------

def top_functions(repo: Repository, intervals: list[Interval], trigger: bool = False
                  ) -> DataFrame:
    """Calls and times per function, in seconds, with mean times per call."""
    rows = tag_intervals(repo.functions, intervals).filter("trg_fn" if trigger else "NOT trg_fn")
    rows = _with_database(rows, repo, intervals, user_only=True)
    found = _per_object(rows, intervals, ("datid", "funcid"), sums(("calls", "total_time", "self_time")))
    out = found.selectExpr(
        *SPAN, "datid", "funcid", "calls",
        f"{_seconds('total_time')} AS total_time", f"{_seconds('self_time')} AS self_time",
        f"{ratio('total_time', 'calls')} / 1000D AS m_time",
        f"{ratio('self_time', 'calls')} / 1000D AS m_stime")
    names = repo.funcs_list.select(SERVER, "datid", "funcid", "schemaname", "funcname",
                                   "funcargs")
    return _database_names(out.join(names, [SERVER, "datid", "funcid"]), repo, intervals)


# --- statements --------------------------------------------------------------------------

def pooled_moments(mean: str, stddev: str, weight: str) -> tuple[str, str]:
    """SQL aggregates for the mean and population standard deviation of merged groups."""
    n = f"nullif(CAST(sum({weight}) AS DOUBLE), 0D)"
    merged = f"(sum({mean} * {weight}) / {n})"
    square = f"sum(({stddev} * {stddev} + {mean} * {mean}) * {weight}) / {n}"
    # products instead of power(): exact rounding, and no library call per row
    return merged, f"sqrt(greatest({square} - {merged} * {merged}, 0D))"


_TOTALLED = ("blk_read_time", "blk_write_time", "shared_blks_hit", "shared_blks_read",
             "shared_blks_dirtied", "temp_blks_read", "temp_blks_written", "local_blks_read",
             "local_blks_written", "calls", "plans")


def statement_interval_totals(repo: Repository, intervals: list[Interval]) -> DataFrame:
    return grouped(tag_intervals(repo.statement_totals, intervals), SPAN, [
        "coalesce(sum(total_plan_time), 0) + sum(total_exec_time) AS tot_time",
        *[f"sum({c}) AS tot_{c}" for c in _TOTALLED]])


def cluster_interval_totals(repo: Repository, intervals: list[Interval]) -> DataFrame:
    return grouped(tag_intervals(repo.cluster, intervals), SPAN, [
        "sum(buffers_checkpoint) + sum(buffers_clean) + sum(buffers_backend) AS tot_written",
        "sum(buffers_backend) AS tot_backend", "sum(wal_size) AS tot_wal_size"])


JIT_TIMES = ("jit_generation_time", "jit_inlining_time", "jit_optimization_time",
             "jit_emission_time")
JIT_COUNTERS = ("jit_functions", "jit_inlining_count", "jit_optimization_count",
                "jit_emission_count")
STATEMENT = ("datid", "userid", "queryid", "toplevel")
CPU_AND_IO = ("user_time", "system_time", "reads", "writes")


def _statement_columns() -> dict[str, str]:
    """Every column of the statement relation as SQL over sums, totals and usage."""
    time = "(total_exec_time + coalesce(total_plan_time, 0))"
    fetched = "(shared_blks_hit + shared_blks_read)"
    local = "(local_blks_hit + local_blks_read)"
    io = "(blk_read_time + blk_write_time)"
    plain = ("plans", "calls", "min_exec_time", "max_exec_time", "mean_exec_time",
             "stddev_exec_time", "min_plan_time", "max_plan_time", "mean_plan_time",
             "stddev_plan_time", "rows", "shared_blks_hit", "shared_blks_read",
             "shared_blks_dirtied", "shared_blks_written", "local_blks_hit", "local_blks_read",
             "local_blks_dirtied", "local_blks_written", "temp_blks_read", "temp_blks_written",
             "wal_records", "wal_fpi", "wal_bytes", *JIT_COUNTERS)
    columns = {c: c for c in plain}
    columns.update({c: _seconds(c) for c in ("total_plan_time", "total_exec_time",
                                             "blk_read_time", "blk_write_time", *JIT_TIMES)})
    columns.update({c: zero(c) for c in CPU_AND_IO})
    columns.update({
        "plans_pct": pct("plans", "tot_plans"),
        "calls_pct": pct("calls", "tot_calls"),
        "total_time": _seconds(time),
        "total_time_pct": pct(time, "tot_time"),
        "plan_time_pct": pct("total_plan_time", time),
        "total_exec_time_pct": pct("total_exec_time", "tot_time"),
        "exec_time_pct": pct("total_exec_time", time),
        "shared_hit_pct": pct("shared_blks_hit", fetched),
        "read_pct": pct("shared_blks_read", "tot_shared_blks_read"),
        "shared_blks_fetched": fetched,
        "shared_blks_fetched_pct": pct(fetched, "tot_shared_blks_hit + tot_shared_blks_read"),
        "dirtied_pct": pct("shared_blks_dirtied", "tot_shared_blks_dirtied"),
        "tot_written_pct": pct("shared_blks_written", "tot_written"),
        "backend_written_pct": pct("shared_blks_written", "tot_backend"),
        "local_hit_pct": pct("local_blks_hit", local),
        "local_blks_fetched": local,
        "io_time": _seconds(io),
        "io_time_pct": pct(io, "tot_blk_read_time + tot_blk_write_time"),
        "wal_bytes_pct": pct("wal_bytes", "tot_wal_size"),
        "jit_total_time": _seconds(f"({' + '.join(JIT_TIMES)})"),
        "jit_count": " + ".join(zero(c) for c in JIT_COUNTERS),
        "temp_io_blks": "temp_blks_read + temp_blks_written + local_blks_read"
                        " + local_blks_written",
    })
    columns.update({f"{k}_{op}_total_pct": pct(f"{k}_blks_{op}", f"tot_{k}_blks_{op}")
                    for k in ("temp", "local") for op in ("read", "written")})
    return columns


def _by_text_or_id(rows: DataFrame, by_text: bool) -> DataFrame:
    return rows.withColumn("queryid", short_hash(F.col("queryid_md5"))) if by_text else rows


def top_statements(repo: Repository, intervals: list[Interval], by_text: bool = False,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """Per statement: sums, shares of the totals, pooled moments, resource usage, JIT.

    ``by_text`` keys statements by the hash of their text instead of the source's query id.
    With ``columns`` only those are computed, and the totals and the usage facts are read only
    if a requested column needs them.
    """
    output = _statement_columns()
    if columns is not None:
        output = {c: e for c, e in output.items() if c in columns}
    text = " ".join(output.values())
    rows = _with_database(_by_text_or_id(tag_intervals(repo.statements, intervals), by_text),
                          repo, intervals)
    mean_exec, dev_exec = pooled_moments("mean_exec_time", "stddev_exec_time", "calls")
    mean_plan, dev_plan = pooled_moments("mean_plan_time", "stddev_plan_time", "plans")
    st = _per_object(rows, intervals, STATEMENT, [
        *sums(STATEMENT_SUMS),
        *[f"{f}({f}_{p}_time) AS {f}_{p}_time" for p in ("exec", "plan") for f in ("min", "max")],
        f"{mean_exec} AS mean_exec_time", f"{dev_exec} AS stddev_exec_time",
        f"{mean_plan} AS mean_plan_time", f"{dev_plan} AS stddev_plan_time"])
    if any(c in output for c in CPU_AND_IO):
        if repo.usage is not None:
            used = _by_text_or_id(tag_intervals(repo.usage, intervals), by_text)
            st = st.join(_per_object(used, intervals, STATEMENT, [
                f"coalesce(sum(exec_{c}), 0) + coalesce(sum(plan_{c}), 0) AS {c}"
                for c in CPU_AND_IO]), [*SPAN, *STATEMENT], "left")
        else:
            st = st.selectExpr("*", *[f"CAST(NULL AS BIGINT) AS {c}" for c in CPU_AND_IO])
    if any(f"tot_{c}" in text for c in ("time", *_TOTALLED)):
        st = _with_totals(st, statement_interval_totals(repo, intervals))
    if any(c in text for c in ("tot_written", "tot_backend", "tot_wal_size")):
        st = _with_totals(st, cluster_interval_totals(repo, intervals))
    out = st.selectExpr(*SPAN, *STATEMENT, *[f"{e} AS {c}" for c, e in output.items()])
    return _database_names(_role_names(out, repo), repo, intervals)


def _role_names(rows: DataFrame, repo: Repository) -> DataFrame:
    return rows.join(repo.roles_list.select(SERVER, "userid", "username"), [SERVER, "userid"])


def top_usage(repo: Repository, intervals: list[Interval], by_text: bool = False) -> DataFrame:
    """Per statement: CPU, IO and fault counts of planning and execution with shares."""
    rows = _with_database(_by_text_or_id(tag_intervals(repo.usage, intervals), by_text), repo,
                          intervals)
    used = _per_object(rows, intervals, STATEMENT, sums(USAGE_SUMS))
    totals = grouped(tag_intervals(repo.usage_totals, intervals), SPAN, [
        f"coalesce(sum(exec_{c}), 0) + coalesce(sum(plan_{c}), 0) AS tot_{c}"
        for c in CPU_AND_IO])
    both = {c: f"({zero(f'exec_{c}')} + {zero(f'plan_{c}')})" for c in USAGE_FIELDS}
    out = _with_totals(used, totals).selectExpr(
        *SPAN, *STATEMENT, *USAGE_SUMS,
        *[f"{pct(both[c], f'tot_{c}')} AS {c}_pct" for c in CPU_AND_IO],
        f"{both['user_time']} + {both['system_time']} AS cpu_time",
        f"{zero('exec_user_time')} + {zero('exec_system_time')} AS exec_cpu_time",
        f"{both['reads']} + {both['writes']} AS io_bytes",
        f"{zero('exec_reads')} + {zero('exec_writes')} AS exec_io_bytes")
    return _database_names(_role_names(out, repo), repo, intervals)


STATEMENT_DB_TIMES = ("total_exec_time", "total_plan_time", "blk_read_time", "blk_write_time",
                      *JIT_TIMES, "trg_fn_total_time")


def statements_dbstats_ms(repo: Repository, intervals: list[Interval]) -> DataFrame:
    """Statement totals per database with the time of its trigger functions."""
    triggers = scan(repo.function_totals, intervals).filter("trg_fn").selectExpr(
        SERVER, TICK, "datid", "total_time AS trg_time")
    rows = tag_intervals(repo.statement_totals, intervals).join(
        triggers, [SERVER, TICK, "datid"], "left")
    names = scan(repo.databases, intervals).selectExpr(SERVER, TICK, "datid",
                                                       "datname AS dbname")
    found = grouped(rows.join(names, [SERVER, TICK, "datid"]), (*SPAN, "datid", "dbname"),
                    [*sums((*STATEMENT_SUMS, "statements")),
                     "sum(trg_time) AS trg_fn_total_time"])
    return found.selectExpr(
        *SPAN, "datid", "dbname", "calls", "plans", *STATEMENT_DB_TIMES,
        "shared_blks_hit + shared_blks_read AS shared_gets",
        "local_blks_hit + local_blks_read AS local_gets",
        "shared_blks_dirtied", "local_blks_dirtied", "temp_blks_read", "temp_blks_written",
        "local_blks_read", "local_blks_written", "statements", "wal_bytes", *JIT_COUNTERS)


def statements_dbstats(repo: Repository, intervals: list[Interval]) -> DataFrame:
    return in_seconds(statements_dbstats_ms(repo, intervals), STATEMENT_DB_TIMES)

"""Selection of the objects worth keeping at each tick ("marking").

Inputs are increments (``counter_delta``) of every object; outputs are the keys to keep. Ties are
broken by the object key, which makes the selection deterministic.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlake.model import INDEXES, SERVER, STATEMENT_KEY, TABLES, TICK, SnapshotSpec
from counterlake.operators.delta import counter_delta
from counterlake.operators.ticks import sized
from counterlake.operators.topk import Metric, top_keys

TICK_GROUP = (SERVER, TICK)
_BLOCK_KINDS = ("heap", "idx", "toast", "tidx")


def _present(columns: Iterable[str]) -> str:
    """SQL: the sum of the columns that are not NULL."""
    return " + ".join(f"coalesce({c}, 0)" for c in columns)


# Which figures make an object worth keeping, by what they tell about it.
FUNCTION_METRICS = (
    Metric("calls", "calls"),
    Metric("time_with_callees", "total_time", exact=False),
    Metric("own_time", "self_time", exact=False),
)
INDEX_METRICS = (
    # work
    Metric("blocks_from_disk", "idx_blks_read"),
    Metric("blocks", "idx_blks_read + idx_blks_hit"),
    # waste: kept up to date without ever being scanned
    Metric("changes_without_use", "table_dml", keep="total_scans = 0", part="idx_scan = 0"),
    # upkeep: every vacuum of the table reads the index
    Metric("vacuumed_bytes", "cast(table_vacuums AS double) * relsize_carried", exact=False),
)
_CHANGES = ("n_tup_ins", "n_tup_upd", "n_tup_del")
TABLE_METRICS = (
    # work, side table included
    Metric("bytes_scanned", "cast(seq_scan AS double) * relsize"
           " + coalesce(cast(side.seq_scan AS double) * side.relsize, 0)", exact=False),
    Metric("rows_changed", " + ".join(_CHANGES) + " + " + _present(f"side.{c}" for c in _CHANGES)),
    Metric("rows_replaced", " + ".join(_CHANGES[1:]) + " + "
           + _present(f"side.{c}" for c in _CHANGES[1:])),
    # a table without index or side table has no such counters: absent parts count as nothing
    Metric("blocks_from_disk", _present(f"{k}_blks_read" for k in _BLOCK_KINDS)),
    Metric("blocks", _present(f"{k}_blks_{how}" for k in _BLOCK_KINDS for how in ("read", "hit"))),
    # waste
    Metric("dead_share", "cast(n_dead_tup AS double) / nullif(n_live_tup + n_dead_tup, 0)",
           exact=False),
    Metric("stale_share", "cast(n_mod_since_analyze AS double) / nullif(n_live_tup, 0)",
           exact=False),
    # upkeep
    Metric("vacuums", "vacuum_count + autovacuum_count"),
    Metric("analyzes", "analyze_count + autoanalyze_count"),
)
# Growth by measured size where it was measured this tick, otherwise by pages.
GROWTH_METRICS = (
    Metric("growth", "growth", keep="relsize IS NOT NULL"),
    Metric("page_growth", "page_growth", keep="relsize IS NULL AND relpages_bytes IS NOT NULL"),
)
_PLANNED = "total_plan_time IS NOT NULL"
STATEMENT_METRICS = (
    # work
    Metric("calls", "calls"),
    Metric("planning", "total_plan_time", keep=_PLANNED, exact=False),
    Metric("execution", "total_exec_time", exact=False),
    Metric("elapsed", "total_plan_time + total_exec_time", keep=_PLANNED, exact=False),
    # blocks
    Metric("blocks", "shared_blks_hit + shared_blks_read"),
    Metric("blocks_from_disk", "shared_blks_read"),
    Metric("blocks_dirtied", "shared_blks_dirtied"),
    Metric("blocks_written", "shared_blks_written"),
    Metric("private_blocks_read", "local_blks_read + temp_blks_read"),
    Metric("private_blocks_written", "local_blks_written + temp_blks_written"),
    # waiting for disks, and the log
    Metric("disk_waits", "blk_read_time + blk_write_time",
           keep=f"{_present(('blk_read_time', 'blk_write_time'))} > 0", exact=False),
    Metric("log_bytes", "wal_bytes", keep="wal_bytes IS NOT NULL"),
)
_PLAN_USED = f"{_present(('plan_user_time', 'plan_system_time'))} > 0"
USAGE_METRICS = (
    Metric("processor_planning", "plan_user_time + plan_system_time", keep=_PLAN_USED, exact=False),
    Metric("processor_execution", "exec_user_time + exec_system_time", exact=False),
    Metric("files_planning", "plan_reads + plan_writes", keep=_PLAN_USED),
    Metric("files_execution", "exec_reads + exec_writes"),
)


def mark_functions(deltas: DataFrame, topn: int) -> DataFrame:
    """Called functions within topn by any time or calls; trigger functions ranked apart."""
    called = deltas.filter(F.col("calls") > 0)
    marked = top_keys(called, (*TICK_GROUP, "trg_fn"), ("datid", "funcid"), FUNCTION_METRICS, topn)
    return marked.select(*TICK_GROUP, "datid", "funcid")


def with_total_scans(index_snapshots: DataFrame) -> DataFrame:
    """Index snapshots whose cumulative scan count stays on the rows as ``total_scans`` when
    ``counter_delta`` turns the counters into increments."""
    return index_snapshots.withColumn("total_scans", F.col("idx_scan"))


def mark_indexes(index_deltas: DataFrame, table_deltas: DataFrame, topn: int) -> DataFrame:
    """Indexes within topn by reads, gets, estimated vacuum bytes, or DML while unscanned.

    ``index_deltas`` are increments of ``with_total_scans`` snapshots: an index counts as unused
    only if it was never scanned.
    """
    key = (*TICK_GROUP, "datid", "relid")
    owners = table_deltas.select(
        *key, F.expr("vacuum_count + autovacuum_count").alias("table_vacuums"),
        F.expr("n_tup_ins + n_tup_upd + n_tup_del").alias("table_dml"))
    rows = sized(index_deltas, index_deltas, *key).join(sized(owners, index_deltas, *key), list(key))
    return top_keys(rows, TICK_GROUP, ("datid", "indexrelid"), INDEX_METRICS, topn)


def _growth(snapshots: DataFrame, databases: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """Growth of sizes and pages since the previous tick, whatever resets the owner had.

    The difference of two measured states needs no epoch. Rows of databases that are gone at their tick are left out.
    """
    known = in_known_databases(snapshots, databases)
    return counter_delta(known, replace(spec, counters=(), epoch=None, owner=()))


def mark_growing_indexes(index_snapshots: DataFrame, databases: DataFrame, topn: int) -> DataFrame:
    """Indexes within topn by growth; growth is measured across epoch changes."""
    rows = (_growth(index_snapshots, databases, INDEXES)
            .withColumn("growth", F.col("relsize_diff"))
            .withColumn("page_growth", F.col("relpages_bytes_diff")))
    return top_keys(rows, TICK_GROUP, ("datid", "indexrelid"), GROWTH_METRICS, topn)


def with_side_table(deltas: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Main tables with the same tick of their side table as struct ``side`` (NULL if none)."""
    main = deltas.filter(F.col("relkind").isin("r", "m"))
    side = deltas.select(SERVER, TICK, "datid", F.col("relid").alias("_side_relid"), F.lit(False).alias("_none"),
                         F.struct("relid", *columns).alias("side"))
    # main tables without a side table spread by their own id, and meet nothing
    left = (main.withColumn("_side_relid", F.coalesce("reltoastrelid", "relid"))
                .withColumn("_none", F.col("reltoastrelid").isNull()))
    on = [SERVER, TICK, "datid", "_side_relid"]
    return sized(left, deltas, *on).join(sized(side, deltas, *on), [*on, "_none"], "left").drop("_side_relid", "_none")


_SIDE_VALUES = ("seq_scan", "n_tup_ins", "n_tup_upd", "n_tup_del", "relsize")


def _both_tables(marked_rows: DataFrame) -> DataFrame:
    """Keys of marked main tables together with their side tables."""
    relids = F.array_compact(F.array(F.col("relid"), F.col("side_relid")))
    return marked_rows.select(*TICK_GROUP, "datid", F.explode(relids).alias("relid")).distinct()


def mark_tables(deltas: DataFrame, topn: int) -> DataFrame:
    """Tables within topn by any of nine metrics, with their side tables."""
    rows = with_side_table(deltas, _SIDE_VALUES)
    rows = rows.withColumn("side_relid", F.col("side.relid"))
    return _both_tables(top_keys(rows, TICK_GROUP, ("datid", "relid", "side_relid"),
                                 TABLE_METRICS, topn))


def mark_growing_tables(table_snapshots: DataFrame, databases: DataFrame, topn: int) -> DataFrame:
    """Tables within topn by growth including the side table, measured across epoch changes."""
    deltas = _growth(table_snapshots, databases, TABLES)
    rows = with_side_table(deltas, ("relsize_diff", "relpages_bytes_diff"))
    rows = (rows.withColumn("side_relid", F.col("side.relid"))
                .withColumn("growth", F.expr("relsize_diff + coalesce(side.relsize_diff, 0)"))
                .withColumn("page_growth", F.expr(
                    "relpages_bytes_diff + coalesce(side.relpages_bytes_diff, 0)")))
    return _both_tables(top_keys(rows, TICK_GROUP, ("datid", "relid", "side_relid"),
                                 GROWTH_METRICS, topn))


def tables_of_indexes(marked_indexes: DataFrame, index_rows: DataFrame,
                      table_rows: DataFrame) -> DataFrame:
    """Tables that marked indexes depend on: the table, its side table, and its main table."""
    place = [*TICK_GROUP, "datid"]
    owner = (index_rows.select(*place, "indexrelid", "relid")
             .join(marked_indexes, [*place, "indexrelid"], "left_semi")
             .select(*place, "relid").distinct())
    tables = table_rows.select(*place, "relid", "reltoastrelid")
    own = owner.join(tables, [*place, "relid"])
    present = own.select(*place, "relid")
    side = own.select(*place, F.col("reltoastrelid").alias("relid")).filter("relid IS NOT NULL")
    main = (tables.withColumnRenamed("relid", "_main").withColumnRenamed("reltoastrelid", "relid")
            .join(present, [*place, "relid"], "left_semi")
            .select(*place, F.col("_main").alias("relid")))
    keys = present.unionByName(side).unionByName(main).distinct()
    return keys.join(tables, [*place, "relid"], "left_semi")


def in_known_databases(rows: DataFrame, databases: DataFrame) -> DataFrame:
    """Drop rows of databases that are gone at the tick."""
    return rows.join(databases.select(SERVER, TICK, "datid"), [SERVER, TICK, "datid"],
                     "left_semi")


def mark_statements(statements: DataFrame, databases: DataFrame, topn: int) -> DataFrame:
    """Statements within topn by any of twelve metrics; unavailable metrics keep nothing."""
    return top_keys(in_known_databases(statements, databases), TICK_GROUP, STATEMENT_KEY,
                    STATEMENT_METRICS, topn)


def mark_usage(usage: DataFrame, databases: DataFrame, topn: int) -> DataFrame:
    """Statements within topn by planning or execution CPU and IO."""
    return top_keys(in_known_databases(usage, databases), TICK_GROUP, STATEMENT_KEY,
                    USAGE_METRICS, topn)


def select_marked(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Facts of the marked objects only."""
    return rows.join(marked, marked.columns, "left_semi")

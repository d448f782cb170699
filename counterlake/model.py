"""Data model: column roles of every snapshot table, intervals, and the repository."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERVER = "server_id"
TICK = "sample_id"
TICK_BLOCK = "tick_block"


@dataclass(frozen=True)
class SnapshotSpec:
    """Roles of the columns of one cumulative snapshot table.

    keys           object key inside a server (``server_id`` is always part of the key)
    counters       cumulative values, restart from zero when the epoch changes
    gauge_deltas   value column -> its growth column (the same name keeps only the growth);
                   survives an epoch change
    gauges         copied as they are
    carry          value columns whose NULLs stand for "not measured this tick"
    epoch          column that holds the reset epoch, or None when there is no epoch
    owner          key columns of the owner whose epoch governs this object
    strict_growth  growth over an epoch change is NULL when the previous value is NULL
    """

    name: str
    keys: tuple[str, ...] = ()
    counters: tuple[str, ...] = ()
    gauge_deltas: dict[str, str] = field(default_factory=dict)
    gauges: tuple[str, ...] = ()
    carry: tuple[str, ...] = ()
    epoch: str | None = None
    owner: tuple[str, ...] = ()
    strict_growth: bool = False

    @property
    def object_key(self) -> tuple[str, ...]:
        return (SERVER, *self.keys)

    @property
    def row_key(self) -> tuple[str, ...]:
        return (SERVER, TICK, *self.keys)


# ---------------------------------------------------------------------------
# The column names of the public statistics schema, per table.
# ---------------------------------------------------------------------------
DATABASE_COUNTERS = (
    "xact_commit", "xact_rollback", "blks_read", "blks_hit", "tup_returned", "tup_fetched",
    "tup_inserted", "tup_updated", "tup_deleted", "conflicts", "temp_files", "temp_bytes",
    "deadlocks", "blk_read_time", "blk_write_time", "session_time", "active_time",
    "idle_in_transaction_time", "sessions", "sessions_abandoned", "sessions_fatal",
    "sessions_killed",
)
TABLE_COUNTERS = (
    "seq_scan", "seq_tup_read", "idx_scan", "idx_tup_fetch", "n_tup_ins", "n_tup_upd",
    "n_tup_del", "n_tup_hot_upd", "vacuum_count", "autovacuum_count", "analyze_count",
    "autoanalyze_count", "heap_blks_read", "heap_blks_hit", "idx_blks_read", "idx_blks_hit",
    "toast_blks_read", "toast_blks_hit", "tidx_blks_read", "tidx_blks_hit",
)
INDEX_COUNTERS = ("idx_scan", "idx_tup_read", "idx_tup_fetch", "idx_blks_read", "idx_blks_hit")
FUNCTION_COUNTERS = ("calls", "total_time", "self_time")
CLUSTER_COUNTERS = (
    "checkpoints_timed", "checkpoints_req", "checkpoint_write_time", "checkpoint_sync_time",
    "buffers_checkpoint", "buffers_clean", "maxwritten_clean", "buffers_backend",
    "buffers_backend_fsync", "buffers_alloc",
)
WAL_COUNTERS = (
    "wal_records", "wal_fpi", "wal_bytes", "wal_buffers_full", "wal_write", "wal_sync",
    "wal_write_time", "wal_sync_time",
)
ARCHIVER_COUNTERS = ("archived_count", "failed_count")
STATEMENT_SUMS = (
    "plans", "total_plan_time", "calls", "total_exec_time", "rows", "shared_blks_hit",
    "shared_blks_read", "shared_blks_dirtied", "shared_blks_written", "local_blks_hit",
    "local_blks_read", "local_blks_dirtied", "local_blks_written", "temp_blks_read",
    "temp_blks_written", "blk_read_time", "blk_write_time", "wal_records", "wal_fpi",
    "wal_bytes", "jit_functions", "jit_generation_time", "jit_inlining_count",
    "jit_inlining_time", "jit_optimization_count", "jit_optimization_time",
    "jit_emission_count", "jit_emission_time",
)
USAGE_FIELDS = (
    "user_time", "system_time", "minflts", "majflts", "nswaps", "reads", "writes", "msgsnds",
    "msgrcvs", "nsignals", "nvcsws", "nivcsws",
)
USAGE_SUMS = tuple(f"{phase}_{name}" for phase in ("plan", "exec") for name in USAGE_FIELDS)
STATEMENT_KEY = ("datid", "userid", "queryid", "toplevel")

DATABASES = SnapshotSpec(
    "databases", ("datid", "datname"), DATABASE_COUNTERS,
    {"datsize": "datsize_delta", "checksum_failures": "checksum_failures"},
    ("datistemplate", "checksum_last_failure"), epoch="stats_reset", strict_growth=True,
)
TABLESPACES = SnapshotSpec("tablespaces", ("tablespaceid",), gauge_deltas={"size": "size_delta"})
CLUSTER = SnapshotSpec("cluster", (), CLUSTER_COUNTERS, {"wal_size": "wal_size"},
                       epoch="stats_reset", strict_growth=True)
WAL = SnapshotSpec("wal", (), WAL_COUNTERS, epoch="stats_reset")
ARCHIVER = SnapshotSpec("archiver", (), ARCHIVER_COUNTERS, gauges=(
    "last_archived_wal", "last_archived_time", "last_failed_wal", "last_failed_time"),
    epoch="stats_reset")
TABLES = SnapshotSpec(
    "tables", ("datid", "relid"), TABLE_COUNTERS,
    {"relsize": "relsize_diff", "relpages_bytes": "relpages_bytes_diff"},
    ("tablespaceid", "reltoastrelid", "relkind", "n_live_tup", "n_dead_tup",
     "n_mod_since_analyze", "n_ins_since_vacuum", "last_vacuum", "last_autovacuum",
     "last_analyze", "last_autoanalyze"),
    carry=("relsize",), epoch="stats_reset", owner=("datid",),
)
INDEXES = SnapshotSpec(
    "indexes", ("datid", "relid", "indexrelid"), INDEX_COUNTERS,
    {"relsize": "relsize_diff", "relpages_bytes": "relpages_bytes_diff"},
    ("tablespaceid", "indisunique"), carry=("relsize",), epoch="stats_reset", owner=("datid",),
)
FUNCTIONS = SnapshotSpec("functions", ("datid", "funcid"), FUNCTION_COUNTERS, gauges=("trg_fn",),
                         epoch="stats_reset", owner=("datid",))


@dataclass(frozen=True)
class Interval:
    """Samples ``start < sample_id <= end``; ``closed`` adds the start sample."""

    start: int
    end: int
    server_ids: tuple[int, ...] = ()

    def sql(self, tick: str = TICK, closed: bool = False) -> str:
        low = ">=" if closed else ">"
        inside = f"({tick} {low} {self.start} AND {tick} <= {self.end}"
        if self.server_ids:
            inside += f" AND {SERVER} IN ({', '.join(map(str, self.server_ids))})"
        return inside + ")"

    def contains(self, tick: str = TICK, closed: bool = False) -> Column:
        return F.expr(self.sql(tick, closed))


def scan(df: DataFrame, intervals: list[Interval], closed: bool = False) -> DataFrame:
    """The rows of any interval, read from no other tick blocks than theirs.

    Every reader of facts starts here, before it selects columns: the block column is the partition column of a stored
    table, and is gone afterwards.
    """
    if TICK_BLOCK in df.columns:
        size = Repository.TICKS_PER_PARTITION
        blocks = " OR ".join(f"{TICK_BLOCK} BETWEEN {i.start // size} AND {i.end // size}" for i in intervals)
        df = df.filter(blocks).drop(TICK_BLOCK)
    return df.filter(" OR ".join(i.sql(closed=closed) for i in intervals))


def tag_intervals(df: DataFrame, intervals: list[Interval], closed: bool = False) -> DataFrame:
    """Keep rows of any interval and add ``interval_no`` (1-based), reading the facts once.

    A row that lies in two overlapping intervals is emitted once per interval.
    """
    df, within = scan(df, intervals, closed), [i.sql(closed=closed) for i in intervals]
    if len(intervals) == 1:
        return df.selectExpr("*", "1 AS interval_no")
    numbers = ", ".join(f"CASE WHEN {c} THEN {n} END" for n, c in enumerate(within, 1))
    return df.selectExpr("*", f"explode(array_compact(array({numbers}))) AS interval_no")


@dataclass
class Repository:
    """The tables of one workload repository. Absent tables stay None."""

    samples: DataFrame | None = None
    servers: DataFrame | None = None
    databases: DataFrame | None = None
    tablespaces: DataFrame | None = None
    cluster: DataFrame | None = None
    wal: DataFrame | None = None
    archiver: DataFrame | None = None
    waits: DataFrame | None = None
    tables: DataFrame | None = None
    indexes: DataFrame | None = None
    functions: DataFrame | None = None
    statements: DataFrame | None = None
    usage: DataFrame | None = None
    table_totals: DataFrame | None = None
    index_totals: DataFrame | None = None
    function_totals: DataFrame | None = None
    statement_totals: DataFrame | None = None
    usage_totals: DataFrame | None = None
    tables_list: DataFrame | None = None
    indexes_list: DataFrame | None = None
    funcs_list: DataFrame | None = None
    stmt_list: DataFrame | None = None
    roles_list: DataFrame | None = None
    tablespaces_list: DataFrame | None = None
    settings: DataFrame | None = None
    baselines: DataFrame | None = None
    bl_samples: DataFrame | None = None

    FACTS = (
        "databases", "tablespaces", "cluster", "wal", "archiver", "waits", "tables", "indexes",
        "functions", "statements", "usage", "table_totals", "index_totals", "function_totals",
        "statement_totals", "usage_totals",
    )
    TICKS_PER_PARTITION = 64

    def present(self) -> dict[str, DataFrame]:
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        return {name: df for name, df in values.items() if df is not None}

    def with_tables(self, **tables: DataFrame) -> "Repository":
        return replace(self, **tables)

    def save(self, path: str) -> None:
        """Write every table as it is now, as a new version: facts in blocks of ticks, sorted so that parquet min/max prunes
        servers. Ticks or rows that the repository no longer has are gone for every later reader; tables may be saved over
        the folder that they were loaded from. ``counterlake.storage.Store`` changes single blocks."""
        from counterlake.storage import Store

        Store(next(iter(self.present().values())).sparkSession, path).save(self)

    @staticmethod
    def vacuum(spark: SparkSession, path: str) -> None:
        """Delete the files of versions that no longer count (no reader may be open on them)."""
        from counterlake.storage import Store

        Store(spark, path).vacuum()

    @classmethod
    def load(cls, spark: SparkSession, path: str, names: list[str] | None = None) -> "Repository":
        """The newest version of the named tables, or of all."""
        from counterlake.storage import Store

        return Store(spark, path).load(names)


def duplicate_keys(df: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """Key values that occur more than once (the engine has no primary keys)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
              .filter(F.col("n_rows") > 1))


def assert_unique(df: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    if duplicate_keys(df, keys).take(1):
        raise ValueError(f"duplicate key {tuple(keys)}")
    return df


def grouped(df: DataFrame, keys: Sequence[str], aggregates: Sequence[str],
            having: str | None = None) -> DataFrame:
    """SELECT keys, aggregates FROM df GROUP BY keys [HAVING ...]."""
    names = ", ".join(keys)
    text = f"SELECT {', '.join([*keys, *aggregates])} FROM {{rows}} GROUP BY {names}"
    if having:
        text += f" HAVING {having}"
    return df.sparkSession.sql(text, rows=df)


def sums(columns: Sequence[str]) -> list[str]:
    return [f"sum({c}) AS {c}" for c in columns]


def pct(part: str, whole: str) -> str:
    """SQL for 100 * part / whole as double; NULL when the whole is zero."""
    return f"(CAST({part} AS DOUBLE) * 100 / nullif(CAST({whole} AS DOUBLE), 0D))"


def ratio(part: str, whole: str) -> str:
    return f"(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0D))"


def zero(column: str) -> str:
    """SQL in which NULL counts as zero."""
    return f"coalesce({column}, 0)"

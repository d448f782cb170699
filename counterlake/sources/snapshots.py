"""Snapshot and increment sources.

A source is any DataFrame of rows per (server_id, sample_id, object). Readers return lazily;
``conform`` maps whatever a producer version delivers onto the fixed schema: missing columns
become typed NULLs, extra columns are dropped, so versions can be united.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterlake.functions.text import normalise_text, text_id
from counterlake.model import (SERVER, STATEMENT_SUMS, TICK, USAGE_SUMS, SnapshotSpec, grouped)

MOMENTS = tuple(f"{m}_{p}_time" for p in ("plan", "exec")
                for m in ("min", "max", "mean", "stddev"))
# Column types that are not bigint.
TYPES = {
    SERVER: "int", TICK: "int", "toplevel": "boolean", "trg_fn": "boolean",
    "indisunique": "boolean", "datistemplate": "boolean", "datname": "string",
    "queryid_md5": "string", "username": "string", "relkind": "string",
    "last_archived_wal": "string", "last_failed_wal": "string", "stats_reset": "timestamp",
    "checksum_last_failure": "timestamp", "last_vacuum": "timestamp",
    "last_autovacuum": "timestamp", "last_analyze": "timestamp",
    "last_autoanalyze": "timestamp", "last_archived_time": "timestamp",
    "last_failed_time": "timestamp", **{c: "double" for c in MOMENTS},
}


def read(spark: SparkSession, path: str, fmt: str = "parquet",
         schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Snapshot files (parquet, orc, json, csv) with an explicit schema where one is given."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int,
              upper: int, partitions: int, **options: str) -> DataFrame:
    """A remote snapshot table read in parallel ranges of ``partition_column``."""
    return (spark.read.format("jdbc").options(url=url, dbtable=table, **options)
            .option("partitionColumn", partition_column).option("lowerBound", lower)
            .option("upperBound", upper).option("numPartitions", partitions).load())


def conform(df: DataFrame, columns: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """The given columns in order; absent ones are NULL of their type unless required."""
    present = set(df.columns)
    missing = [c for c in columns if c not in present and c not in optional]
    if missing:
        raise ValueError(f"source lacks columns {missing}")
    return df.selectExpr(*[
        c if c in present else f"CAST(NULL AS {TYPES.get(c, 'bigint')}) AS {c}"
        for c in columns])


def snapshot_columns(spec: SnapshotSpec) -> list[str]:
    epoch = [spec.epoch] if spec.epoch and not spec.owner else []
    return list(dict.fromkeys([*spec.row_key, *spec.counters, *spec.gauge_deltas, *spec.gauges,
                               *epoch]))


def snapshot_source(df: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """Snapshots of one kind on the fixed schema; only the key columns are required."""
    columns = snapshot_columns(spec)
    return conform(df, columns, [c for c in columns if c not in spec.row_key])


def database_snapshots(df: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """Database snapshots without rows that carry no database name."""
    return snapshot_source(df.filter(F.col("datname").isNotNull()), spec)


def object_snapshots(df: DataFrame, spec: SnapshotSpec, servers: DataFrame | None = None,
                     databases: DataFrame | None = None) -> DataFrame:
    """Table, index or function snapshots without the databases a server excludes.

    ``servers.db_exclude`` is an array of database names; ``databases`` gives ids their names.
    """
    rows = snapshot_source(df, spec)
    if servers is None or databases is None:
        return rows
    excluded = (servers.select(SERVER, F.explode("db_exclude").alias("datname"))
                .join(databases.select(SERVER, TICK, "datid", "datname"), [SERVER, "datname"])
                .select(SERVER, TICK, "datid").distinct())
    return rows.join(excluded, [SERVER, TICK, "datid"], "left_anti")


STATEMENT_COLUMNS = (SERVER, TICK, "userid", "datid", "queryid", "toplevel", "username",
                     *STATEMENT_SUMS, *MOMENTS)
USAGE_COLUMNS = (SERVER, TICK, "userid", "datid", "queryid", "toplevel", *USAGE_SUMS)
# Names used by older producer versions -> names of the fixed schema.
OLD_STATEMENT_NAMES = {"total_time": "total_exec_time", "min_time": "min_exec_time",
                       "max_time": "max_exec_time", "mean_time": "mean_exec_time",
                       "stddev_time": "stddev_exec_time"}
OLD_USAGE_NAMES = {name: f"exec_{name}" for name in
                   ("user_time", "system_time", "minflts", "majflts", "nswaps", "reads",
                    "writes", "msgsnds", "msgrcvs", "nsignals", "nvcsws", "nivcsws")}


def _versions(sources: Sequence[DataFrame], columns: Sequence[str],
              old_names: dict[str, str]) -> DataFrame:
    """Producer versions united on the fixed schema; versions that cannot tell nested calls
    apart count every statement as top-level."""
    key = columns[:5]
    united = None
    for df in sources:
        renamed = df.withColumnsRenamed(old_names)
        if "toplevel" not in renamed.columns:
            renamed = renamed.withColumn("toplevel", F.lit(True))
        part = conform(renamed, columns, [c for c in columns if c not in key])
        united = part if united is None else united.unionByName(part)
    return united


def statement_increments(*sources: DataFrame) -> DataFrame:
    return _versions(sources, STATEMENT_COLUMNS, OLD_STATEMENT_NAMES)


def usage_increments(*sources: DataFrame) -> DataFrame:
    return _versions(sources, USAGE_COLUMNS, OLD_USAGE_NAMES)


def wait_profile(df: DataFrame, period: str = "period_ms") -> DataFrame:
    """Waits per event from a sampling profile (count of samples times sampling period).

    Samples without a statement (no id, or id 0) count in the total only.
    """
    waited = f"count * {period}"
    return grouped(df, (SERVER, TICK, "event_type", "event"), [
        f"sum({waited}) AS tot_waited",
        f"sum(CASE WHEN queryid IS NOT NULL AND queryid <> 0 THEN {waited} END) AS stmt_waited"])


def normalised_texts(df: DataFrame, text: str = "query", rename_temp: bool = False) -> DataFrame:
    """Rows with their text in normal form and its id."""
    normal = df.withColumn(text, normalise_text(F.col(text), rename_temp))
    return normal.withColumn("queryid_md5", text_id(F.col(text)))

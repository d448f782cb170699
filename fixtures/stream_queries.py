"""Registered queries for the streaming operators: the stored relations are read as streams,
drained with ``availableNow``, and the tables of the ledger are read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from counterlake import model as M
from counterlake.session import work_folder
from counterlake.streaming import deltas
from counterlake.streaming.ledger import Ledger, Step
from fixtures import model_queries as MQ
from fixtures.projection import duck_with, relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def as_stream(df: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """The files of a stored table as a stream."""
    reader = df.sparkSession.readStream.schema(df.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder = df.inputFiles()[0].rsplit("/", 1)[0]
    return reader.parquet(folder)


def drain(stream: DataFrame, step: Step, states: Sequence[str] = ("state",)) -> Ledger:
    """Run the stream to the end of its input; the tables are in the ledger."""
    spark = stream.sparkSession
    ledger = Ledger(spark, f"{work_folder(spark)}/stream-{uuid.uuid4().hex[:8]}", states)
    ledger.start(stream, step, availableNow=True).awaitTermination()
    return ledger


def _add(name: str, sql: str, plan: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = plan
    ORACLES[name] = duck_with(sql, MQ.Q)


_add("z1_stream_database_deltas", """SELECT * EXCLUDE (epoch_restarted, datistemplate) FROM d_databases""",
     lambda spark, sf: drain(as_stream(relation(spark, sf, "databases_snap")),
                             deltas.counter_deltas(M.DATABASES)).read("increments"))


def _table_deltas(spark: SparkSession, sf: str) -> DataFrame:
    # the owner's epoch is joined to the stream, which then carries its own epoch
    epochs = relation(spark, sf, "databases_snap").select(M.SERVER, M.TICK, "datid", "stats_reset")
    rows = as_stream(relation(spark, sf, "tables_snap")).join(epochs, [M.SERVER, M.TICK, "datid"])
    return drain(rows, deltas.counter_deltas(M.TABLES)).read("increments")


_TABLE_OUT = ", ".join(["server_id", "sample_id", "datid", "relid", *M.TABLE_COUNTERS, "relsize",
                        "relpages_bytes", "relsize_diff", "relpages_bytes_diff"])
_add("z1_stream_table_deltas", f"SELECT {_TABLE_OUT} FROM d_tables", _table_deltas)


def _window_sums(spark: SparkSession, sf: str) -> DataFrame:
    times = relation(spark, sf, "samples")
    rows = as_stream(relation(spark, sf, "functions")).join(times, [M.SERVER, M.TICK])
    sums = deltas.window_sums("sample_time", (M.SERVER, "datid"), ("calls", "total_time"),
                              "3 days", "1 day")
    ledger = drain(rows, sums, states=("open", "latest"))
    # at the end of the input the windows that are still open count as they are
    whole = ledger.read("closed").unionByName(ledger.read("open"))
    return MQ.text_time(whole, "window_start", "window_end")


_add("z2_stream_window_sums", """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(w + INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, server_id, datid,
  CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(total_time) AS BIGINT) AS total_time
  FROM (SELECT f.*, time_bucket(INTERVAL 3 DAY, s.sample_time, TIMESTAMP '1970-01-01') AS w
    FROM functions f JOIN samples s USING (server_id, sample_id)) GROUP BY w, server_id, datid""",
     _window_sums)

_LAST = " OR ".join(f"coalesce({c} <> p_{c}, FALSE)" for c in (
    "reset_val", "pending_restart", "sourcefile", "sourceline", "unit"))
_LAGS = ", ".join(f"lag({c}) OVER w AS p_{c}" for c in (
    "reset_val", "pending_restart", "sourcefile", "sourceline", "unit"))
_add("z3_stream_setting_changes", f"""SELECT server_id, setting_scope, name, setting, reset_val,
  boot_val, unit, sourcefile, sourceline, pending_restart,
  strftime(sample_time, '%Y-%m-%d %H:%M:%S') AS first_seen FROM (SELECT *, {_LAGS},
    row_number() OVER w AS nth FROM observed_settings
    WINDOW w AS (PARTITION BY server_id, setting_scope, name ORDER BY sample_id))
  WHERE nth = 1 OR {_LAST}""",
     lambda spark, sf: MQ.text_time(drain(as_stream(relation(spark, sf, "observed_settings")),
                                          deltas.setting_changes()).read("changes"), "first_seen"))

"""Streaming forms of the increment, change-capture and window operators, as steps of a ``Ledger``.

The increments and changes of a batch are those of the batch operators over the batch's rows and the newest row of every
object, so a stream gives what one pass over its history gives, in whole numbers of any size. Rows at or below the
stored tick of their object are late, as are all but one row of an object and tick; they go to the table ``late``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlake.model import SERVER, TICK, SnapshotSpec
from counterlake.operators.delta import counter_delta
from counterlake.operators.settings import COMPARED, SETTING_KEY, STORED, changed_rows
from counterlake.operators.ticks import TICKS_PER_BLOCK
from counterlake.streaming.ledger import Hold, Step, Stored

#: Rows of a batch for one task.
TASK_ROWS = 100_000


def _with_lateness(batch: DataFrame, state: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Adds ``_late``: the tick is not above the stored one, is missing, or repeats an earlier row of the batch."""
    if state is None:
        rows = batch.withColumn("_known", F.lit(None).cast("long"))
    else:
        rows = batch.join(state.select(*key, F.col(TICK).cast("long").alias("_known")), list(key), "left")
    first = W.partitionBy(*key, TICK).orderBy(*[c for c in batch.columns if c not in (*key, TICK)])
    old = F.coalesce(F.col(TICK) <= F.col("_known"), F.col(TICK).isNull())
    return rows.withColumn("_late", old | (F.row_number().over(first) > 1)).drop("_known")


def _newest(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    order = W.partitionBy(*key).orderBy(F.desc(TICK))
    return rows.withColumn("_nth", F.row_number().over(order)).filter("_nth <= 1").drop("_nth")


def counter_deltas(spec: SnapshotSpec, keep_ticks: int | None = None, block: int = TICKS_PER_BLOCK) -> Step:
    """Tables ``increments``, ``late`` and ``state``.

    The epoch column, if any, must be on the rows (an owner's epoch is joined to the stream before). Objects that have
    not reported for ``keep_ticks`` ticks of their server leave the state; if they return, they count in full.
    """
    spec = replace(spec, owner=())
    key = spec.object_key
    kept = list(dict.fromkeys([*spec.counters, *spec.gauge_deltas, *([spec.epoch] if spec.epoch else [])]))
    output = [*spec.row_key, *spec.counters, *[c for c, out in spec.gauge_deltas.items() if out != c],
              *spec.gauge_deltas.values()]

    def step(batch: DataFrame, stored: Stored, hold: Hold) -> dict[str, DataFrame]:
        state = stored("state")
        # dealt by object once: what follows works on objects, and a task gets so many rows however large the batch is
        usual = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        batch = batch.repartition(max(usual, batch.count() // TASK_ROWS), *key)
        judged = hold(_with_lateness(batch, state, key))
        rows = judged.filter("NOT _late").select(*spec.row_key, *kept, F.lit(False).alias("_stored"))
        if state is not None:
            rows = rows.unionByName(state.select(*rows.columns[:-1], F.lit(True).alias("_stored")))
        # the cumulative values stay beside their increments: they are the next state
        rows = rows.withColumn("_values", F.struct(*kept) if kept else F.struct(F.lit(0).alias("_none")))
        found = hold(counter_delta(rows, spec, block=block))
        values = [F.col(f"{c}_carried" if c in spec.carry else f"_values.{c}").alias(c) for c in kept]
        last = _newest(found.select(*spec.row_key, *values), key)
        if keep_ticks is not None:
            ends = last.groupBy(SERVER).agg(F.max(TICK).alias("_end"))
            last = last.join(ends, SERVER).filter(F.col(TICK) > F.col("_end") - keep_ticks).drop("_end")
        return {"increments": found.filter("NOT _stored").select(*output),
                "late": judged.filter("_late").drop("_late"), "state": last}

    return step


def setting_changes(null_safe: bool = False, block: int = TICKS_PER_BLOCK) -> Step:
    """Tables ``changes`` (the change log), ``late`` and ``state`` of observed settings, compared with the observation
    before; settings without a reset value are ignored. A new version of the source starts nothing anew."""

    def step(batch: DataFrame, stored: Stored, hold: Hold) -> dict[str, DataFrame]:
        state = stored("state")
        judged = hold(_with_lateness(batch.filter("reset_val IS NOT NULL"), state, SETTING_KEY))
        columns = list(dict.fromkeys([*SETTING_KEY, TICK, *STORED, *COMPARED, "sample_time"]))
        rows = judged.filter("NOT _late").select(*columns, F.lit(False).alias("_stored"))
        if state is not None:
            rows = rows.unionByName(state.withColumn("_stored", F.lit(True)))
        rows = hold(rows)
        changes = changed_rows(rows, SETTING_KEY, null_safe, block).filter("NOT _stored")
        return {"changes": changes.select(*SETTING_KEY, *STORED, F.col("sample_time").alias("first_seen")),
                "late": judged.filter("_late").drop("_late"), "state": _newest(rows, SETTING_KEY).select(*columns)}

    return step


def window_sums(time: str, keys: Sequence[str], columns: Sequence[str], width: str, lateness: str) -> Step:
    """Tables ``closed`` (sums of tumbling windows that ended before the watermark, each once), ``late`` and the states
    ``open`` (sums so far of the other windows) and ``latest`` (the newest time).

    The watermark is the newest time of the batches before, less ``lateness``. Rows whose window had ended by then, and
    rows without a time, go to ``late``: every row is in a sum or in that table.
    """
    sums = [F.sum(c).alias(c) for c in columns]
    delay = F.expr(f"INTERVAL {lateness}")

    def step(batch: DataFrame, stored: Stored, hold: Hold) -> dict[str, DataFrame]:
        before, latest = stored("open"), stored("latest")
        spark = batch.sparkSession
        newest = batch.agg(F.max(time).alias("latest"))
        known = spark.createDataFrame([(None,)], newest.schema) if latest is None else latest
        newest = hold(newest.unionByName(known).agg(F.max("latest").alias("latest")))
        passed, until = known.first()[0], newest.first()[0]
        windows = (batch.filter(F.col(time).isNotNull()).withColumn("_window", F.window(time, width))
                        .withColumn("window_start", F.col("_window.start")).withColumn("window_end", F.col("_window.end")))
        ended = F.coalesce(F.col("window_end") <= F.lit(passed).cast("timestamp") - delay, F.lit(False))
        group = ["window_start", "window_end", *keys]
        added = windows.filter(~ended).groupBy(*group).agg(*sums)
        if before is not None:
            added = added.unionByName(before).groupBy(*group).agg(*sums)
        added = hold(added)
        ends = F.coalesce(F.col("window_end") <= F.lit(until).cast("timestamp") - delay, F.lit(False))
        late = windows.filter(ended).select(*batch.columns).unionByName(batch.filter(F.col(time).isNull()))
        return {"closed": added.filter(ends), "late": late, "open": added.filter(~ends), "latest": newest}

    return step

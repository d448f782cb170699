"""Counter -> increment conversion for every snapshot table, in one pass over the snapshots.

The previous tick is found with a blocked lag (``ticks.previous_tick``): a single shuffle on
(object key, block of ticks) instead of the two a self-join needs, and no group larger than a
block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlake.model import SERVER, TICK, SnapshotSpec
from counterlake.operators.ticks import TICKS_PER_BLOCK, previous_tick


def owner_epochs(owners: DataFrame, spec: SnapshotSpec, null_epoch: str = "reset",
                 block: int = TICKS_PER_BLOCK) -> DataFrame:
    """Per (server, tick, owner): did the owner's epoch continue from tick - 1, or restart?"""
    key = (SERVER, *spec.owner)
    rows = previous_tick(owners.select(SERVER, TICK, *spec.owner, spec.epoch), key, [spec.epoch],
                         block=block)
    same, restarted = _epoch_flags(spec.epoch, null_epoch)
    return rows.select(SERVER, TICK, *spec.owner, same.alias("_same_epoch"),
                       restarted.alias("_restarted"))


def _epoch_flags(epoch: str, null_epoch: str) -> tuple[Column, Column]:
    exists = F.col("prev").isNotNull()
    before = F.col("prev")[epoch]
    if null_epoch == "same":
        same = before.eqNullSafe(F.col(epoch))
        return exists & same, exists & ~same
    return (exists & F.coalesce(before == F.col(epoch), F.lit(False)),
            exists & F.coalesce(before != F.col(epoch), F.lit(False)))


def counter_delta(snapshots: DataFrame, spec: SnapshotSpec, owners: DataFrame | None = None,
                  null_epoch: str = "reset", first_tick: str = "full",
                  block: int = TICKS_PER_BLOCK) -> DataFrame:
    """Increments of every object at every tick.

    Counters: value - previous value when tick - 1 exists in the same epoch, else the full
    value (``first_tick='null'`` gives NULL instead). Growth columns use the previous value even
    over an epoch change. With ``spec.owner`` the epoch is looked up in ``owners``; objects whose
    owner has no row at the tick are dropped. ``null_epoch='same'`` lets NULL equal NULL.
    """
    if spec.owner:
        epochs = owner_epochs(owners, spec, null_epoch, block)
        snapshots = snapshots.join(epochs, [SERVER, TICK, *spec.owner])
    values = [*spec.counters, *spec.gauge_deltas]
    if spec.epoch and not spec.owner:
        values.append(spec.epoch)
    rows = previous_tick(snapshots, spec.object_key, values, carry=spec.carry, block=block)
    if spec.epoch is None:
        same, restarted = F.col("prev").isNotNull(), F.lit(False)
    elif spec.owner:
        same, restarted = F.col("_same_epoch"), F.col("_restarted")
    else:
        same, restarted = _epoch_flags(spec.epoch, null_epoch)

    def increment(column: str, usable: Column) -> Column:
        before = F.when(usable, F.col("prev")[column])
        if first_tick == "null":
            return F.when(F.col("prev").isNotNull(), F.col(column) - F.coalesce(before, F.lit(0)))
        return F.col(column) - F.coalesce(before, F.lit(0))

    def growth(column: str) -> Column:
        if spec.strict_growth:
            over_reset = F.col(column) - F.col("prev")[column]
            return F.when(restarted, over_reset).otherwise(increment(column, same))
        return increment(column, same | restarted)

    extra = [spec.epoch] if spec.epoch and not spec.owner else []
    names = [c for c in snapshots.columns
             if c not in {*spec.row_key, *spec.counters, *spec.gauge_deltas, *extra,
                          "_same_epoch", "_restarted"}]
    carried = [F.col(f"{c}_carried") for c in spec.carry]
    flags = [F.coalesce(restarted, F.lit(False)).alias("epoch_restarted")] if spec.epoch else []
    return rows.select(
        *spec.row_key,
        *names,
        *[increment(c, same).alias(c) for c in spec.counters],
        *[c for c, out in spec.gauge_deltas.items() if out != c],
        *[growth(c).alias(out) for c, out in spec.gauge_deltas.items()],
        *carried, *extra, *flags)


def fill_missing_sizes(snapshots: DataFrame, spec: SnapshotSpec,
                       block: int = TICKS_PER_BLOCK) -> DataFrame:
    """Snapshots whose unmeasured sizes are taken from the preceding ticks."""
    rows = previous_tick(snapshots, spec.object_key, [TICK], carry=spec.carry, block=block)
    filled = {c: F.col(f"{c}_carried") for c in spec.carry}
    return rows.select(*[filled[c].alias(c) if c in filled else F.col(c)
                         for c in snapshots.columns])

"""Order-dependent primitives over ticks, split so that no key is processed in one piece.

A window over a whole key would put all ticks of that key into one task. Every primitive here
windows over (key, block of ticks) instead, so a group never exceeds ``block`` rows plus one:

* the *previous tick* needs one row of the preceding block, so the last row of each block is
  also sent to the next one (1/block extra rows, one shuffle, no join);
* *running last* values need a carry from all earlier blocks; the carries are computed on a
  narrow projection that is reduced to one row per (key, block) before any window runs. Filling
  reduces it by hash aggregation in the map tasks, so the narrow read sends one row per block.

Key columns are primary-key columns and hold no NULLs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlake.model import TICK
from counterlake.session import partitions

TICKS_PER_BLOCK = 256
#: Bytes of stored snapshots (some 50,000 wide rows) that one task sorts.
TASK_BYTES = 2_000_000


def _blocked(df: DataFrame, tick: str, block: int) -> DataFrame:
    """Add ``_blk``/``_carrier``; the last tick of a block is repeated as carrier of the next."""
    own = F.floor(F.col(tick) / block)
    here = F.struct(own.alias("blk"), F.lit(False).alias("carrier"))
    following = F.struct((own + 1).alias("blk"), F.lit(True).alias("carrier"))
    last = F.pmod(F.col(tick), F.lit(block)) == block - 1
    return (df.withColumn("_b", F.explode(F.when(last, F.array(here, following))
                                          .otherwise(F.array(here))))
              .withColumn("_blk", F.col("_b.blk")).withColumn("_carrier", F.col("_b.carrier"))
              .drop("_b"))


def previous_tick(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                  carry: Sequence[str] = (), tick: str = TICK,
                  block: int = TICKS_PER_BLOCK) -> DataFrame:
    """Add ``prev``: a struct of ``values`` at tick - 1, NULL when the object has no such row.

    Columns in ``carry`` are filled first: a NULL takes the latest value of the unbroken run of
    ticks before it (``<column>_carried`` is added, and ``prev`` holds the filled value).
    """
    order = W.partitionBy(*keys, "_blk").orderBy(tick)
    rows = sized(_blocked(df, tick, block), df, *keys, "_blk")
    if carry:
        rows = _run_state(rows, keys, carry, tick)
    before = [F.col(tick).alias("_tick"), *[F.col(v) for v in values if v not in carry],
              *([F.col("_run"), *[F.col(f"_seen_{c}") for c in carry]] if carry else [])]
    rows = rows.withColumn("_lag", F.lag(F.struct(*before)).over(order)).filter(~F.col("_carrier"))
    if carry:
        # joined behind all windows, so that a block is sorted once; the row before has the same carry
        rows = rows.join(_carries(df, keys, carry, tick, block), [*keys, "_blk"], "left")
        rows = rows.withColumns({f"{c}_carried": _filled(c, F.col) for c in carry})
    previous = F.struct(F.col("_lag._tick").alias("_tick"), *[
        (_filled(v, lambda name: F.col("_lag")[name]) if v in carry else F.col("_lag")[v]).alias(v) for v in values])
    adjacent = F.col("_lag._tick") == F.col(tick) - 1
    return (rows.withColumn("prev", F.when(adjacent, previous))
                .drop("_lag", "_blk", "_carrier", "_run", *[f"_seen_{c}" for c in carry], *[f"_in_{c}" for c in carry]))


def sized(rows: DataFrame, df: DataFrame, *by: str) -> DataFrame:
    """Rows in so many partitions that a task sorts about ``TASK_BYTES`` of the files below ``df``, however large they
    are. Rows that come from no files, or from few, are left to the session."""
    files = df.inputFiles()
    parts = partitions(df.sparkSession, files, TASK_BYTES) if files else 0
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *by) if parts > usual else rows


def _run_state(blocked: DataFrame, keys: Sequence[str], carry: Sequence[str],
               tick: str) -> DataFrame:
    """Within a block: where the current run began, and the latest measured value per column."""
    order = W.partitionBy(*keys, "_blk").orderBy(tick)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.lag(tick).over(order)
    starts_run = ~F.col("_carrier") & (before.isNull() | (before != F.col(tick) - 1))
    out = blocked.withColumn("_starts", F.when(starts_run, F.col(tick)))
    out = out.withColumn("_run", F.max("_starts").over(upto)).drop("_starts")
    for c in carry:
        seen = F.when(F.col(c).isNotNull(), F.struct(F.col(tick).alias("t"), F.col(c).alias("v")))
        out = out.withColumn(f"_seen_{c}", F.last(seen, ignorenulls=True).over(upto))
    return out


def _filled(c: str, of: Callable[[str], Column]) -> Column:
    """The value carried to a row, of whose run state ``of`` gives the columns: the latest one of this block if it was
    measured inside the current run, or what came into the block."""
    run, seen = of("_run"), of(f"_seen_{c}")
    own = F.when(run.isNull() | (seen["t"] >= run), seen["v"])
    return F.when(run.isNull() & seen.isNull(), F.col(f"_in_{c}")["v"]).otherwise(own)


def _block_ends(df: DataFrame, keys: Sequence[str], carry: Sequence[str], tick: str,
                block: int) -> DataFrame:
    """One row per (key, block), by hashing alone: the last tick present (``_last``, counted from
    the block's start), whether all ticks up to it are present (``_whole``), and for each column
    the offset of its latest measurement (``_at_``) and the fill of the last tick (``_fill_``).

    The ticks present are kept as bits, 64 to a word, so map tasks reduce a block to one row.
    """
    offset = F.pmod(F.col(tick), F.lit(block)).cast("int")
    words = range(-(-block // 64))
    rows = df.select(*keys, F.floor(F.col(tick) / block).alias("_blk"), offset.alias("_off"), *carry)
    bit = F.expr("shiftleft(1L, _off % 64)")
    out = rows.groupBy(*keys, "_blk").agg(
        F.max("_off").alias("_last"), F.count(F.lit(1)).alias("_rows"),
        *[F.bit_or(F.when(F.expr(f"_off DIV 64 = {w}"), bit).otherwise(F.lit(0).cast("long")))
          .alias(f"_word_{w}") for w in words],
        *[F.max(F.when(F.col(c).isNotNull(), F.col("_off"))).alias(f"_at_{c}") for c in carry],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_off"))).alias(f"_value_{c}")
          for c in carry])

    def unbroken(since: str) -> Column:
        """Are all ticks from ``since`` to the last one present?"""
        checks = []
        for w in words:
            low, high = f"greatest({since}, {64 * w})", f"least(_last, {64 * w + 63})"
            asked = (f"shiftleft(-1L, {low} - {64 * w}) & "
                     f"shiftrightunsigned(-1L, {64 * w + 63} - {high})")
            checks.append(f"({low} > {high} OR (_word_{w} & {asked}) = ({asked}))")
        return F.expr(" AND ".join(checks))

    return out.select(*keys, "_blk", "_last", (F.col("_rows") == F.col("_last") + 1).alias("_whole"),
                      *[f"_at_{c}" for c in carry],
                      *[F.when(F.col(f"_at_{c}").isNotNull() & unbroken(f"_at_{c}"),
                               F.col(f"_value_{c}")).alias(f"_fill_{c}") for c in carry])


def _carries(df: DataFrame, keys: Sequence[str], carry: Sequence[str], tick: str, block: int) -> DataFrame:
    """What comes into each block of a key (``_in_``), from all its earlier blocks."""
    ends = _block_ends(df, keys, carry, tick, block)
    order = W.partitionBy(*keys).orderBy("_blk")
    follows = ((F.lag("_blk").over(order) == F.col("_blk") - 1)
               & (F.lag("_last").over(order) == block - 1))
    ends = ends.withColumn("_follows", F.coalesce(follows, F.lit(False)))
    # An unbroken block without a measurement that goes on from the block before passes on what
    # came in (settled = NULL); every other block ends with a fill of its own, which may be NULL.
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    return ends.select(*keys, "_blk", *[
        F.last(F.when(~(F.col("_follows") & F.col("_whole") & F.col(f"_at_{c}").isNull()),
                      F.struct(F.col(f"_fill_{c}").alias("v"))), ignorenulls=True)
        .over(earlier).alias(f"_in_{c}") for c in carry])


def running_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                 value: Column, out: str, inclusive: bool = True) -> DataFrame:
    """Latest non-NULL ``value`` of the key at or before (or strictly before) each row.

    ``block`` must be non-decreasing along ``order``; it only bounds the group size and never
    changes the result. ``value`` should be a struct when a measured NULL has to be kept.
    """
    tagged = df.withColumn("_blk", block).withColumn("_val", value)
    sort_key = F.struct(*[F.col(c) for c in order])
    ends = tagged.groupBy(*keys, "_blk").agg(
        F.max_by("_val", F.when(F.col("_val").isNotNull(), sort_key)).alias("_end"))
    earlier = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*keys, "_blk",
                          F.last("_end", ignorenulls=True).over(earlier).alias("_in"))
    frame = (W.partitionBy(*keys, "_blk").orderBy(*order)
              .rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1))
    local = tagged.withColumn("_here", F.last("_val", ignorenulls=True).over(frame))
    return (local.join(carried, [*keys, "_blk"], "left")
            .withColumn(out, F.coalesce("_here", "_in"))
            .drop("_blk", "_val", "_here", "_in"))


def previous_present(df: DataFrame, keys: Sequence[str], values: Sequence[str], out: str = "prev",
                     tick: str = TICK, block: int = TICKS_PER_BLOCK) -> DataFrame:
    """Add ``out``: a struct of ``values`` of the key's previous row, however old it is."""
    return running_last(df, keys, [tick], F.floor(F.col(tick) / block),
                        F.struct(*values), out, inclusive=False)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str,
              right_time: str, payload: Sequence[str], block_seconds: int = 86_400) -> DataFrame:
    """Each left row with the payload of the latest right row with the same ``by`` values and
    ``right_time <= left_time`` (NULL when there is none). One union, no range join."""
    lefts = left.select(*by, F.col(left_time).alias("_at"), F.lit(1).alias("_side"),
                        F.struct(*left.columns).alias("_row"),
                        F.lit(None).cast(_payload_type(right, payload)).alias("_pay"))
    rights = right.select(*by, F.col(right_time).alias("_at"), F.lit(0).alias("_side"),
                          F.lit(None).cast(left.schema.simpleString()).alias("_row"),
                          F.struct(*payload).alias("_pay"))
    both = lefts.unionByName(rights)
    epoch = F.unix_timestamp(F.col("_at").cast("timestamp"))
    found = running_last(both, by, ["_at", "_side"], F.floor(epoch / block_seconds),
                         F.col("_pay"), "_found")
    return (found.filter("_side = 1")
                 .select("_row.*", *[F.col(f"_found.{p}").alias(p) for p in payload]))


def _payload_type(right: DataFrame, payload: Sequence[str]) -> str:
    return right.select(*payload).schema.simpleString()

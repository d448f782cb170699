"""Settings change log: capture, as-of lookup, interval view and comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlake.model import SERVER, TICK, Interval
from counterlake.operators.ticks import TICKS_PER_BLOCK, previous_present, running_last

SETTING_KEY = (SERVER, "setting_scope", "name")
COMPARED = ("reset_val", "pending_restart", "sourcefile", "sourceline", "unit")
STORED = ("setting", "reset_val", "boot_val", "unit", "sourcefile", "sourceline",
          "pending_restart")
# Names of the settings with a special meaning, and the scope of the first.
VERSION_NAME, VERSION_SCOPE = "version", 2
IDENTITY_NAME = "system_identifier"
CAPACITY_NAME = "pg_stat_statements.max"


def _differs(name: str, null_safe: bool) -> Column:
    before = F.col(f"prev.{name}")
    if null_safe:
        return ~before.eqNullSafe(F.col(name))
    return F.coalesce(before != F.col(name), F.lit(False))


def version_epochs(observed: DataFrame, block: int = TICKS_PER_BLOCK) -> DataFrame:
    """Per (server, tick): the tick at which the running version was first observed."""
    versions = observed.filter((F.col("name") == VERSION_NAME)
                               & (F.col("setting_scope") == VERSION_SCOPE))
    versions = versions.select(SERVER, TICK, "setting")
    stepped = previous_present(versions, (SERVER,), ("setting",), block=block)
    changed = F.col("prev").isNull() | (F.col("prev.setting") != F.col("setting"))
    started = F.when(changed, F.col(TICK))
    found = running_last(stepped, (SERVER,), (TICK,), F.floor(F.col(TICK) / block), started,
                         "version_tick")
    return found.select(SERVER, TICK, "version_tick")


def changed_rows(rows: DataFrame, keys: Sequence[str], null_safe: bool = False,
                 block: int = TICKS_PER_BLOCK) -> DataFrame:
    """Observations that are the first of their key or differ from the one before in ``COMPARED``."""
    rows = previous_present(rows, keys, COMPARED, block=block)
    changed = reduce(lambda a, b: a | b, [_differs(c, null_safe) for c in COMPARED])
    return rows.filter(F.col("prev").isNull() | changed).drop("prev")


def capture_changes(observed: DataFrame, refresh_on_version: bool = True,
                    null_safe: bool = False, block: int = TICKS_PER_BLOCK) -> DataFrame:
    """Change log of settings observed at every tick.

    A row is kept when the setting is new or one of ``COMPARED`` differs from the previous
    observation; with ``null_safe=False`` a change from or to NULL is not a change. A changed
    version starts every other setting anew, except the identity of the source. Settings without
    a reset value are ignored.
    """
    rows = observed.filter(F.col("reset_val").isNotNull())
    keys = list(SETTING_KEY)
    if refresh_on_version:
        rows = rows.join(version_epochs(observed, block), [SERVER, TICK], "left")
        epoch = F.when(F.col("name") != IDENTITY_NAME, F.col("version_tick"))
        rows = rows.withColumn("_epoch", F.coalesce(epoch, F.lit(-1)))
        keys.append("_epoch")
    kept = changed_rows(rows, keys, null_safe, block)
    return kept.select(*SETTING_KEY, F.col("sample_time").alias("first_seen"), *STORED)


def identity_violations(log: DataFrame) -> DataFrame:
    """Servers whose identity setting has more than one value."""
    values = log.filter(F.col("name") == IDENTITY_NAME).groupBy(SERVER)
    return (values.agg(F.min("reset_val").alias("first_identity"),
                       F.max("reset_val").alias("last_identity"))
                  .filter(F.col("first_identity") != F.col("last_identity")))


def validity(log: DataFrame) -> DataFrame:
    """Every version of a setting with the time from which the next one holds (next_seen, NULL for the newest)."""
    following = F.lead("first_seen").over(W.partitionBy(*SETTING_KEY).orderBy("first_seen"))
    return log.select(*SETTING_KEY, "first_seen", *STORED, following.alias("next_seen"))


def settings_at_samples(log: DataFrame, samples: DataFrame,
                        names: list[str] | None = None,
                        bin_seconds: int = 86_400) -> DataFrame:
    """The version of every setting in force at every sample.

    A version holds in a range of time. Ranges are cut into bins, up to the server's newest sample, and meet the samples of
    their bin; only versions that begin or end within a bin meet samples that they do not hold for.
    """
    if names:
        log = log.filter(F.col("name").isin(*names))

    def bin_of(c: str) -> str:
        return f"CAST(floor(unix_seconds({c}) / {bin_seconds}) AS INT)"

    newest = samples.groupBy(SERVER).agg(F.max("sample_time").alias("_newest"))
    ranges = validity(log).join(newest, SERVER).filter("first_seen <= _newest").selectExpr(
        "*", f"explode(sequence({bin_of('first_seen')}, {bin_of('least(coalesce(next_seen, _newest), _newest)')})) AS _bin")
    wanted = samples.selectExpr(SERVER, TICK, "sample_time", f"{bin_of('sample_time')} AS _bin")
    found = wanted.join(ranges, [SERVER, "_bin"]).filter(
        "first_seen <= sample_time AND (next_seen IS NULL OR sample_time < next_seen)")
    return found.select(SERVER, TICK, "sample_time", *SETTING_KEY[1:], "first_seen", *STORED)


def sample_bounds(samples: DataFrame, interval: Interval) -> DataFrame:
    """Per server: start and end time of the interval (one small row per server)."""
    edges = samples.filter(F.col(TICK).isin(interval.start, interval.end))
    if interval.server_ids:
        edges = edges.filter(F.col(SERVER).isin(*interval.server_ids))
    return (edges.groupBy(SERVER)
                 .agg(F.max(F.when(F.col(TICK) == interval.start, F.col("sample_time")))
                      .alias("start_time"),
                      F.max(F.when(F.col(TICK) == interval.end, F.col("sample_time")))
                      .alias("end_time"))
                 .filter("start_time IS NOT NULL AND end_time IS NOT NULL"))


def settings_and_changes(log: DataFrame, samples: DataFrame, interval: Interval) -> DataFrame:
    """Settings in force at the start of the interval, followed by its changes."""
    bounded = log.join(sample_bounds(samples, interval), SERVER)
    default = F.coalesce(F.col("boot_val") == F.col("reset_val"), F.lit(False))
    at_start = (bounded.filter("first_seen <= start_time")
                .groupBy(*SETTING_KEY)
                .agg(F.max_by(F.struct("first_seen", *STORED), "first_seen").alias("_v"))
                .select(*SETTING_KEY, "_v.*").withColumn("changed", F.lit(False)))
    changes = (bounded.filter("first_seen > start_time AND first_seen <= end_time")
               .select(*SETTING_KEY, "first_seen", *STORED).withColumn("changed", F.lit(True)))
    return at_start.unionByName(changes).withColumn("default_val", default)


def settings_notes() -> Column:
    """Where a setting came from and whether it waits for a restart."""
    place = F.concat_ws(":", "sourcefile", F.col("sourceline").cast("string"))
    return F.concat_ws(", ", F.when(F.col("sourcefile").isNotNull(), place),
                       F.when(F.col("pending_restart"), F.lit("pending restart")))


def settings_section(log: DataFrame, samples: DataFrame, interval: Interval) -> DataFrame:
    """Ordered settings listing: non-default or changed settings first."""
    rows = settings_and_changes(log, samples, interval).withColumn("notes", settings_notes())
    return rows.orderBy(SERVER, F.col("default_val") & ~F.col("changed"), "name",
                        "setting_scope", "first_seen",
                        F.col("pending_restart").asc_nulls_first())


def settings_diff(log: DataFrame, samples: DataFrame, first: Interval, second: Interval,
                  null_safe: bool = False) -> DataFrame:
    """Settings of two intervals side by side; rows equal in all compared columns are joined."""
    on = (SERVER, "first_seen", "setting_scope", "name", "setting", "reset_val",
          "pending_restart", "changed", "default_val")
    loose = ("unit", "sourcefile", "sourceline")
    parts = []
    for n, interval in ((1, first), (2, second)):
        rows = settings_and_changes(log, samples, interval)
        parts.append(rows.select(*[F.col(c).alias(f"{c}_{n}") for c in (*on, *loose)],
                                 F.lit(True).alias(f"in_{n}")))
    match = F.lit(True)
    for c in on:
        left, right = F.col(f"{c}_1"), F.col(f"{c}_2")
        match = match & (left.eqNullSafe(right) if null_safe else left == right)
    both = parts[0].join(parts[1], match, "full")
    return both.select(*[F.coalesce(f"{c}_1", f"{c}_2").alias(c) for c in (*on, *loose)],
                       F.coalesce("in_1", F.lit(False)).alias("in_first"),
                       F.coalesce("in_2", F.lit(False)).alias("in_second"))


def capacity_warnings(log: DataFrame, samples: DataFrame, totals: DataFrame,
                      interval: Interval | None = None, share: float = 0.9) -> DataFrame:
    """Samples whose number of captured statements reached ``share`` of the configured limit."""
    if interval:
        totals, samples = totals.filter(interval.contains()), samples.filter(interval.contains())
    captured = totals.groupBy(SERVER, TICK).agg(F.sum("statements").alias("stmt_cnt"))
    limits = settings_at_samples(log, samples, [CAPACITY_NAME]).select(
        SERVER, TICK, "sample_time", F.col("setting").alias("max_cnt"))
    return (captured.join(limits, [SERVER, TICK])
                    .filter(F.col("stmt_cnt") >= F.lit(share) * F.col("max_cnt").cast("int"))
                    .select(SERVER, TICK, "sample_time", "stmt_cnt", "max_cnt"))

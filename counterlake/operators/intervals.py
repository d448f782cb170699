"""Interval algebra over samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlake.model import SERVER, TICK, Interval, scan
from counterlake.operators.ticks import previous_tick


def bounds_by_time(samples: DataFrame, start: Column, end: Column) -> DataFrame:
    """Per server: the samples enclosing the time range [start, end).

    A pair of consecutive samples [t1, t2) takes part when it overlaps the range.
    """
    pairs = previous_tick(samples.select(SERVER, TICK, "sample_time"), (SERVER,),
                          ("sample_time",)).filter("prev IS NOT NULL")
    overlap = (F.col("prev.sample_time") < end) & (F.col("sample_time") > start)
    return (pairs.filter(overlap).groupBy(SERVER)
                 .agg((F.min(TICK) - 1).alias("start_id"), F.max(TICK).alias("end_id")))


def bounds_by_baseline(baselines: DataFrame, bl_samples: DataFrame, name: str) -> DataFrame:
    named = baselines.filter(F.col("bl_name") == name).select(SERVER, "bl_id")
    return (bl_samples.join(named, [SERVER, "bl_id"]).groupBy(SERVER)
                      .agg(F.min(TICK).alias("start_id"), F.max(TICK).alias("end_id")))


def sized_bounds(table_totals: DataFrame, interval: Interval) -> DataFrame:
    """Widen to the nearest samples with measured sizes at or outside the bounds."""
    sized = table_totals.filter(F.col("relsize_diff").isNotNull())
    if interval.server_ids:
        sized = sized.filter(F.col(SERVER).isin(*interval.server_ids))
    left = F.max(F.when(F.col(TICK) <= interval.start, F.col(TICK)))
    right = F.min(F.when(F.col(TICK) >= interval.end, F.col(TICK)))
    return (sized.groupBy(SERVER).agg(left.alias("left_bound"), right.alias("right_bound"))
                 .filter("left_bound IS NOT NULL AND right_bound IS NOT NULL"))


def incomplete_servers(samples: DataFrame, interval: Interval) -> DataFrame:
    """Servers that lack a sample inside the closed interval.

    Asked for are the interval's servers, also those without any sample, or else all servers that have samples.
    """
    expected = interval.end - interval.start + 1
    found = (scan(samples, [interval], closed=True).groupBy(SERVER)
             .agg(F.countDistinct(TICK).alias("n_samples")))
    if interval.server_ids:
        ids = [(s,) for s in interval.server_ids]
        asked = samples.sparkSession.createDataFrame(ids, f"{SERVER} int")
    else:
        asked = samples.select(SERVER).distinct()
    return (asked.join(found, SERVER, "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))
            .filter(F.col("n_samples") < expected)
            .withColumn("missing", F.lit(expected) - F.col("n_samples")))


def durations(samples: DataFrame, interval: Interval) -> DataFrame:
    """Per server: length of the interval in seconds."""
    def time_of(tick: int) -> Column:
        stamp = F.when(F.col(TICK) == tick, F.col("sample_time").cast("timestamp"))
        return F.unix_timestamp(F.max(stamp))

    edges = samples.filter(F.col(TICK).isin(interval.start, interval.end))
    return edges.groupBy(SERVER).agg(
        (time_of(interval.end) - time_of(interval.start)).alias("duration_sec"))


def latest_bounds(samples: DataFrame) -> DataFrame:
    """Per server: the newest sample and the one before it."""
    newest = samples.groupBy(SERVER).agg(F.max(TICK).alias("end_id"))
    return newest.select(SERVER, (F.col("end_id") - 1).alias("start_id"), "end_id")


def _reset_time(df: DataFrame, keys: tuple[str, ...], out: str) -> DataFrame:
    """Per (server, tick): newest reset time that differs from the previous tick's."""
    rows = previous_tick(df.select(TICK, *keys, "stats_reset"), keys, ("stats_reset",))
    differs = F.col("prev.stats_reset") != F.col("stats_reset")
    return (rows.groupBy(SERVER, TICK)
                .agg(F.max(F.when(differs, F.col("stats_reset"))).alias(out)))


def list_samples(samples: DataFrame, databases: DataFrame, cluster: DataFrame,
                 table_totals: DataFrame, archiver: DataFrame | None = None,
                 since: Column | None = None) -> DataFrame:
    """Samples with a flag for measured sizes and the resets they revealed."""
    if since is not None:
        samples = samples.filter(F.col("sample_time") > since)
    sizes = table_totals.groupBy(SERVER, TICK).agg(
        (F.count("relsize_diff") > 0).alias("sizes_collected"))
    on = [SERVER, TICK]
    out = (samples.select(SERVER, TICK, "sample_time").join(sizes, on)
           .join(_reset_time(databases, (SERVER, "datid"), "dbstats_reset"), on)
           .join(_reset_time(cluster, (SERVER,), "bgwrstats_reset"), on))
    if archiver is None:
        return out.withColumn("archstats_reset", F.lit(None).cast("timestamp"))
    return out.join(_reset_time(archiver, (SERVER,), "archstats_reset"), on, "left")


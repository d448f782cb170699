"""Baselines and retention. Nothing is updated in place: every operator returns the new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlake.model import SERVER, TICK, TICK_BLOCK, Interval, Repository
from counterlake.operators.dictionary import LAST, reanchor
from counterlake.operators.settings import SETTING_KEY, VERSION_NAME, VERSION_SCOPE
from counterlake.session import materialise
from counterlake.storage import Store, block_of


def create_baseline(samples: DataFrame, name: str, bl_id: int, interval: Interval,
                    now: Column | None = None, days: int | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """(baselines, bl_samples) rows for the samples start..end, both included."""
    members = samples.filter(interval.contains(closed=True)).select(
        SERVER, TICK, F.lit(bl_id).alias("bl_id"))
    return _baseline_rows(members, name, bl_id, now, days), members


def create_baseline_by_time(samples: DataFrame, name: str, bl_id: int, start: Column,
                            end: Column, now: Column | None = None, days: int | None = None
                            ) -> tuple[DataFrame, DataFrame]:
    """As ``create_baseline`` for the samples that enclose a time range, per server."""
    from counterlake.operators.intervals import bounds_by_time

    bounds = bounds_by_time(samples, start, end)
    members = (samples.join(bounds, SERVER)
               .filter(F.col(TICK).between(F.col("start_id"), F.col("end_id")))
               .select(SERVER, TICK, F.lit(bl_id).alias("bl_id")))
    return _baseline_rows(members, name, bl_id, now, days), members


def _baseline_rows(members: DataFrame, name: str, bl_id: int, now: Column | None,
                   days: int | None) -> DataFrame:
    expiry = F.lit(None).cast("timestamp")
    if days is not None:
        moment = F.current_timestamp() if now is None else now
        expiry = moment + F.make_dt_interval(days=F.lit(days))
    return (members.select(SERVER).distinct()
            .select(SERVER, F.lit(bl_id).alias("bl_id"), F.lit(name).alias("bl_name"),
                    expiry.alias("keep_until")))


def drop_baseline(baselines: DataFrame, name: str) -> DataFrame:
    return baselines.filter(F.col("bl_name") != name)


def keep_baseline(baselines: DataFrame, name: str | None, until: Column) -> DataFrame:
    """Set the expiry of one baseline, or of all when ``name`` is None."""
    hit = F.lit(True) if name is None else F.col("bl_name") == name
    return baselines.withColumn("keep_until",
                                F.when(hit, until).otherwise(F.col("keep_until")))


def show_baselines(baselines: DataFrame, bl_samples: DataFrame) -> DataFrame:
    spans = bl_samples.groupBy(SERVER, "bl_id").agg(F.min(TICK).alias("min_sample"),
                                                    F.max(TICK).alias("max_sample"))
    return (baselines.join(spans, [SERVER, "bl_id"])
            .select(SERVER, F.col("bl_name").alias("baseline"), "min_sample", "max_sample",
                    F.col("keep_until").alias("keep_until_time"))
            .orderBy(SERVER, "min_sample", "baseline"))


def expire_baselines(baselines: DataFrame, bl_samples: DataFrame, now: Column
                     ) -> tuple[DataFrame, DataFrame]:
    """Baselines past their expiry are removed together with their sample lists."""
    expired = F.coalesce(F.col("keep_until") < now, F.lit(False))
    live = baselines.filter(~expired)
    return live, bl_samples.join(live.select(SERVER, "bl_id"), [SERVER, "bl_id"], "left_semi")


def _not_baselined(samples: DataFrame, bl_samples: DataFrame) -> DataFrame:
    return samples.join(bl_samples.select(SERVER, TICK), [SERVER, TICK], "left_anti")


def retention_candidates(samples: DataFrame, servers: DataFrame, bl_samples: DataFrame,
                         now: Column, default_days: int = 7) -> DataFrame:
    """Samples older than the server's (or the default) age that no baseline protects."""
    ages = servers.select(SERVER, F.coalesce("max_sample_age", F.lit(default_days))
                          .alias("_days"))
    aged = samples.join(ages, SERVER).filter(
        F.col("sample_time") < now - F.make_dt_interval(days=F.col("_days")))
    return _not_baselined(aged, bl_samples).drop("_days")


def deletable_samples(samples: DataFrame, bl_samples: DataFrame,
                      interval: tuple[int, int] | None = None) -> DataFrame:
    """Samples in the closed range (all when None) except baselined ones and the newest."""
    newest = samples.groupBy(SERVER).agg(F.max(TICK).alias("_newest"))
    rows = samples.join(newest, SERVER).filter(F.col(TICK) != F.col("_newest")).drop("_newest")
    if interval:
        rows = rows.filter(F.col(TICK).between(*interval))
    return _not_baselined(rows, bl_samples).select(SERVER, TICK)


def survivors(facts: DataFrame, deleted: DataFrame) -> DataFrame:
    return facts.join(deleted, [SERVER, TICK], "left_anti")


def prune_settings(log: DataFrame, samples: DataFrame) -> DataFrame:
    """Drop versions no remaining sample can see: keep per setting the newest version at or
    before the oldest sample and everything later; drop what precedes the first version row."""
    oldest = samples.groupBy(SERVER).agg(F.min("sample_time").alias("_oldest"))
    floor_of = (log.join(oldest, SERVER).filter("first_seen <= _oldest")
                .groupBy(*SETTING_KEY).agg(F.max("first_seen").alias("_floor")))
    kept = log.join(floor_of, list(SETTING_KEY), "left").filter(
        "_floor IS NULL OR first_seen >= _floor").drop("_floor")
    is_version = (F.col("name") == VERSION_NAME) & (F.col("setting_scope") == VERSION_SCOPE)
    first = (kept.filter(is_version).groupBy(SERVER)
             .agg(F.min("first_seen").alias("_version_from")))
    return (kept.join(first, SERVER, "left")
                .filter("_version_from IS NULL OR first_seen >= _version_from")
                .drop("_version_from"))


# Dictionary table -> (fact table that refers to it, key columns).
DICTIONARIES: dict[str, tuple[str, Sequence[str]]] = {
    "stmt_list": ("statements", (SERVER, "queryid_md5")),
    "roles_list": ("statements", (SERVER, "userid")),
    "tablespaces_list": ("tablespaces", (SERVER, "tablespaceid")),
    "tables_list": ("tables", (SERVER, "datid", "relid")),
    "indexes_list": ("indexes", (SERVER, "datid", "indexrelid")),
    "funcs_list": ("functions", (SERVER, "datid", "funcid")),
}


def delete_samples(repo: Repository, interval: tuple[int, int] | None = None, doomed: DataFrame | None = None) -> Repository:
    """The repository without the deletable samples of the range: facts shrink, dictionaries are
    re-anchored (objects known only from deleted samples disappear), the settings log is pruned.
    """
    doomed = deletable_samples(repo.samples, repo.bl_samples, interval) if doomed is None else doomed
    kept = survivors(repo.samples, doomed)
    tables = repo.present()
    changed: dict[str, DataFrame] = {"samples": kept}
    for name in Repository.FACTS:
        if name in tables:
            changed[name] = survivors(tables[name], doomed)
    for name, (facts, keys) in DICTIONARIES.items():
        if name in tables and facts in tables:
            moved = reanchor(tables[name], tables[facts], keys, doomed, kept)
            lost = doomed.withColumnRenamed(TICK, LAST)
            changed[name] = moved.join(lost, [SERVER, LAST], "left_anti").select(*moved.columns)
    if "settings" in tables:
        changed["settings"] = prune_settings(tables["settings"], kept)
    return repo.with_tables(**changed)


def delete_stored(store: Store, interval: tuple[int, int] | None = None) -> int | None:
    """Deletes samples from a stored repository; its new version, or None if there is nothing to delete.

    Only the blocks of the deleted samples are read and written. A dictionary is written only if an object was last seen in a
    deleted sample, the settings log only if a server's oldest sample goes.
    """
    repo = store.load()
    doomed = materialise(deletable_samples(repo.samples, repo.bl_samples, interval), "doomed")
    blocks = [r[0] for r in doomed.select(block_of(TICK)).distinct().collect()]
    if not blocks:
        return None
    kept, changed = delete_samples(repo, interval, doomed).present(), {}
    for name, df in kept.items():
        if name == "settings":
            first = [t.groupBy(SERVER).agg(F.min("sample_time").alias("oldest")) for t in (repo.samples, kept["samples"])]
            touched = not first[0].exceptAll(first[1]).isEmpty()
        elif name in DICTIONARIES:
            lost = doomed.withColumnRenamed(TICK, LAST)
            touched = not getattr(repo, name).join(lost, [SERVER, LAST], "left_semi").isEmpty()
        elif name in Repository.FACTS or name == "samples":
            # of the blocks in question only
            touched, df = True, survivors(getattr(repo, name).filter(F.col(TICK_BLOCK).isin(*blocks)), doomed)
        else:
            touched = False
        if touched:
            changed[name] = df
    return store.replace(Repository(**changed), blocks)

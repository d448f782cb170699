"""Object dictionaries: the latest names of every object and the tick it was last seen at.

``last_sample_id`` is NULL while the object is alive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlake.functions.text import normalise_text, text_id
from counterlake.model import SERVER, TICK

LAST = "last_sample_id"
UNKNOWN_ROLE = "_unknown_"


def upsert(dictionary: DataFrame, current: DataFrame, keys: Sequence[str],
           attributes: Sequence[str]) -> DataFrame:
    """Merge the objects of one tick: new ones are added, known ones take the new names and
    come back to life. ``changed`` marks rows that differ from the stored dictionary."""
    old = dictionary.select(*keys, *[F.col(a).alias(f"_old_{a}") for a in attributes],
                            F.col(LAST).alias("_old_last"), F.lit(True).alias("_stored"))
    new = current.select(*keys, *attributes, F.lit(True).alias("_seen"))
    both = old.join(new, list(keys), "full")
    seen = F.col("_seen").isNotNull()
    merged = [F.when(seen, F.col(a)).otherwise(F.col(f"_old_{a}")).alias(a) for a in attributes]
    last = F.when(~seen, F.col("_old_last"))
    same = F.col("_old_last").isNull()
    for a in attributes:
        same = same & F.col(f"_old_{a}").eqNullSafe(F.col(a))
    changed = seen & (F.col("_stored").isNull() | ~same)
    return both.select(*keys, *merged, last.alias(LAST), changed.alias("changed"))


def retire(dictionary: DataFrame, current: DataFrame, keys: Sequence[str],
           ticks: DataFrame) -> DataFrame:
    """Objects alive in the dictionary but absent from the current tick were last seen one tick
    earlier. ``ticks`` holds the current (server_id, sample_id)."""
    here = current.select(*keys).distinct().withColumn("_seen", F.lit(True))
    now = ticks.select(SERVER, F.col(TICK).alias("_now"))
    joined = dictionary.join(here, list(keys), "left").join(now, SERVER, "left")
    gone = F.col(LAST).isNull() & F.col("_seen").isNull() & F.col("_now").isNotNull()
    return (joined.withColumn(LAST, F.when(gone, F.col("_now") - 1).otherwise(F.col(LAST)))
                  .drop("_seen", "_now"))


def newest_attributes(history: DataFrame, keys: Sequence[str],
                      attributes: Sequence[str]) -> DataFrame:
    """Keys, attributes of the newest row, and its tick as ``_last``.

    Rows are first reduced to versions (distinct attributes of a key), with the tick as the only
    aggregated value: a hash aggregation over the history, in which no string is a buffer. Names
    rarely change, so few versions are left to be ranked. Rows that differ at the same newest
    tick: the smallest attributes, NULL first.
    """
    versions = history.groupBy(*keys, *attributes).agg(F.max(TICK).alias("_last"))
    order = W.partitionBy(*keys).orderBy(F.desc("_last"), *attributes)
    return (versions.withColumn("_rank", F.row_number().over(order))
                    .filter(F.col("_rank") <= 1).drop("_rank"))


def from_history(history: DataFrame, keys: Sequence[str], attributes: Sequence[str],
                 samples: DataFrame) -> DataFrame:
    """The dictionary that upsert + retire at every tick would have produced, in one pass."""
    newest = samples.groupBy(SERVER).agg(F.max(TICK).alias("_newest"))
    seen = newest_attributes(history, keys, attributes)
    return (seen.join(newest, SERVER)
                .select(*keys, *attributes,
                        F.when(F.col("_last") != F.col("_newest"), F.col("_last")).alias(LAST)))


def roles_from_history(statements: DataFrame, samples: DataFrame) -> DataFrame:
    named = statements.withColumn("username", F.coalesce("username", F.lit(UNKNOWN_ROLE)))
    return from_history(named, (SERVER, "userid"), ("username",), samples)


def texts_from_history(texts: DataFrame, samples: DataFrame,
                       rename_temp: bool = False) -> DataFrame:
    """Statement texts by the md5 of their normal form; a text seen again is alive again."""
    normal = texts.withColumn("query", normalise_text(F.col("query"), rename_temp))
    normal = normal.withColumn("queryid_md5", text_id(F.col("query")))
    return from_history(normal, (SERVER, "queryid_md5"), ("query",), samples)


def propagate_names(facts: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Every row takes the newest name of its object (history follows a rename)."""
    newest = newest_attributes(facts, keys, (name,)).drop("_last")
    return facts.drop(name).join(newest, list(keys))


def reanchor(dictionary: DataFrame, facts: DataFrame, keys: Sequence[str],
             doomed: DataFrame, retained: DataFrame) -> DataFrame:
    """Before samples are deleted, move ``last_sample_id`` of objects last seen in a doomed
    sample to the newest retained sample at or before it that still refers to the object.

    ``doomed`` and ``retained`` are disjoint (server_id, sample_id) sets.
    """
    gone = doomed.select(SERVER, F.col(TICK).alias(LAST), F.lit(True).alias("_doomed"))
    stored = dictionary.join(gone, [SERVER, LAST], "left")
    anchors = (facts.select(*keys, TICK).distinct()
               .join(retained.select(SERVER, TICK), [SERVER, TICK], "left_semi")
               .join(stored.filter("_doomed").select(*keys, LAST), list(keys))
               .filter(F.col(TICK) <= F.col(LAST))
               .groupBy(*keys).agg(F.max(TICK).alias("_anchor")))
    moved = F.when(F.col("_doomed"), F.coalesce("_anchor", LAST)).otherwise(F.col(LAST))
    return (stored.join(anchors, list(keys), "left").withColumn(LAST, moved)
                  .select(*dictionary.columns))


def repair_last_seen(dictionary: DataFrame, facts: DataFrame, keys: Sequence[str],
                     samples: DataFrame) -> DataFrame:
    """After an import: objects absent from the newest sample were last seen at their newest
    fact; objects present in it keep the imported marker."""
    newest = samples.groupBy(SERVER).agg(F.max(TICK).alias("_newest"))
    seen = facts.groupBy(*keys).agg(F.max(TICK).alias("_last"))
    absent = F.col("_last").isNotNull() & (F.col("_last") < F.col("_newest"))
    return (dictionary.join(seen, list(keys), "left").join(newest, SERVER, "left")
            .withColumn(LAST, F.when(absent & F.col(LAST).isNull(), F.col("_last"))
                              .otherwise(F.col(LAST)))
            .select(*dictionary.columns))

"""Mixing sources to target weights by nested hash thresholds.

Words are summed by source and hash bucket; the bucket in which the running sum passes a source's budget is split again by
the next digits of the hash, and only rows of that bucket are read for it. A row is then taken by comparing its hash with
its source's threshold: nothing is sorted, reruns agree, and a hot source is a row per bucket and task.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows with the same id share
a hash and are taken or left together; sources without words have target 0; an empty table gives an empty table. Other
columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlake.llm.store import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Hexadecimal digits of the hash by level: 4,096 buckets, then 4,096 in the boundary bucket, and again.
LEVELS = (3, 3, 3)
#: Up to so many sources' thresholds are sent to every task; more are joined.
SENT_SOURCES = 100_000


def _hash(key: str, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """key, source, size (words of the text) and hash (hexadecimal, uniform, of the key and the seed)."""
    words = F.expr(rf"CAST(size(filter(split(coalesce(`{text}`, ''), '[ \\t-\\r]+'), w -> w != '')) AS BIGINT)")
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words.alias("size"),
                       _hash(key, seed).alias("hash"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target.

    Weights repeat over the sources in order. The budget is filled like water: a source is full when its level reaches
    cap * size / weight, so the full ones come first in that order, and the first level below the next source's bound is
    the level of the rest (levels only fall from there on, so it is the largest that fits). One row per source is windowed, not rows.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    listed = "array(" + ", ".join(map(str, weights)) + ")"
    weighed = by_source.withColumn("place", F.row_number().over(order) - 1).withColumn(
        "weight", F.expr(f"element_at({listed}, CAST(place % {len(weights)} + 1 AS INT))"))
    by_bound = W.orderBy(F.col("bound"), F.col("place"))
    whole = W.partitionBy()
    filled = (weighed.withColumn("bound", F.expr(f"CAST({cap} * source_size AS DOUBLE) / weight"))
              .withColumn("full", F.sum(F.expr(f"{cap} * source_size")).over(by_bound.rowsBetween(W.unboundedPreceding, -1)))
              .withColumn("open", F.sum("weight").over(by_bound.rowsBetween(0, W.unboundedFollowing)))
              .withColumn("budget", F.sum("source_size").over(whole) * share)
              .withColumn("level", F.expr("(budget - coalesce(full, 0)) / open"))
              .withColumn("common", F.max(F.expr("CASE WHEN level <= bound THEN level END")).over(whole)))
    return filled.select("source", "source_size", F.expr(
        f"CASE WHEN common IS NULL THEN CAST({cap} * source_size AS DOUBLE)"
        f" ELSE least(CAST({cap} * source_size AS DOUBLE), weight * common) END").alias("target"))


def thresholds(sized: DataFrame, aims: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """source, whole (copies that every row gets), below (hashes under it get one more), at the last level's fineness.

    ``below`` is a hexadecimal prefix; an empty one takes nothing. Each level keeps the last bucket border at or under what
    is left to fill; the last one takes the nearer border.
    """
    state = aims.select("source", F.expr(
        "CASE WHEN source_size = 0 THEN 0L ELSE least(2L, CAST(floor(target / source_size) AS BIGINT)) END").alias("whole"),
        F.expr("target - source_size * CASE WHEN source_size = 0 THEN 0L ELSE"
               " least(2L, CAST(floor(target / source_size) AS BIGINT)) END").alias("rest"),
        F.lit("").alias("prefix"))
    done = 0
    for n, digits in enumerate(levels):
        inside = sized.join(state, sized["source"].eqNullSafe(state["source"])).filter(
            (F.col("rest") > 0) & (F.substring("hash", 1, done) == F.col("prefix"))).select(
            sized["source"], "size", "rest", F.substring("hash", 1, done + digits).alias("bucket"))
        buckets = inside.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        running = buckets.withColumn("until", F.sum("words").over(W.partitionBy("source").orderBy("bucket")))
        last = n == len(levels) - 1
        # the boundary bucket is the first one whose running sum passes the rest
        hit = running.filter("until > rest").groupBy("source").agg(
            F.min_by(F.struct("bucket", (F.col("until") - F.col("words")).alias("before"), "until"), "bucket").alias("hit"))
        state = state.join(hit.withColumnRenamed("source", "_source"), F.col("_source").eqNullSafe(F.col("source")), "left")
        if last:
            nearer = "(hit.until - rest < rest - hit.before)"
            # g is above every hexadecimal digit: the boundary bucket is taken whole
            state = state.select("source", "whole", F.expr(
                f"CASE WHEN rest <= 0 THEN '' WHEN hit IS NULL THEN 'g' WHEN {nearer} THEN concat(hit.bucket, 'g')"
                " ELSE hit.bucket END").alias("below"))
        else:
            state = stored(state.select(
                "source", "whole", F.expr("rest - coalesce(hit.before, 0)").alias("rest"),
                F.expr("coalesce(hit.bucket, 'none')").alias("prefix")), f"mix-level-{n}")
        done += digits
    return state


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """_source, source_size, target, whole, below: a row a source. Sent to all tasks if there are few sources, so that a
    hot source's rows stay where they are."""
    aims = stored(targets(sized, weights, share), "mix-targets")
    cuts = thresholds(sized, aims).withColumnRenamed("source", "_source")
    found = stored(aims.join(cuts, F.col("_source").eqNullSafe(F.col("source"))).drop("source"), "mix-plan")
    return F.broadcast(found) if found.count() <= SENT_SOURCES else found


def taken(rows: DataFrame, found: DataFrame, source: str, hash_: str) -> DataFrame:
    """The rows with the plan's columns and copies (0 to 2), by the hash column ``hash_``."""
    return rows.join(found, F.col("_source").eqNullSafe(F.col(source))).withColumn(
        "copies", F.expr(f"whole + CASE WHEN {hash_} < below THEN 1L ELSE 0L END"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (size * copies)."""
    sized = stored(sizes(docs, key, text, source, seed), "mix-sizes")
    return taken(sized, plan(sized, weights, share), "source", "hash").selectExpr(
        "doc_id", "source", "size", "source_size", "target", "copies", "size * copies AS taken")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
             weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The rows of the mixture themselves: each as often as it is taken. Texts do not move."""
    found = plan(stored(sizes(docs, key, text, source, seed), "mix-sizes"), weights, share)
    rows = taken(docs.withColumn("_hash", _hash(key, seed)), found, source, "_hash").filter("copies > 0")
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*docs.columns)

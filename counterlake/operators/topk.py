"""Multi-metric top-k: keep an object when any of its ranks is within k.

All metrics are ranked in one pass. Each row becomes one narrow (metric, value, key) row per
metric; ranking is partitioned by (group, metric), for which Spark places a WindowGroupLimit
before the shuffle: every map task forwards at most k rows per group and metric, so a tick that
holds a third of all objects costs the same as any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Metric:
    """One ranking. ``value`` is a Spark SQL expression, larger is better, NULL ranks last.

    keep   condition an object must meet after ranking to be kept by this metric
    part   condition that limits which objects take part in the ranking
    exact  the value is an integer (ranked as bigint, not as double)
    """

    name: str
    value: str
    keep: str = "true"
    part: str = "true"
    exact: bool = True


# Spark's group limit is planned for ranks up to this bound; above it the rank is taken in
# two steps over salted groups so that a hot group is still split.
GROUP_LIMIT = 1000
SALTS = 64


def ranked(df: DataFrame, group: Sequence[str], order: str, key: Sequence[str], k: int,
           out: str = "rank") -> DataFrame:
    """The k first rows of each group with their rank; ``order`` is an SQL sort order."""
    by = ", ".join(group)
    if k > GROUP_LIMIT:
        salted = df.selectExpr("*", f"pmod(xxhash64({', '.join(key)}), {SALTS}) AS _salt")
        df = salted.selectExpr("*", f"row_number() OVER (PARTITION BY {by}, _salt "
                                    f"ORDER BY {order}) AS _pre")
        df = df.filter(f"_pre <= {k}").drop("_salt", "_pre")
    rank = f"row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS {out}"
    return df.selectExpr("*", rank).filter(f"{out} <= {k}")


def _rank_variants(df: DataFrame, group: Sequence[str], key: Sequence[str],
                   metrics: Sequence[Metric], k: int, carried: Sequence[str]) -> DataFrame:
    def variant(m: Metric) -> str:
        whole = f"CAST({m.value} AS BIGINT)" if m.exact else "CAST(NULL AS BIGINT)"
        real = "CAST(NULL AS DOUBLE)" if m.exact else f"CAST({m.value} AS DOUBLE)"
        row = (f"named_struct('metric', '{m.name}', '_whole', {whole}, '_real', {real},"
               f" '_keep', ({m.keep}))")
        return row if m.part == "true" else f"CASE WHEN {m.part} THEN {row} END"

    variants = ", ".join(variant(m) for m in metrics)
    long = df.selectExpr(*carried, f"inline(array_compact(array({variants})))")
    order = ", ".join(["_whole DESC NULLS LAST", "_real DESC NULLS LAST", *key])
    return (ranked(long, [*group, "metric"], order, key, k)
            .filter("_keep").drop("_whole", "_real", "_keep"))


def rank_long(df: DataFrame, group: Sequence[str], key: Sequence[str],
              metrics: Sequence[Metric], k: int) -> DataFrame:
    """(group, key, metric, rank) of every object within k of any metric."""
    return _rank_variants(df, group, key, metrics, k, [*group, *key])


def top_keys(df: DataFrame, group: Sequence[str], key: Sequence[str],
             metrics: Sequence[Metric], k: int) -> DataFrame:
    """Distinct keys of the objects that any metric keeps."""
    return rank_long(df, group, key, metrics, k).select(*group, *key).distinct()


def top_rows(df: DataFrame, group: Sequence[str], key: Sequence[str],
             metrics: Sequence[Metric], k: int, order: str) -> DataFrame:
    """Whole rows of the objects that any metric keeps, numbered by ``order`` as ``ord``.

    One pass and no join. An object kept by several metrics is reduced to one row in the same
    exchange that numbers the few kept rows.
    """
    rows = _rank_variants(df, group, key, metrics, k, df.columns)
    by = ", ".join(group)
    once = rows.selectExpr(
        "*", f"dense_rank() OVER (PARTITION BY {by} ORDER BY {order}) AS ord",
        f"row_number() OVER (PARTITION BY {by}, {', '.join(key)} ORDER BY metric) AS _copy")
    return once.filter("_copy = 1").drop("metric", "rank", "_copy")

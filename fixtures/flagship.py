"""The flagship query: the whole path from cumulative counters to a ranked report section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from counterlake import model as M
from counterlake.model import grouped, pct, sums, tag_intervals
from counterlake.operators import delta, totals
from counterlake.operators.topk import ranked
from fixtures.projection import TICKS, relation


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions by time over the whole history, per server, with shares of the exact totals."""
    increments = delta.counter_delta(relation(spark, sf_dir, "functions_snap"), M.FUNCTIONS,
                                     relation(spark, sf_dir, "databases_snap"))
    span = [M.Interval(0, TICKS)]
    whole = grouped(tag_intervals(totals.function_totals(increments), span), ["server_id"],
                    ["sum(calls) AS all_calls", "sum(total_time) AS all_time"])
    used = grouped(tag_intervals(increments, span), ["server_id", "datid", "funcid"],
                   sums(("calls", "total_time", "self_time")))
    shares = used.join(whole, "server_id").selectExpr(
        *used.columns, f"{pct('calls', 'all_calls')} AS calls_pct",
        f"{pct('total_time', 'all_time')} AS total_time_pct")
    return ranked(shares.filter("calls > 0"), ["server_id"],
                  "total_time DESC NULLS LAST, datid, funcid", ["datid", "funcid"], 20, "ord")

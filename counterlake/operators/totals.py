"""Exact totals over all objects, marked or not, and the facts that are kept beside them.

Plain grouped sums: partial aggregation runs before the shuffle, so a hot group costs one row
per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlake.functions.text import normalise_text, text_id
from counterlake.model import (FUNCTION_COUNTERS, INDEX_COUNTERS, SERVER, STATEMENT_KEY,
                               STATEMENT_SUMS, TABLE_COUNTERS, TICK, USAGE_SUMS, grouped, sums)
from counterlake.operators.marking import in_known_databases, select_marked


def _sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *more: str) -> DataFrame:
    present = set(df.columns)
    return grouped(df, (SERVER, TICK, *keys), [*sums([c for c in columns if c in present]), *more])


def table_totals(deltas: DataFrame) -> DataFrame:
    """Per database, tablespace and kind. Growth is NULL when no size was measured."""
    return _sums(deltas, ("datid", "tablespaceid", "relkind"), (*TABLE_COUNTERS, "relsize_diff"))


def index_totals(deltas: DataFrame) -> DataFrame:
    return _sums(deltas, ("datid", "tablespaceid"), (*INDEX_COUNTERS, "relsize_diff"))


def function_totals(deltas: DataFrame) -> DataFrame:
    return _sums(deltas, ("datid", "trg_fn"), [c for c in FUNCTION_COUNTERS if c != "self_time"])


def statement_totals(statements: DataFrame, databases: DataFrame) -> DataFrame:
    """Per database, with the number of captured statements; vanished databases are left out."""
    known = in_known_databases(statements, databases)
    return _sums(known, ("datid",), STATEMENT_SUMS, "count(*) AS statements")


def usage_totals(usage: DataFrame, databases: DataFrame) -> DataFrame:
    """Per database, over top-level statements only."""
    known = in_known_databases(usage, databases).filter("toplevel")
    return _sums(known, ("datid",), USAGE_SUMS, "count(*) AS statements")


def attach_text_ids(statements: DataFrame, texts: DataFrame, rename_temp: bool = False
                    ) -> DataFrame:
    """Statements joined with the id of their normalised text (rows without a text are lost)."""
    key = [c for c in (SERVER, TICK, *STATEMENT_KEY) if c in texts.columns]
    ids = texts.select(*key, text_id(normalise_text(F.col("query"), rename_temp))
                       .alias("queryid_md5"))
    return statements.drop("queryid_md5").join(ids, key)


def save_statements(statements: DataFrame, usage: DataFrame, marked: DataFrame,
                    texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of the marked statements with text ids, and usage facts of the same statements."""
    kept = attach_text_ids(select_marked(statements, marked), texts)
    key = [SERVER, TICK, *STATEMENT_KEY]
    used = usage.join(kept.select(*key, "queryid_md5"), key)
    return kept, used

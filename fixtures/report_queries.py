"""Registered queries for interval relations and report sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from counterlake.model import Interval, Repository
from counterlake.operators import stats
from counterlake.plans import sections as S
from fixtures import oracles as O
from fixtures.projection import TICKS, repository

ONE = [Interval(0, TICKS)]
TWO = [Interval(0, 15), Interval(15, TICKS)]
DROP = ("checksum_last_failure",)

# relations each plan reads, so that a query projects nothing it does not need
NEEDS = {
    "databases": ("databases",), "cluster": ("cluster", "archiver"), "wal": ("wal", "samples"),
    "tablespaces": ("tablespaces", "tablespaces_list"), "waits": ("waits",),
    "tables": ("tables", "databases", "tables_list", "tablespaces_list"),
    "indexes": ("indexes", "tables", "databases", "indexes_list", "tables_list",
                "tablespaces_list"),
    "functions": ("functions", "databases", "funcs_list"),
    "statements": ("statements", "usage", "databases", "cluster", "roles_list",
                   "statement_totals"),
    "usage": ("usage", "databases", "roles_list", "usage_totals"),
    "statements_db": ("statement_totals", "function_totals", "databases"),
}
NEEDS.update(io_tables=(*NEEDS["tables"], "table_totals"),
             io_indexes=(*NEEDS["indexes"], "table_totals"),
             trigger_functions=NEEDS["functions"], tables_at_end=NEEDS["tables"],
             statements_by_text=NEEDS["statements"], usage_by_text=NEEDS["usage"])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, needs: tuple[str, ...], plan: Callable[[Repository], DataFrame],
         sql: str) -> None:
    QUERIES[name] = lambda spark, sf: plan(repository(spark, sf, needs)).drop(*DROP)
    ORACLES[name] = sql


_X = (
    ("x1_dbstats", "databases", stats.dbstats, "x_db"),
    ("x2_dbstats_sessions", "databases", stats.dbstats_sessions, "x_sessions"),
    ("x3_cluster_stats", "cluster", stats.cluster_stats, "x_cluster"),
    ("x4_wal_stats", "wal", stats.wal_stats, "x_wal"),
    ("x5_tablespace_stats", "tablespaces", stats.tablespace_stats, "x_spaces"),
    ("x6_wait_stats", "waits", stats.wait_stats, "x_waits"),
    ("x7_x9_top_tables", "tables", stats.top_tables, "x_tables"),
    ("x8_x9_top_indexes", "indexes", stats.top_indexes, "x_indexes"),
    ("x10_top_io_tables", "io_tables", stats.top_io_tables, "x_io_tables"),
    ("x11_top_io_indexes", "io_indexes", stats.top_io_indexes, "x_io_indexes"),
    ("x12_top_functions", "functions", stats.top_functions, "x_functions"),
    ("x12_top_trigger_functions", "functions", S.RELATIONS["trigger_functions"],
     "x_trigger_functions"),
    ("x13_x18_top_statements", "statements", stats.top_statements, "x_statements"),
    ("x14_top_statements_by_text", "statements", S.RELATIONS["statements_by_text"],
     "x_statements_by_text"),
    ("x15_top_usage", "usage", stats.top_usage, "x_usage"),
    ("x16_top_usage_by_text", "usage", S.RELATIONS["usage_by_text"], "x_usage_by_text"),
    ("x17_statements_dbstats", "statements_db", stats.statements_dbstats, "x_stmt_db"),
)
for _name, _needs, _plan, _x in _X:
    _add(_name, NEEDS[_needs], lambda repo, p=_plan: p(repo, ONE), O.x_sql(f"SELECT * FROM {_x}"))

_PLAIN = (
    ("q1_databases", "databases", S.database_section, O.database_sql),
    ("q2_sessions", "databases", S.session_section, O.session_sql),
    ("q3_statements_by_db", "statements_db", S.statement_db_section, O.statement_db_sql),
    ("q4_jit_by_db", "statements_db", S.jit_db_section, O.jit_db_sql),
    ("q5_cluster", "cluster", S.cluster_section, O.cluster_sql),
    ("q6_wal", "wal", S.wal_section, O.wal_sql),
    ("q7_tablespaces", "tablespaces", S.tablespace_section, O.tablespace_sql),
    ("q8_wait_types", "waits", S.wait_type_section, O.wait_type_sql),
)
for _name, _needs, _plan, _sql in _PLAIN:
    _add(_name, NEEDS[_needs], lambda repo, p=_plan: p(repo, ONE), _sql(False))
    _add(f"{_name}_diff", NEEDS[_needs], lambda repo, p=_plan: p(repo, TWO), _sql(True))

for _s in S.SECTIONS:
    _add(_s.id, NEEDS[_s.relation], lambda repo, i=_s.id: S.section(repo, i, ONE),
         O.single_sql(_s, S.TOPN))
    if _s.diff:
        _add(f"{_s.id}_diff", NEEDS[_s.relation], lambda repo, i=_s.id: S.section(repo, i, TWO),
             O.diff_sql(_s, S.TOPN))

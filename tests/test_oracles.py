"""Registered queries against their oracle SQL on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
# one per operator family; bench and the driver run the rest
CHOSEN = ("c6_c7_tables", "c8_indexes", "c10_carried_sizes", "m2_mark_indexes", "m4_mark_tables",
          "t1_t2_table_totals", "d2_upsert_tables", "d7_reanchor", "g1_g2_settings_log",
          "g8_settings_diff", "i6_list_samples", "r3_surviving_facts", "r3_stored_retention", "s12_roundtrip", "i4_incomplete_of_asked_servers", "a10_usage",
          "e2_e4_cluster_resets", "e6_capacity_warnings", "q1_databases_diff", "q12_diff",
          "q21_diff", "q24_statement_texts", "q40", "s12_import", "z1_stream_database_deltas",
          "z3_stream_setting_changes")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_oracle(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_every_query_has_an_oracle():
    own = {n for n in entry.queries() if n != "pipeline" and not n.startswith("op")}
    assert not own - set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

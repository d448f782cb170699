"""Plans over a stored repository: every fact scan reads its tick blocks only, and facts are aggregated by hashing."""

import os
import re

import pytest

from counterlake.model import Interval, Repository
from counterlake.operators import resets, stats
from counterlake.plans import sections
from fixtures.projection import repository

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
SPAN = [Interval(8, 20)]
RELATIONS = {
    "x3": stats.cluster_stats, "x7": stats.top_tables, "x8": stats.top_indexes, "x10": stats.top_io_tables,
    "x11": stats.top_io_indexes, "x12": stats.top_functions, "x13": stats.top_statements,
    "x14": lambda r, i: stats.top_statements(r, i, by_text=True), "x15": stats.top_usage,
    "x16": lambda r, i: stats.top_usage(r, i, by_text=True), "q24": sections.statement_texts,
    "q41": sections.tables_at_end, "e1": lambda r, i: resets.database_resets(r.databases, i),
}


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path, before = str(tmp_path_factory.mktemp("repository")), Repository.TICKS_PER_PARTITION
    Repository.TICKS_PER_PARTITION = 4  # the fixture's thirty ticks make eight blocks
    try:
        repository(spark, SF).save(path)
        yield Repository.load(spark, path)
    finally:
        Repository.TICKS_PER_PARTITION = before


@pytest.mark.parametrize("name", RELATIONS)
def test_fact_scans_are_pruned_and_hashed(saved, name):
    df = RELATIONS[name](saved, SPAN)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[(.*?)\].*?PartitionFilters: \[(.*?)\], PushedFilters", plan)
    facts = [(columns, filters) for columns, filters in scans if re.search(r"\bsample_id#", columns)]
    assert facts, plan[:2000]
    assert all("tick_block" in filters for _, filters in facts), facts
    if name not in ("q24", "q41", "e1"):
        assert "SortAggregate" not in plan
    assert df.count() >= 0

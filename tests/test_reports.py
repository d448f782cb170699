"""Whole reports: the tree's order and gates, typed values, servers without bounds."""

import decimal
import os

import pytest
from pyspark.sql import functions as F

from counterlake.model import Interval
from counterlake.plans import report, tree
from fixtures.model_queries import _log
from fixtures.projection import repository

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def repo(spark):
    names = ("samples", "databases", "statements", "stmt_list", "cluster", "roles_list", "statement_totals", "function_totals",
             "functions", "funcs_list")
    return repository(spark, SF, names).with_tables(settings=_log(spark, SF))


def _sections(frame):
    return {(r.server_id, r.sect_id) for r in frame.select("server_id", "sect_id").distinct().collect()}


@needs_tables
def test_gates_are_inherited_server_by_server(repo):
    """Server 1 has no planning times; server 2 lacks the totals of one sample, so that all of its statement branch is closed."""
    totals = repo.statement_totals.withColumn(
        "total_plan_time", F.when(F.col("server_id") != 1, F.col("total_plan_time"))).filter("server_id <> 2 OR sample_id <> 9")
    frame = report.interval_report(repo.with_tables(statement_totals=totals), Interval(1, 30)).persist()
    found = _sections(frame)
    assert {"q10", "q11"} & {s for n, s in found if n == 1} == set()
    assert {"q12", "q13", "q15", "texts", "q3", "q35", "settings"} <= {s for n, s in found if n == 1}
    closed = {"q3", "texts", *(f"q{n}" for n in range(10, 24))}
    assert closed & {s for n, s in found if n == 2} == set()
    assert {"q1", "q35", "settings"} <= {s for n, s in found if n == 2}
    places = {r.sect_id: r.sect_ord for r in frame.select("sect_id", "sect_ord").distinct().collect()}
    order = [s for s in ("capacity_1", "q1", "q3", "q12", "q15", "texts", "q35", "settings", "capacity_all") if s in places]
    assert [places[s] for s in order] == sorted(places[s] for s in order)


@needs_tables
def test_texts_are_those_of_listed_statements(repo):
    frame = report.interval_report(repo, Interval(1, 30), topn=2).persist()
    listed = {(r.server_id, r.key.split("|")[0]) for r in frame.filter("sect_id RLIKE '^q1[0-9]$|^q2[0-3]$'").collect()}
    shown = {(r.server_id, r.key.split("|")[0]) for r in frame.filter("sect_id = 'texts' AND metric = 'query'").collect()}
    assert shown and shown == listed
    frame.unpersist()


@needs_tables
@pytest.mark.parametrize("spans", [(Interval(1, 30),), (Interval(1, 15), Interval(15, 30))], ids=["single", "diff"])
def test_sections_rank_what_they_can_list(repo, monkeypatch, spans):
    name, make = ("single_section", report.interval_report) if len(spans) == 1 else ("diff_section", report.diff_report)
    ranked, sizes = getattr(report.S, name), {}
    monkeypatch.setattr(report.S, name, lambda rows, spec, topn: sizes.setdefault(spec.id, rows.count()) and ranked(rows, spec, topn))
    make(repo, *spans, topn=2)
    assert 0 < sizes["q12"] < report.S.RELATIONS["statements"](repo, list(spans)).count() / 5


@needs_tables
def test_a_server_without_measured_sizes_is_an_error(spark):
    repo = repository(spark, SF, ("samples", "table_totals", "databases"))
    bare = repo.with_tables(table_totals=repo.table_totals.filter("server_id <> 2"))
    with pytest.raises(ValueError, match="without measured sizes.*2"):
        report.interval_report(bare, Interval(8, 20), with_growth=True)


def test_values_keep_their_kind(spark):
    rows = spark.sql("SELECT 7 AS server_id, 'a' AS k, 9007199254740993L AS bytes, CAST('99999999999999999999999999' AS "
                     "DECIMAL(38, 0)) AS product, 0.5D AS share, TIMESTAMP '2024-01-02 03:04:05' AS seen, true AS flag, "
                     "CAST(NULL AS BIGINT) AS none")
    got = {r.metric: (r.value, r.exact, r.text) for r in report._long(report._timed(rows), "x", ("k",)).collect()}
    assert got == {
        "bytes": (None, decimal.Decimal(9007199254740993), None), "share": (0.5, None, None), "flag": (None, None, "true"),
        "product": (None, decimal.Decimal("99999999999999999999999999"), None), "seen": (None, None, "2024-01-02 03:04:05")}


def test_every_section_is_in_the_tree(spark):
    from counterlake.plans import sections

    for n in (1, 2):
        walked = {r.sect_id: r.gates for r in tree.walked(spark, n).collect()}
        assert set(walked) == tree.sections_of(n)
        wanted = {s.id for s in sections.SECTIONS if n == 1 or s.diff} | {name for name, *_ in report.PLAIN}
        assert wanted <= set(walked)
        assert walked["q11"] == ["statements", "planning_times"] and walked["q23"] == ["statements", "usage_exec"]

"""The relations as Spark builds them: the rows of the plain SQL, with narrow shuffles and tasks of bounded size."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from counterlake.model import Interval
from counterlake.operators import marking, stats
from counterlake.operators.ticks import previous_tick
from counterlake.plans import sections
from counterlake.session import materialise, partitions
from fixtures import projection as P
from fixtures.report_queries import NEEDS

CHANGED = [n for n in P.REL if P.SPARK_REL[n] != P.REL[n]]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Rows with gaps, nulls in every column, names that share their first letter, and repeated rows."""
    rng, rows, events = random.Random(3), [], []
    for _ in range(1500):
        day = datetime.datetime(1995, 1, 1) + datetime.timedelta(days=rng.randrange(2500))
        row = [rng.randrange(40), rng.randrange(9), rng.randrange(5), rng.randrange(1, 8), float(rng.randrange(50)),
               float(rng.randrange(9999)), rng.randrange(11) / 100, rng.randrange(9) / 100, rng.choice(["R", "Rx", "A", "e"]),
               rng.choice(["O", "F", "Fx"]), day]
        row = [None if rng.random() < 0.03 else v for v in row]
        rows += [tuple(row)] * rng.choice([1, 1, 1, 2])
        events.append((rng.randrange(99), day, rng.randrange(9), rng.choice(["error", "R", "Rx", None]), rng.random(),
                       f'{{"k": {rng.randrange(100)}}}'))
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                          "l_linestatus string, l_shipdate timestamp").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, "
                          "props string").write.parquet(f"{at}/events.parquet")
    return at


@pytest.mark.parametrize("name", CHANGED)
def test_rows_are_those_of_the_plain_sql(spark, odd, name, monkeypatch):
    got = P.derive(spark, odd, name)
    monkeypatch.setattr(P, "SPARK_REL", P.REL)
    want = P.derive(spark, odd, name)
    assert sorted(got.dtypes) == sorted(want.dtypes)
    got = got.select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 0


@pytest.mark.parametrize("name,exchanges", [("statements", 1), ("usage", 1), ("tables_snap", 1), ("indexes_snap", 1)])
def test_rows_move_once(spark, odd, name, exchanges):
    plan = plan_of(P.derive(spark, odd, name))
    assert plan.count("Exchange ") == exchanges, plan


def test_readers_take_their_columns(spark, odd):
    repo = P.repository(spark, odd, ("statements", "databases"))
    plan = plan_of(repo.statements.groupBy("server_id", "sample_id", "datid", "userid", "queryid", "toplevel").agg(F.max("calls")))
    assert "l_tax" not in plan and "SortAggregate" not in plan


def test_parts_grow_with_the_input(spark, odd):
    few = partitions(spark, f"{odd}/lineitem.parquet", 1 << 40)
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions(spark, [f"{odd}/lineitem.parquet"] * 3, 1000) > 2 * partitions(spark, f"{odd}/lineitem.parquet", 1000) > few


def test_a_block_is_sorted_once_in_tasks_of_bounded_size(spark, monkeypatch):
    rows = materialise(spark.range(4000).selectExpr("CAST(1 AS INT) AS server_id", "id % 400 AS obj", "CAST(id DIV 400 AS INT) AS sample_id",
                                                    "id AS v", "IF(id % 3 = 0, id, NULL) AS size"), "ticks")
    monkeypatch.setattr("counterlake.operators.ticks.TASK_BYTES", 500)
    df = previous_tick(rows, ("server_id", "obj"), ("v", "size"), carry=("size",))
    wide = [line for line in plan_of(df).splitlines() if re.search(r"\bSort \[", line) and "sample_id" in line]
    assert len(wide) == 1, wide
    assert int(re.search(r"hashpartitioning\(server_id#\w+, obj#\w+, _blk#\w+, (\d+)\), REPARTITION_BY_NUM", plan_of(df))[1]) > 8


def test_tables_without_side_table_spread(spark):
    rows = spark.createDataFrame([(1, 1, 5, n, "r", None, n) for n in range(1000)] + [(1, 1, 5, 2000, "r", 2001, 7), (1, 1, 5, 2001, "t", None, 9)],
                                 "server_id int, sample_id int, datid long, relid long, relkind string, reltoastrelid long, relsize long")
    joined = marking.with_side_table(rows.hint("merge"), ("relsize",))
    assert {(r.relid, r.side.relsize) for r in joined.filter("side IS NOT NULL").collect()} == {(2000, 9)}
    assert joined.count() == 1001
    assert "coalesce(reltoastrelid" in plan_of(joined)


def test_comparison_reads_labels_of_shown_rows_only(spark, odd):
    repo = P.repository(spark, odd, ("statements", "usage", "databases", "cluster", "roles_list", "statement_totals"))
    plan = plan_of(sections.section(repo, "q11", [Interval(0, 15), Interval(15, 30)]))
    assert re.search(r"Join \[[^]]*coalesce\(queryid#.*_of_queryid#", plan), plan


def test_sums_of_objects_move_once(spark, odd):
    """Facts and usage are dealt by statement text, one exchange each: joins with usage and totals move nothing more."""
    repo = P.repository(spark, odd, ("statements", "usage", "databases", "cluster", "roles_list", "statement_totals"))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(stats.top_statements(repo, [Interval(0, 30)], by_text=True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\), ENSURE", plan)
    assert len([keys for keys in moved if "toplevel" in keys]) == 2, moved
    assert not any(re.fullmatch(r"server_id#\w+, \d+", keys) for keys in moved), moved


@pytest.mark.parametrize("name", ["statements", "tables", "waits"])
@pytest.mark.parametrize("spans", [[Interval(0, 30)], [Interval(0, 15), Interval(15, 30)]], ids=["single", "diff"])
def test_listable_rows_give_the_same_sections(spark, odd, name, spans):
    """Nulls, ties and repeated rows included; a server without any value keeps all of its rows."""
    found = sections.RELATIONS[name](P.repository(spark, odd, NEEDS[name]), spans)
    if name == "statements":
        found = found.withColumn("total_plan_time", F.expr("CASE WHEN server_id = 1 THEN total_plan_time END"))
    relation = materialise(found.unionByName(found.limit(9)), name)
    diff = len(spans) == 2
    specs = [s for s in sections.SECTIONS if s.relation == name and (s.diff or not diff)]
    if diff:
        few = sections.with_keys(relation, sections.listable_keys(relation, specs, 2))
    else:
        few = sections.listable(relation, specs, 2)
    few, rank = materialise(few, name), sections.diff_section if diff else sections.single_section
    assert few.filter("server_id = 1").count() <= relation.filter("server_id = 1").count() / (2 if name == "statements" else 1)
    for spec in specs:
        got, want = rank(few, spec, 2).collect(), rank(relation, spec, 2).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)), spec.id

"""Baselines, retention, transfer and storage on small hand-written tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from counterlake.model import Interval, Repository, duplicate_keys, tag_intervals
from counterlake.operators import lifecycle
from counterlake.sources import transfer

NOW = datetime(2024, 1, 10)


def repo(spark):
    ages = [timedelta(days=4), timedelta(days=3), timedelta(days=2), timedelta(days=1),
            timedelta(hours=23), timedelta(0)]
    samples = spark.createDataFrame([(1, i + 1, NOW - a) for i, a in enumerate(ages)],
                                    "server_id int, sample_id int, sample_time timestamp")
    facts = spark.createDataFrame(
        [(1, t, 5, o, t * 10 + o, t * 1, False) for t in range(1, 7) for o in (1, 2) if o == 1 or t < 3],
        "server_id int, sample_id int, datid long, funcid long, calls long, total_time long, trg_fn boolean")
    names = spark.createDataFrame([(1, 5, 1, "f1", None), (1, 5, 2, "f2", 2)],
                                  "server_id int, datid long, funcid long, funcname string, "
                                  "last_sample_id int")
    empty = spark.createDataFrame([], "server_id int, sample_id int, bl_id int")
    bases = spark.createDataFrame([], "server_id int, bl_id int, bl_name string, "
                                      "keep_until timestamp")
    return Repository(samples=samples, functions=facts, funcs_list=names, bl_samples=empty,
                      baselines=bases)


def ids(df):
    return sorted(r.sample_id for r in df.collect())


def test_delete_all_spares_the_newest(spark):
    assert ids(lifecycle.delete_samples(repo(spark)).samples) == [6]


def test_delete_range_spares_baselined_samples(spark):
    r = repo(spark)
    _, members = lifecycle.create_baseline(r.samples, "testline1", 1, Interval(2, 4))
    kept = lifecycle.delete_samples(r.with_tables(bl_samples=members), (1, 5))
    assert ids(kept.samples) == [2, 3, 4, 6]
    assert {r.sample_id for r in kept.functions.collect()} == {2, 3, 4, 6}


def test_reanchor_and_cascade(spark):
    r = repo(spark)
    kept = lifecycle.delete_samples(r, (2, 3))  # f2 was last seen in 2, still present in 1
    assert {x.funcid: x.last_sample_id for x in kept.funcs_list.collect()} == {1: None, 2: 1}
    gone = lifecycle.delete_samples(r, (1, 3))  # nothing refers to f2 any more
    assert {x.funcid for x in gone.funcs_list.collect()} == {1}


def test_retention_and_expiry(spark):
    r = repo(spark)
    servers = spark.createDataFrame([(1, None)], "server_id int, max_sample_age int")
    old = lifecycle.retention_candidates(r.samples, servers, r.bl_samples, F.lit(NOW), 2)
    assert ids(old) == [1, 2]
    bases, members = lifecycle.create_baseline(r.samples, "testline2", 2, Interval(1, 2),
                                               F.lit(NOW), -1)
    live, left = lifecycle.expire_baselines(bases, members, F.lit(NOW))
    assert live.count() == 0 and left.count() == 0


def test_import_of_export_restores_everything(spark):
    r = repo(spark)
    rows = transfer.export_rows(r)
    empty = r.with_tables(**{n: df.limit(0) for n, df in r.present().items()})
    same = spark.createDataFrame([(1, 9)], "imported_id int, local_id int")
    loaded, counts = transfer.import_rows(rows, empty, same)
    back = loaded.functions.withColumn("server_id", F.lit(1)).select(r.functions.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, r.functions.collect()))
    assert {c.table_name: c.n_rows for c in counts.collect()}["functions"] == r.functions.count()
    assert {x.server_id for x in loaded.samples.collect()} == {9}
    again, more = transfer.import_rows(rows, loaded, same)
    assert sum(c.n_rows for c in more.collect()) == 0


def test_save_and_load_prunes_ticks(spark, tmp_path):
    r = repo(spark)
    r.with_tables(bl_samples=None, baselines=None).save(str(tmp_path))
    back = Repository.load(spark, str(tmp_path), ["samples", "functions"])
    assert "tick_block" in back.functions.columns
    kept = tag_intervals(back.functions, [Interval(1, 3)])
    assert "PartitionFilters: [isnotnull(tick_block" in kept._jdf.queryExecution().toString()
    assert kept.count() == 3  # f1 at 2 and 3, f2 at 2


def test_saving_again_deletes(spark, tmp_path):
    r = repo(spark).with_tables(bl_samples=None, baselines=None)
    r.save(str(tmp_path))
    old = Repository.load(spark, str(tmp_path))
    old.with_tables(samples=old.samples.filter("sample_id < 3").drop("tick_block")).save(str(tmp_path))
    assert {x.sample_id for x in Repository.load(spark, str(tmp_path), ["samples"]).samples.collect()} <= {0, 1, 2}
    Repository.vacuum(spark, str(tmp_path))
    assert Repository.load(spark, str(tmp_path)).functions.count() == r.functions.count()


def test_import_fails_loudly(spark):
    r = repo(spark)
    rows = transfer.export_rows(r)
    same = spark.createDataFrame([(1, 9, "a", "new")], "imported_id int, local_id int, server_name string, verdict string")
    broken = rows.unionByName(spark.createDataFrame([(transfer.SECTION_ID["samples"], "{not json")], rows.schema))
    with pytest.raises(ValueError, match="fit no table"):
        transfer.import_rows(broken, r, same)
    with pytest.raises(ValueError, match="prefix"):
        transfer.import_rows(rows, r, same.withColumn("verdict", F.lit("conflict")))


def test_export_keeps_microseconds(spark):
    at = datetime(2024, 1, 1, 0, 0, 0, 123456)
    r = Repository(samples=spark.createDataFrame([(1, 1, at)], "server_id int, sample_id int, sample_time timestamp"))
    back = transfer.section_rows(transfer.export_rows(r), "samples", r.samples)
    assert back.collect() == r.samples.collect()


def test_overlapping_intervals_count_rows_twice(spark):
    r = repo(spark)
    tagged = tag_intervals(r.samples, [Interval(0, 4), Interval(2, 6)])
    assert tagged.count() == 8


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "a int, b int")
    assert duplicate_keys(df, ("a", "b")).count() == 1


def test_server_matching_conflict(spark):
    servers = spark.createDataFrame([(1, "a", NOW), (2, "b", NOW)],
                                    "server_id int, server_name string, server_created timestamp")
    ident = spark.createDataFrame([(1, "system_identifier", "x"), (2, "system_identifier", "y")],
                                  "server_id int, name string, reset_val string")
    local = spark.createDataFrame([(7, "b", NOW), (8, "z", NOW)],
                                  "server_id int, server_name string, server_created timestamp")
    mine = spark.createDataFrame([(7, "system_identifier", "other"), (8, "system_identifier", "x")],
                                 "server_id int, name string, reset_val string")
    got = {r.imported_id: (r.verdict, r.local_id)
           for r in transfer.match_servers(servers, ident, local, mine).collect()}
    assert got == {1: ("match", 8), 2: ("conflict", None)}

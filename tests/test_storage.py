"""Stored repositories: which files a change writes, earlier versions, and new columns."""

import os

import pytest
from pyspark.sql import functions as F

from counterlake.model import Repository
from counterlake.operators import lifecycle
from counterlake.storage import Store
from tests.test_lifecycle import ids, repo


@pytest.fixture
def store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Repository, "TICKS_PER_PARTITION", 2)  # samples 1 to 6: blocks 0 to 3
    made = Store(spark, str(tmp_path / "repository"))
    made.save(repo(spark))
    return made


def _files(store):
    return {os.path.relpath(os.path.join(d, f), store.path) for d, _, names in os.walk(store.path) for f in names
            if f.startswith("part-")}


def test_deleting_a_sample_writes_its_block_only(store):
    before, first = _files(store), store.versions()[-1]
    version = lifecycle.delete_stored(store, (3, 3))
    new = _files(store) - before
    tables = {f for f in new if not f.startswith("_manifest")}
    assert tables and all(f.startswith(("functions/tick_block=1/", "samples/tick_block=1/")) for f in tables), tables
    assert ids(store.load().samples) == [1, 2, 4, 5, 6] and {r.sample_id for r in store.load().functions.collect()} == {1, 2, 4, 5, 6}
    assert ids(store.load(version=first).samples) == [1, 2, 3, 4, 5, 6] and store.versions() == [first, version]
    store.vacuum()
    assert store.versions() == [version] and ids(store.load().samples) == [1, 2, 4, 5, 6]
    assert len([f for f in _files(store) if f.startswith("samples/tick_block=1/")]) == 1


def test_a_delete_moves_the_dictionary_when_it_must(store):
    before = _files(store)
    lifecycle.delete_stored(store, (2, 2))  # an object was last seen there
    assert any(f.startswith("funcs_list/") for f in _files(store) - before)
    assert {r.funcid: r.last_sample_id for r in store.load().funcs_list.collect()} == {1: None, 2: 1}
    assert lifecycle.delete_stored(store, (2, 2)) is None


def test_a_block_without_rows_goes(store):
    lifecycle.delete_stored(store, (4, 5))
    lifecycle.delete_stored(store, (1, 3))
    assert ids(store.load().samples) == [6] and {e[1] for e in store.entries() if e[0] == "samples"} == {3}


def test_new_ticks_add_files(spark, store):
    before = _files(store)
    tick = spark.sql("SELECT 1 AS server_id, 7 AS sample_id, 5L AS datid, 1L AS funcid, 70L AS calls, 7L AS total_time, "
                     "false AS trg_fn, 'x' AS later")
    store.append(Repository(functions=tick))
    new = [f for f in _files(store) - before if not f.startswith("_manifest")]
    assert len(new) == 1 and new[0].startswith("functions/tick_block=3/")
    rows = store.load().functions.filter("funcid = 1").orderBy("sample_id").collect()
    assert [r.sample_id for r in rows] == [1, 2, 3, 4, 5, 6, 7] and [r.later for r in rows] == [None] * 6 + ["x"]


def test_scans_read_their_blocks_only(store):
    plan = store.load().functions.filter("tick_block = 1")._jdf.queryExecution().executedPlan().toString()
    assert "tick_block#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_tables_without_rows_and_failed_writes(spark, store):
    empty = repo(spark).functions.filter("false")
    store.save(Repository(functions=empty))
    assert store.load().functions.count() == 0 and store.load().functions.columns[:2] == ["server_id", "sample_id"]
    version = store.versions()[-1]
    broken = repo(spark).samples.withColumn("sample_time", F.expr("CAST(raise_error('lost') AS TIMESTAMP)"))
    with pytest.raises(Exception, match="lost"):
        store.save(Repository(samples=broken))
    assert store.versions()[-1] == version and ids(store.load().samples) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError, match="no version"):
        store.load(version=1)

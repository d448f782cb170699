"""Stored repositories: immutable files and a manifest for each version.

Facts and samples lie in ``<table>/tick_block=<block>/version=<version>``, other tables in ``<table>/version=<version>``. The
manifest of a version lists every folder that belongs to it, whichever version wrote it, with the table's schema; it is written
last, so a failed write changes nothing. A change therefore writes the blocks it touches and no others: new ticks add a folder to
their block, a delete writes its blocks anew. Earlier versions stay readable until ``vacuum``.

The manifest (table, block, version of the data, schema) has a row for each table and block and is read by the driver; data
never are.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterlake.model import SERVER, TICK, TICK_BLOCK, Repository

VERSION = "version"
_MANIFEST = "name string, block int, data long, schema string"
Entry = tuple[str, int | None, int, str]


def _blocked(name: str) -> bool:
    return name in Repository.FACTS or name == "samples"


def block_of(tick: str) -> Column:
    return F.floor(F.col(tick) / Repository.TICKS_PER_PARTITION).cast("int")


class Store:
    """A folder with a stored repository."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _folders(self, pattern: str) -> list:
        found = self.files.globStatus(self._at(pattern))
        return [] if found is None else [s.getPath() for s in found]

    def versions(self) -> list[int]:
        """All versions with a whole manifest, oldest first."""
        done = self._folders(f"_manifest/{VERSION}=*/_SUCCESS")
        return sorted(int(p.getParent().getName().partition("=")[2]) for p in done)

    def entries(self, version: int | None = None) -> list[Entry]:
        known = self.versions()
        if version is None and not known or version is not None and version not in known:
            raise ValueError(f"no version {'' if version is None else version} in {self.path}")
        rows = self.spark.read.schema(_MANIFEST).parquet(
            f"{self.path}/_manifest/{VERSION}={known[-1] if version is None else version}")
        return [tuple(r) for r in rows.collect()]

    def _write(self, name: str, df: DataFrame, version: int) -> list[Entry]:
        """Writes a table's rows and returns their entries. A table without rows has an entry for its schema alone."""
        df = df.drop(TICK_BLOCK)
        schema, target = df.schema.json(), f"{self.path}/{name}"
        if not _blocked(name):
            df.write.parquet(f"{target}/{VERSION}={version}")
            return [(name, None, version, schema)]
        (df.withColumn(TICK_BLOCK, block_of(TICK)).withColumn(VERSION, F.lit(version))
           .repartitionByRange(TICK_BLOCK, SERVER, TICK).sortWithinPartitions(TICK_BLOCK, SERVER, TICK)
           .write.mode("append").partitionBy(TICK_BLOCK, VERSION).parquet(target))
        written = self._folders(f"{name}/{TICK_BLOCK}=*/{VERSION}={version}")
        blocks = [int(p.getParent().getName().partition("=")[2]) for p in written]
        return [(name, b, version, schema) for b in blocks] or [(name, None, version, schema)]

    def _commit(self, version: int, entries: Iterable[Entry]) -> int:
        entries = list(entries)
        filled = {e[0] for e in entries if e[1] is not None}
        entries = [e for e in entries if e[1] is not None or e[0] not in filled]
        rows = self.spark.createDataFrame(entries, _MANIFEST)
        rows.coalesce(1).write.parquet(f"{self.path}/_manifest/{VERSION}={version}")
        return version

    def save(self, repo: Repository) -> int:
        """The tables of ``repo`` as a new version; tables that it does not have stay as they are."""
        version, tables = time.time_ns(), repo.present()
        kept = [e for e in (self.entries() if self.versions() else []) if e[0] not in tables]
        return self._commit(version, kept + [e for name, df in tables.items() for e in self._write(name, df, version)])

    def append(self, repo: Repository) -> int:
        """Adds rows of new ticks to facts and samples; other tables of ``repo`` replace the stored ones."""
        version, old = time.time_ns(), self.entries()
        tables = repo.present()
        kept = [e for e in old if e[0] not in tables or _blocked(e[0])]
        return self._commit(version, kept + [e for name, df in tables.items() for e in self._write(name, df, version)])

    def replace(self, repo: Repository, blocks: Iterable[int]) -> int:
        """Facts and samples of ``repo`` take the place of the stored blocks; other tables replace the stored ones."""
        version, blocks, old = time.time_ns(), set(blocks), self.entries()
        tables, within = repo.present(), block_of(TICK).isin(*blocks)
        kept = [e for e in old if e[0] not in tables or (_blocked(e[0]) and e[1] is not None and e[1] not in blocks)]
        new = [e for name, df in tables.items()
               for e in self._write(name, df.filter(within) if _blocked(name) else df, version)]
        return self._commit(version, kept + new)

    def load(self, names: Iterable[str] | None = None, version: int | None = None) -> Repository:
        """The named tables, or all, as of the newest or the given version. Blocks without a later column show NULL in it."""
        found: dict[str, list[Entry]] = {}
        for entry in self.entries(version):
            found.setdefault(entry[0], []).append(entry)
        return Repository(**{n: self._table(n, found[n]) for n in (names or found)})

    def _table(self, name: str, entries: list[Entry]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(max(entries, key=lambda e: e[2])[3]))
        target = f"{self.path}/{name}"
        if not _blocked(name):
            return self.spark.read.schema(schema).parquet(f"{target}/{VERSION}={entries[0][2]}")
        full = T.StructType([*schema.fields, T.StructField(TICK_BLOCK, T.IntegerType()), T.StructField(VERSION, T.LongType())])
        paths = [f"{target}/{TICK_BLOCK}={b}/{VERSION}={v}" for _, b, v, _ in entries if b is not None]
        rows = self.spark.read.schema(full).option("basePath", target).parquet(*paths) if paths else self.spark.createDataFrame([], full)
        return rows.drop(VERSION)

    def vacuum(self) -> None:
        """Deletes what the newest version does not list (no reader may be open on older ones)."""
        live = {(e[0], e[1], e[2]) for e in self.entries()}
        newest = self.versions()[-1]
        for folder in self._folders(f"*/{VERSION}=*"):
            name, version = folder.getParent().getName(), int(folder.getName().partition("=")[2])
            keep = version == newest if name == "_manifest" else (name, None, version) in live
            if not keep:
                self.files.delete(folder, True)
        for folder in self._folders(f"*/{TICK_BLOCK}=*/{VERSION}=*"):
            block, version = (int(p.getName().partition("=")[2]) for p in (folder.getParent(), folder))
            if (folder.getParent().getParent().getName(), block, version) not in live:
                self.files.delete(folder, True)

"""Export of a repository as JSON rows and import of such rows.

An export is one DataFrame (section_id, row_data). Import parses the rows of a section with the
schema of its target table, maps server ids, and loads only keys the target lacks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from counterlake.functions.text import text_id
from counterlake.model import SERVER, TICK, TICK_BLOCK, Repository
from counterlake.operators.dictionary import UNKNOWN_ROLE, repair_last_seen
from counterlake.operators.lifecycle import DICTIONARIES
from counterlake.operators.settings import IDENTITY_NAME

# Sections of an export in order; ids follow from the position.
SECTION_ORDER = ("servers", "samples", "baselines", "bl_samples", "settings", "tablespaces_list",
                 "roles_list", "stmt_list", "tables_list", "indexes_list", "funcs_list",
                 *Repository.FACTS)
SECTION_ID = {name: n for n, name in enumerate(SECTION_ORDER, 1)}
# Key columns of every table, for loading only what is missing.
KEYS: dict[str, tuple[str, ...]] = {
    "servers": (SERVER,), "samples": (SERVER, TICK), "baselines": (SERVER, "bl_id"),
    "bl_samples": (SERVER, "bl_id", TICK),
    "settings": (SERVER, "setting_scope", "name", "first_seen"),
    "databases": (SERVER, TICK, "datid"), "tablespaces": (SERVER, TICK, "tablespaceid"),
    "cluster": (SERVER, TICK), "wal": (SERVER, TICK), "archiver": (SERVER, TICK),
    "waits": (SERVER, TICK, "event_type", "event"), "tables": (SERVER, TICK, "datid", "relid"),
    "indexes": (SERVER, TICK, "datid", "indexrelid"),
    "functions": (SERVER, TICK, "datid", "funcid"),
    "statements": (SERVER, TICK, "datid", "userid", "queryid", "toplevel"),
    "usage": (SERVER, TICK, "datid", "userid", "queryid", "toplevel"),
    "table_totals": (SERVER, TICK, "datid", "tablespaceid", "relkind"),
    "index_totals": (SERVER, TICK, "datid", "tablespaceid"),
    "function_totals": (SERVER, TICK, "datid", "trg_fn"),
    "statement_totals": (SERVER, TICK, "datid"), "usage_totals": (SERVER, TICK, "datid"),
    **{name: tuple(keys) for name, (_, keys) in DICTIONARIES.items()},
}


#: Timestamps keep their microseconds on the way through JSON.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_MALFORMED = "_malformed"


def _in_range(df: DataFrame, low: int | None, high: int | None) -> DataFrame:
    if low is not None:
        df = df.filter(F.col(TICK) >= low)
    return df if high is None else df.filter(F.col(TICK) <= high)


def _inside_baselines(bl_samples: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Baselines that lie wholly inside the exported range of samples."""
    spans = bl_samples.groupBy(SERVER, "bl_id").agg(F.min(TICK).alias("_a"),
                                                    F.max(TICK).alias("_b"))
    if low is not None:
        spans = spans.filter(F.col("_a") >= low)
    if high is not None:
        spans = spans.filter(F.col("_b") <= high)
    return spans.select(SERVER, "bl_id")


def export_rows(repo: Repository, server_id: int | None = None, low: int | None = None,
                high: int | None = None, obfuscate: bool = False) -> DataFrame:
    """(section_id, row_data) of every table, optionally of one server and a sample range.

    Texts of statements are exported for the exported statements only; ``obfuscate`` replaces
    them by their md5.
    """
    tables = repo.present()
    if server_id is not None:
        tables = {n: df.filter(F.col(SERVER) == server_id) for n, df in tables.items()}
    for name in tables:
        if name == "samples" or name in Repository.FACTS:
            tables[name] = _in_range(tables[name], low, high)
    if "bl_samples" in tables:
        whole = _inside_baselines(tables["bl_samples"], low, high)
        for name in ("baselines", "bl_samples"):
            if name in tables:
                tables[name] = tables[name].join(whole, [SERVER, "bl_id"], "left_semi")
    if "stmt_list" in tables:
        if "statements" in tables:
            used = tables["statements"].select(SERVER, "queryid_md5")
            tables["stmt_list"] = tables["stmt_list"].join(used, [SERVER, "queryid_md5"],
                                                           "left_semi")
        if obfuscate:
            tables["stmt_list"] = tables["stmt_list"].withColumn("query",
                                                                 F.md5(F.col("query")))
    out = None
    for name in SECTION_ORDER:
        if name not in tables:
            continue
        df = tables[name].drop(TICK_BLOCK)
        rows = df.select(F.lit(SECTION_ID[name]).alias("section_id"),
                         F.to_json(F.struct(*df.columns), JSON_OPTIONS).alias("row_data"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_export(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    rows.write.mode("overwrite").partitionBy("section_id").format(fmt).save(path)


def schemas_of(repo: Repository) -> dict[str, StructType]:
    """The schema of every table present; an import into a repository that lacks tables needs those of the source."""
    return {name: df.drop(TICK_BLOCK).schema for name, df in repo.present().items()}


def _parsed(exported: DataFrame, name: str, schema: StructType) -> DataFrame:
    marked = StructType([*schema.fields, StructField(_MALFORMED, StringType())])
    options = {**JSON_OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _MALFORMED}
    rows = exported.filter(F.col("section_id") == SECTION_ID[name])
    return rows.select(F.from_json("row_data", marked, options).alias("r"), "row_data")


def section_rows(exported: DataFrame, name: str, like: DataFrame | StructType) -> DataFrame:
    """Rows of one section, parsed with the schema of the table they belong to."""
    schema = like if isinstance(like, StructType) else like.drop(TICK_BLOCK).schema
    return _parsed(exported, name, schema).select(*[f"r.{f.name}" for f in schema.fields])


def malformed_rows(exported: DataFrame, schemas: dict[str, StructType]) -> DataFrame:
    """(section_id, row_data) that do not parse as rows of their table, or belong to no known section."""
    known = [n for n in SECTION_ORDER if n in schemas]
    bad = exported.filter(~F.col("section_id").isin([SECTION_ID[n] for n in known]))
    for name in known:
        broken = _parsed(exported, name, schemas[name]).filter(f"r IS NULL OR r.{_MALFORMED} IS NOT NULL")
        bad = bad.unionByName(broken.select(F.lit(SECTION_ID[name]).alias("section_id"), "row_data"))
    return bad


def match_servers(imported: DataFrame, imported_settings: DataFrame, local: DataFrame,
                  local_settings: DataFrame, prefix: str = "") -> DataFrame:
    """Verdict per imported server.

    ``match``     same creation time and identity: rows go to ``local_id``
    ``conflict``  a different local server has the (prefixed) name
    ``new``       no local counterpart; a new id above all local ids is assigned
    """
    def identity(settings: DataFrame, out: str) -> DataFrame:
        return (settings.filter(F.col("name") == IDENTITY_NAME).groupBy(SERVER)
                .agg(F.max("reset_val").alias(out)))

    theirs = imported.join(identity(imported_settings, "_id"), SERVER).select(
        F.col(SERVER).alias("imported_id"), F.concat(F.lit(prefix), "server_name")
        .alias("server_name"), F.col("server_created").alias("_created"), "_id")
    ours = local.join(identity(local_settings, "_lid"), SERVER, "left").select(
        F.col(SERVER).alias("_local"), F.col("server_name").alias("_lname"),
        F.col("server_created").alias("_lcreated"), "_lid")
    same = ours.select(F.col("_local").alias("_same"), F.col("_lcreated").alias("_created"),
                       F.col("_lid").alias("_id"))
    named = ours.select(F.col("_local").alias("_named"), F.col("_lname").alias("server_name"))
    verdicts = theirs.join(same, ["_created", "_id"], "left").join(named, "server_name", "left")
    verdict = (F.when(F.col("_same").isNotNull(), "match")
               .when(F.col("_named").isNotNull(), "conflict").otherwise("new"))
    highest = local.agg(F.coalesce(F.max(SERVER), F.lit(0)).alias("_top"), F.lit(1).alias("_j"))
    numbered = verdicts.withColumn("verdict", verdict).withColumn("_j", F.lit(1))
    numbered = numbered.join(highest, "_j")
    # new servers are few metadata rows; ids follow the imported order
    nth = F.expr("sum(CASE WHEN verdict = 'new' THEN 1 ELSE 0 END) "
                 "OVER (PARTITION BY _j ORDER BY imported_id)")
    local_id = (F.when(F.col("verdict") == "match", F.col("_same"))
                .when(F.col("verdict") == "new", F.col("_top") + nth))
    return numbered.select("imported_id", "server_name", "verdict",
                           local_id.cast("int").alias("local_id"))


def map_server_ids(rows: DataFrame, id_map: DataFrame) -> DataFrame:
    """Rows with the local id of their server; rows of unmapped servers are dropped."""
    ids = id_map.filter("local_id IS NOT NULL").select(
        F.col("imported_id").alias(SERVER), F.col("local_id").alias("_local"))
    return (rows.join(ids, SERVER).withColumn(SERVER, F.col("_local")).select(*rows.columns))


def missing_rows(rows: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Imported rows whose key the target does not hold, each once."""
    return rows.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")


def merged_servers(imported: DataFrame, local: DataFrame, id_map: DataFrame) -> DataFrame:
    """Local servers with the new ones; a server known on both sides takes the newer last sample."""
    names = id_map.select(F.col("imported_id").alias(SERVER), "local_id",
                          *([F.col("server_name").alias("_name")] if "server_name" in id_map.columns else []))
    theirs = imported.join(names, SERVER).withColumn(SERVER, F.col("local_id"))
    if "_name" in theirs.columns and "server_name" in local.columns:
        theirs = theirs.withColumn("server_name", F.coalesce("_name", "server_name"))
    theirs = theirs.select(*local.columns)
    new = theirs.join(local.select(SERVER), SERVER, "left_anti").select(*local.columns)
    if "last_sample_id" in local.columns:
        newer = theirs.select(SERVER, F.col("last_sample_id").alias("_newer"))
        local = local.join(newer, SERVER, "left").withColumn(
            "last_sample_id", F.greatest("last_sample_id", "_newer")).select(*local.columns)
    return local.unionByName(new)


def import_rows(exported: DataFrame, target: Repository, id_map: DataFrame,
                schemas: dict[str, StructType] | None = None) -> tuple[Repository, DataFrame]:
    """The target with everything the export adds, and the number of new rows per table.

    ``schemas`` are those of the source, for tables that the target lacks (default: the target's). Rows that do not parse,
    sections without a schema and servers in conflict are errors: nothing is left out in silence. Dictionaries are repaired
    afterwards: objects without a fact in the newest sample were last seen at their newest fact.
    """
    schemas = {**(schemas or {}), **schemas_of(target)}
    bad = malformed_rows(exported, schemas).limit(3).collect()
    if bad:
        raise ValueError(f"rows that fit no table, such as {[tuple(r) for r in bad]}")
    if "verdict" in id_map.columns:
        conflicts = [r.server_name for r in id_map.filter("verdict = 'conflict'").select("server_name").limit(10).collect()]
        if conflicts:
            raise ValueError(f"other local servers are named {conflicts}: import with a prefix")
    spark = exported.sparkSession
    tables, counts = target.present(), None
    loaded: dict[str, DataFrame] = {}
    for name in SECTION_ORDER:
        if name not in schemas:
            continue
        own = tables[name].drop(TICK_BLOCK) if name in tables else spark.createDataFrame([], schemas[name])
        if name == "servers":
            loaded[name] = merged_servers(section_rows(exported, name, schemas[name]), own, id_map)
            continue
        rows = map_server_ids(section_rows(exported, name, schemas[name]), id_map)
        new = missing_rows(rows, own, KEYS[name])
        loaded[name] = own.unionByName(new)
        count = new.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows")
        counts = count if counts is None else counts.unionByName(count)
    for name, (facts, keys) in DICTIONARIES.items():
        if name in loaded and facts in loaded and "last_sample_id" in loaded[name].columns:
            loaded[name] = repair_last_seen(loaded[name], loaded[facts], keys,
                                            loaded["samples"])
    return target.with_tables(**loaded), counts


def text_id_map(texts: DataFrame) -> DataFrame:
    """(server_id, old id, new id) for texts that were keyed by an older, shorter hash."""
    return texts.select(SERVER, F.col("queryid_md5").alias("old_id"),
                        text_id(F.col("query")).alias("new_id")).distinct()


def remap_text_ids(facts: DataFrame, id_map: DataFrame) -> DataFrame:
    """Facts with the new text ids; facts whose old id is unknown keep it."""
    ids = id_map.select(SERVER, F.col("old_id").alias("queryid_md5"), "new_id")
    joined = facts.join(ids, [SERVER, "queryid_md5"], "left")
    return (joined.withColumn("queryid_md5", F.coalesce("new_id", "queryid_md5"))
                  .select(*facts.columns))


def roles_of_facts(facts: DataFrame) -> DataFrame:
    """Placeholder roles for facts imported from versions without role names."""
    return facts.select(SERVER, "userid").distinct().withColumn("username", F.lit(UNKNOWN_ROLE))

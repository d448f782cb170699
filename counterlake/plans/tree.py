"""Order, nesting and gates of report sections.

A section is shown for a server if the server has every feature on the way from the root down to the section, in any of the
intervals. Sections without rows of their own only gather others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from counterlake.model import SERVER

# Section, the section it lies in, its place there, the feature it asks for, and whether it is part of the report
# of one interval (1), of the comparison (2), or of both.
TREE: tuple[tuple[str, str | None, int, str | None, tuple[int, ...]], ...] = (
    ("capacity_1", None, 10, None, (1, 2)),
    ("capacity_2", None, 20, None, (2,)),
    ("server", None, 30, None, (1, 2)),
    ("resets_db", "server", 10, None, (1, 2)),
    ("q1", "server", 20, None, (1, 2)),
    ("q2", "server", 30, "sessions", (1, 2)),
    ("q3", "server", 40, "statements", (1, 2)),
    ("q4", "server", 50, "jit", (1, 2)),
    ("resets_cluster", "server", 60, None, (1, 2)),
    ("q5", "server", 70, None, (1, 2)),
    ("resets_wal", "server", 80, "wal", (1, 2)),
    ("q6", "server", 90, "wal", (1, 2)),
    ("q7", "server", 100, None, (1, 2)),
    ("waits", "server", 110, "waits", (1, 2)),
    ("q8", "waits", 10, "waits", (1, 2)),
    ("q9_stmt", "waits", 20, "waits", (1, 2)),
    ("q9_all", "waits", 30, "waits", (1, 2)),
    ("sql", None, 40, "statements", (1, 2)),
    ("q10", "sql", 10, "planning_times", (1, 2)),
    ("q11", "sql", 20, "planning_times", (1, 2)),
    ("q12", "sql", 30, None, (1, 2)),
    ("q13", "sql", 40, None, (1, 2)),
    ("q14", "sql", 50, "io_times", (1, 2)),
    ("q15", "sql", 60, None, (1, 2)),
    ("q16", "sql", 70, None, (1, 2)),
    ("q17", "sql", 80, None, (1, 2)),
    ("q18", "sql", 90, None, (1, 2)),
    ("q19", "sql", 100, "statement_wal", (1, 2)),
    ("q20", "sql", 110, None, (1, 2)),
    ("q21", "sql", 120, "jit", (1, 2)),
    ("usage", "sql", 130, "usage_exec", (1, 2)),
    ("q22", "usage", 10, None, (1, 2)),
    ("q23", "usage", 20, None, (1, 2)),
    ("texts", "sql", 140, None, (1, 2)),
    ("objects", None, 50, None, (1, 2)),
    ("q25", "objects", 10, None, (1, 2)),
    ("q26", "objects", 20, None, (1, 2)),
    ("q27", "objects", 30, None, (1, 2)),
    ("q28", "objects", 40, None, (1, 2)),
    ("q29", "objects", 50, None, (1, 2)),
    ("q30", "objects", 60, None, (1, 2)),
    ("q31", "objects", 70, None, (1, 2)),
    ("q32", "objects", 80, None, (1, 2)),
    ("q33", "objects", 90, None, (1, 2)),
    ("q34", "objects", 100, None, (1,)),
    ("funcs", None, 60, "functions", (1, 2)),
    ("q35", "funcs", 10, None, (1, 2)),
    ("q36", "funcs", 20, None, (1, 2)),
    ("q37", "funcs", 30, "trigger_functions", (1, 2)),
    ("vacuum", None, 70, None, (1, 2)),
    ("q38", "vacuum", 10, None, (1, 2)),
    ("q39", "vacuum", 20, None, (1, 2)),
    ("q40", "vacuum", 30, None, (1, 2)),
    ("q41", "vacuum", 40, None, (1,)),
    ("q42", "vacuum", 50, None, (1,)),
    ("settings", None, 80, None, (1, 2)),
    ("capacity_all", None, 90, None, (1, 2)),
)


def sections_of(n_intervals: int) -> set[str]:
    return {row[0] for row in TREE if n_intervals in row[4]}


def walked(spark: SparkSession, n_intervals: int) -> DataFrame:
    """sect_id, sect_ord and gates (the features of the section and of all that it lies in), by a recursive query."""
    def text(value: str | None) -> str:
        return "CAST(NULL AS STRING)" if value is None else f"'{value}'"

    rows = ", ".join(f"('{name}', {text(parent)}, {place}, {text(gate)})"
                     for name, parent, place, gate, reports in TREE if n_intervals in reports)
    return spark.sql(f"""
        WITH RECURSIVE tree AS (SELECT * FROM VALUES {rows} AS t(sect_id, parent, place, gate)),
        walk(sect_id, path, gates) AS (
            SELECT sect_id, array(place), coalesce(gate, '') FROM tree WHERE parent IS NULL
            UNION ALL
            SELECT tree.sect_id, array_append(path, place), concat_ws(',', gates, gate)
            FROM walk JOIN tree ON tree.parent = walk.sect_id)
        SELECT sect_id, CAST(row_number() OVER (ORDER BY path) AS INT) AS sect_ord,
            array_distinct(array_remove(split(gates, ','), '')) AS gates FROM walk""")


def shown(frame: DataFrame, enabled: DataFrame, n_intervals: int) -> DataFrame:
    """The rows of ``frame`` (sect_id, server and others) whose server has all gates, with sect_ord. enabled: server, feature."""
    tree = walked(frame.sparkSession, n_intervals)
    met = tree.selectExpr("sect_id", "explode(gates) AS feature").join(enabled, "feature").groupBy("sect_id", SERVER).count()
    asked = tree.selectExpr("sect_id", "sect_ord", "CAST(size(gates) AS BIGINT) AS n_gates")
    return frame.join(asked, "sect_id").join(met, ["sect_id", SERVER], "left").filter(
        "n_gates = coalesce(`count`, 0)").drop("n_gates", "count")

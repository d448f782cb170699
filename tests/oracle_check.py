"""Compare a registered query with its oracle SQL on the same tables, types included."""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def oracle_table(con, sql: str) -> pa.Table:
    return con.sql(sql).to_arrow_table()


def _types(table: pa.Table) -> dict[str, str]:
    names = {}
    for field in table.schema:
        kind = str(field.type).replace("large_string", "string")
        names[field.name] = "timestamp" if kind.startswith("timestamp") else kind
    return names


def _rows(table: pa.Table, round_to: int | None) -> list[tuple]:
    columns = sorted(table.column_names)
    out = []
    for row in table.select(columns).to_pylist():
        values = []
        for c in columns:
            v = row[c]
            if isinstance(v, float) and not math.isnan(v) and round_to is not None:
                v = float(f"{v:.{round_to}g}")
            if hasattr(v, "tzinfo") and v.tzinfo is not None:
                v = v.replace(tzinfo=None)
            values.append(repr(v))
        out.append(tuple(values))
    return sorted(out)


def compare(spark_df, con, sql: str, round_to: int | None = None) -> str | None:
    """None when equal, else a description of the first difference."""
    mine, theirs = spark_df.toArrow(), oracle_table(con, sql)
    if _types(mine) != _types(theirs):
        a, b = _types(mine), _types(theirs)
        return f"schema {({k: (a.get(k), b.get(k)) for k in sorted({*a, *b}) if a.get(k) != b.get(k)})}"
    if mine.num_rows != theirs.num_rows:
        return f"rows {mine.num_rows} vs {theirs.num_rows}"
    a, b = _rows(mine, round_to), _rows(theirs, round_to)
    if a != b:
        extra = [x for x in a if x not in set(b)][:1]
        missing = [x for x in b if x not in set(a)][:1]
        return f"values: spark {extra} oracle {missing} columns {sorted(mine.column_names)}"
    return None

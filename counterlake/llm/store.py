"""Intermediate tables of the operators: in the shared folder of the session, with a reader that keeps the schema."""

from __future__ import annotations

from pyspark.sql import DataFrame

from counterlake.session import materialise


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the folder of spark.checkpoint.dir: computed once, and safe when executors are lost."""
    return materialise(df, f"llm-{name}")


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

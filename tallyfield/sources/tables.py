"""Typed tables with a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from tallyfield.operators.insert import new_rows


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def create_if_absent(
    spark: SparkSession,
    table: str,
    schema: StructType,
    location: str | None = None,
    key: str | None = None,
    buckets: int | None = None,
) -> None:
    """``CREATE TABLE IF NOT EXISTS`` in Parquet, under the warehouse unless ``location`` is given.

    For a large table give ``key`` and ``buckets``: rows are then stored by key, and inserts join
    to the table without shuffling it.
    """
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    clauses = ["USING parquet"]
    if key and buckets:
        clauses.append(f"CLUSTERED BY ({_quoted(key)}) INTO {buckets} BUCKETS")
    if location:
        escaped = location.replace("\\", "\\\\").replace("'", "\\'")
        clauses.append(f"LOCATION '{escaped}'")
    name = ".".join(map(_quoted, table.split(".")))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) {' '.join(clauses)}")


def rows_in_order(
    spark: SparkSession, rows: Sequence[tuple], schema: StructType, seq: str = "seq"
) -> DataFrame:
    """A small literal batch with its row order in ``seq``."""
    ordered = StructType([StructField(seq, LongType()), *schema.fields])
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], ordered)


def insert_or_ignore_into(
    spark: SparkSession, table: str, batch: DataFrame, key: str, seq: str = "seq"
) -> None:
    """Appends the rows of ``batch`` whose key is new, in one job commit.

    Running it again adds nothing, so it may be repeated after a failure. Two writers at the same
    time are not kept apart: Parquet tables have no transactions.
    """
    stored = spark.table(table)
    fresh = new_rows(stored, batch, key, seq).select(*stored.columns)
    fresh.write.insertInto(table)
    spark.catalog.refreshTable(table)

"""Looking at a table: shape, column types, first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def schema_table(df: DataFrame) -> DataFrame:
    """One row per column: its name, its type, and how many of its values are present. One scan,
    combined before the shuffle; a table without rows still has its columns."""
    counts = df.agg(*[F.count(F.col(_quoted(c))).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(kind).alias("dtype"), F.col(f"c{i}").alias("n_present"))
        for i, (c, kind) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*rows)))


def column_count(df: DataFrame, name: str = "n_cols") -> DataFrame:
    return schema_table(df).agg(F.count("*").alias(name))


def shape(df: DataFrame) -> DataFrame:
    """Rows and columns in one scan that reads no column."""
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in the given order. Spark rows have no position, so an order is needed."""
    return df.orderBy(*order).limit(n)

"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.session import scratch_path

# White space that separates words: blank, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: the lineage ends here, and a
    lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as it must be written where dots would part it."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame, names: list[str] | None = None) -> Column:
    """All columns as one struct, so that none can clash with those of an operator."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in (docs.columns if names is None else names)])


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows``, stored, with ``__rank``: a number from 0 on for each row among those of its key.

    Rows are dealt by ranges of key and of a number of their own, so a key with most of the rows fills many
    tasks. A row's place in its task is known from the order alone; one row per key and task says how many
    rows of the key come before.
    """
    marked = rows.withColumn("__tie", F.monotonically_increasing_id())
    ordered = marked.repartitionByRange(key, "__tie").sortWithinPartitions(key).drop("__tie")
    placed = stored(ordered.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    held = placed.groupBy(F.col(key).alias("__key"), part.alias("__part")).agg(
        F.min("__at").alias("__first"), F.count("*").alias("__held")
    )
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("__before", F.coalesce(F.sum("__held").over(before), F.lit(0)))
    met = placed.join(held, (F.col(key) == F.col("__key")) & (part == F.col("__part")))
    rank = F.col("__at") - F.col("__first") + F.col("__before")
    return met.select(*[F.col(quoted(c)) for c in rows.columns], rank.alias("__rank"))


def n_words(text: Column) -> Column:
    """Number of runs of non-blank characters; 0 for NULL.

    A run ends where a non-blank is followed by a blank or by nothing, so all characters but
    those are removed from a text in which every blank is the same.
    """
    trimmed = F.btrim(text, F.lit(BLANKS))
    one = F.regexp_replace(trimmed, r"[\x20\x09-\x0D]+", " ")
    words = F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit(""))) + 1
    return F.coalesce(F.when(F.length(trimmed) > 0, words), F.lit(0)).cast("long")

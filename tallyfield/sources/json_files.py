"""JSON records in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType


def read_json(
    spark: SparkSession, path: str | list[str], schema: StructType, one_per_line: bool = False
) -> DataFrame:
    """Records from landed responses, each file one JSON array (or object), or one record a line.

    A file that is one array is read by one task; a table that is large as a whole should be
    landed as many responses or as lines. Text that is no such JSON, or a value of another type,
    fails the read.
    """
    reader = spark.read.schema(schema).option("multiLine", not one_per_line)
    return reader.option("mode", "FAILFAST").json(path)


def records_of(df: DataFrame, column: str, schema: StructType) -> DataFrame:
    """Records from a text column whose values are JSON arrays of records; a missing value has none,
    and one that does not parse fails the query."""
    parsed = F.from_json(column, ArrayType(schema), {"mode": "FAILFAST"})
    return df.select(F.explode(parsed).alias("record")).select("record.*")


def record_text(df: DataFrame, indented: bool = False) -> Column:
    """The row as a JSON object; missing values are written as null, not left out."""
    options = {"ignoreNullFields": "false", "pretty": str(indented).lower()}
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), options)


def json_rows(df: DataFrame, indented: bool = False, name: str = "json") -> DataFrame:
    return df.select(record_text(df, indented).alias(name))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record a line, in parallel."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def json_array_lines(df: DataFrame, key: str) -> DataFrame:
    """``part, position, line``: in this order, the lines are one JSON array of all records.

    One row per record, so the document may be larger than any machine. The record with the largest
    key ends the array: if two records share that key, or a key is missing, the query fails. Rows are
    counted per key, combined before the shuffle.
    """
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    last = counts.agg(F.max(F.struct("key", "n"))).scalar()

    def fails(why: str) -> Column:
        return F.raise_error(F.lit(f"{why} in column {key}")).cast("string")

    after = (
        F.when(F.col(key).isNull(), fails("missing key"))
        .when(F.col(key) < last["key"], ",")
        .when(last["n"] > 1, fails("shared last key"))
        .otherwise("")
    )
    records = df.select(
        F.lit(1).alias("part"), F.col(key).alias("position"), F.concat(record_text(df), after).alias("line")
    )
    edges = df.sparkSession.createDataFrame(
        [(0, None, "["), (2, None, "]")],
        StructType()
        .add("part", IntegerType())
        .add("position", df.schema[key].dataType)
        .add("line", StringType()),
    )
    return records.unionByName(edges)


def write_json_array(df: DataFrame, key: str, path: str, mode: str = "errorifexists") -> None:
    """Writes the array as text parts that make one JSON document when put together by name."""
    lines = json_array_lines(df, key).orderBy("part", "position")
    lines.select("line").write.mode(mode).text(path)

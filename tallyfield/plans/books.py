"""The small catalogue: a keyed table, its JSON, and an address read from a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.text import first_match
from tallyfield.schema import BOOKS
from tallyfield.sources import json_files, tables

# The first content of the table, and the address form and default text of the log.
FIRST_BOOKS = [(1, "1984", "George Orwell", 1949), (2, "Dune", "Frank Herbert", 1965)]
PUBLIC_ADDRESS = r"https://[-a-z0-9]+\.trycloudflare\.com"
NOT_YET = "Still starting… re-run this cell."


def create_books(spark: SparkSession, table: str = "books", location: str | None = None) -> None:
    tables.create_if_absent(spark, table, BOOKS, location)


def add_books(spark: SparkSession, batch: DataFrame, table: str = "books") -> DataFrame:
    """Adds the books whose id is new (``seq`` orders the batch) and returns the table."""
    tables.insert_or_ignore_into(spark, table, batch, key="id")
    return spark.table(table)


def seed_books(
    spark: SparkSession, table: str = "books", location: str | None = None
) -> DataFrame:
    """Creates and fills the table; doing it again changes nothing."""
    create_books(spark, table, location)
    return add_books(spark, tables.rows_in_order(spark, FIRST_BOOKS, BOOKS), table)


def books_json(books: DataFrame, indented: bool = False) -> DataFrame:
    return json_files.json_rows(books.select(*BOOKS.fieldNames()), indented)


def books_from_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Books from landed responses."""
    return json_files.read_json(spark, path, BOOKS)


def address_in(
    df: DataFrame, column: str, pattern: str = PUBLIC_ADDRESS, default: str = NOT_YET
) -> DataFrame:
    """The first address in each text, as a column ``url``."""
    return df.withColumn("url", first_match(F.col(column), pattern, default))

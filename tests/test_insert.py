"""Keyed inserts."""

import json

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import insert
from tallyfield.plans import books
from tallyfield.schema import BOOKS
from tallyfield.session import scratch_path
from tallyfield.sources import json_files, tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def new_table(spark, buckets=None):
    location = scratch_path(spark, "t")
    name = "t_" + location.rsplit("-", 1)[1]
    tables.create_if_absent(spark, name, BOOKS, location, key="id", buckets=buckets)
    return name


def test_seeding_twice(spark):
    location = scratch_path(spark, "seed")
    name = "seed_" + location.rsplit("-", 1)[1]
    books.seed_books(spark, name, location)
    again = books.seed_books(spark, name, location)
    assert rows(again) == books.FIRST_BOOKS
    assert again.schema.simpleString() == BOOKS.simpleString()


@pytest.mark.parametrize("buckets", [None, 4])
def test_existing_and_repeated_keys(spark, buckets):
    name = new_table(spark, buckets)
    first = tables.rows_in_order(spark, books.FIRST_BOOKS, BOOKS)
    books.add_books(spark, first, name)
    batch = [(2, "x", "x", 0), (3, "z first", None, 1), (3, "a second", "b", 2)]
    after = books.add_books(spark, tables.rows_in_order(spark, batch, BOOKS), name)
    assert rows(after)[:2] == books.FIRST_BOOKS
    assert [tuple(r) for r in after.where("id = 3").collect()] == [(3, "z first", None, 1)]
    text = json_files.json_rows(after.where("id = 3")).first().json
    assert json.loads(text) == {"id": 3, "title": "z first", "author": None, "year": 1}


def test_missing_key_fails(spark):
    stored = spark.createDataFrame([], BOOKS)
    batch = tables.rows_in_order(spark, [(None, "t", "a", 1)], BOOKS)
    with pytest.raises(Exception, match="missing key"):
        insert.insert_or_ignore(stored, batch, "id", "seq").collect()


def test_one_key_with_most_of_the_batch(spark):
    stored = spark.createDataFrame([(1, "kept")], "id long, v string")
    batch = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("id"),
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"),
        F.col("id").alias("seq"),
    )
    after = insert.insert_or_ignore(stored, batch, "id", "seq")
    found = dict(rows(after))
    assert after.count() == len(found)
    assert (found[1], found[7], found[2]) == ("kept", "v0", "v2")


def test_table_stored_by_key_is_not_shuffled(spark):
    name = new_table(spark, buckets=8)
    batch = tables.rows_in_order(spark, books.FIRST_BOOKS, BOOKS)
    books.add_books(spark, batch, name)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = insert.new_rows(spark.table(name), batch, "id", "seq")
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    (scan,) = [i for i, line in enumerate(lines) if "Bucketed: true" in line]
    assert any("LeftAnti" in line for line in lines)
    assert not any("Exchange" in line for line in lines[scan - 3 : scan])


def test_repeated_and_missing_numbers(spark):
    """Rows of one key with the same number: one of them, whole, and the same one each time."""
    stored = spark.createDataFrame([(1, "kept", 1)], "id long, k string, s int")
    rows = [(1, "no", 0, 0), (2, "a", 1, 5), (2, "b", 2, 5), (2, "a", 1, 5), (3, "late", 1, 9), (3, "unnumbered", 2, None), (4, None, None, 1)]
    batch = spark.createDataFrame(rows, "id long, k string, s int, seq long")
    found = [sorted(map(tuple, insert.new_rows(stored, batch.repartition(n), "id", "seq").collect())) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2]
    assert found[0][0] in [(2, "a", 1), (2, "b", 2)]
    assert found[0][1:] == [(3, "unnumbered", 2), (4, None, None)]


def test_keys_alone(spark):
    stored = spark.createDataFrame([(1,)], "id long")
    batch = spark.createDataFrame([(1, 0), (2, 1), (2, 2)], "id long, seq long")
    assert rows(insert.new_rows(stored, batch, "id", "seq")) == [(2,)]

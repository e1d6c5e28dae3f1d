"""Counts and means: missing keys, ties, rounding, labels."""

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import groups, inspect


def test_missing_keys_are_in_no_group(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), (None, 1.0), ("b", float("nan")), ("a", 1.0)],
        "k string, v double",
    )
    assert [tuple(r) for r in groups.group_size(df, ["k", "v"]).collect()] == [("a", 1.0, 2)]
    assert [tuple(r) for r in groups.value_counts(df, "k").collect()] == [("a", 3), ("b", 1)]


def test_value_counts_order(spark):
    df = spark.createDataFrame([(k,) for k in "ccbbad"], "k string")
    assert [r.k for r in groups.value_counts(df, "k").collect()] == ["b", "c", "a", "d"]


def test_all_ties_lead(spark):
    df = spark.createDataFrame([(k,) for k in "ccbba"], "k string")
    assert [tuple(r) for r in groups.top_groups(df, ["k"]).collect()] == [("b", 2), ("c", 2)]


def test_top_of_nothing(spark):
    assert groups.top_groups(spark.createDataFrame([], "k string"), ["k"]).count() == 0


def test_distinct_ignores_missing(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    assert groups.distinct_count(df, "k", "n").first().n == 2
    assert groups.distinct_count(df, "k", "n", approximate=True).first().n == 2


def test_means_skip_missing_and_round_half_even(spark):
    df = spark.createDataFrame([(2.0,), (3.0,), (None,), (float("nan"),)], "v double")
    assert groups.rounded_mean(df, F.col("v"), "m").first().m == 2.0


def test_mean_per_group(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("a", float("nan")), (None, 9.0)], "k string, v double"
    )
    assert [tuple(r) for r in groups.mean_per_group(df, "k", "v", "m").collect()] == [("a", 1.5)]


@pytest.mark.parametrize(
    "rows,expected",
    [
        ([("t", 3.0), ("f", 2.0), ("t", None), (None, 9.0)], 50.0),
        ([("t", 3.0)], None),
        ([("f", 3.0)], None),
        ([("t", 3.0), ("f", 0.0)], None),
    ],
)
def test_percent_higher(spark, rows, expected):
    df = spark.createDataFrame(rows, "k string, v double")
    assert groups.percent_higher(df, "k", "v", "p").first().p == expected


def test_count_where(spark):
    df = spark.createDataFrame([("ESFC1",), ("xESFC",), (None,)], "c string")
    row = groups.count_where(
        df, inside=F.col("c").contains("ESFC"), front=F.col("c").startswith("ESFC")
    ).first()
    assert (row.inside, row.front) == (2, 1)


def test_inspection(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "i long, s string")
    assert [tuple(r) for r in inspect.schema_table(df).collect()] == [
        ("i", "bigint", 2),
        ("s", "string", 2),
    ]
    assert tuple(inspect.shape(df).first()) == (2, 2)
    assert inspect.row_count(df).first().n_rows == 2
    assert inspect.column_count(df).first().n_cols == 2
    assert [r.i for r in inspect.first_rows(df, 1, "i").collect()] == [1]

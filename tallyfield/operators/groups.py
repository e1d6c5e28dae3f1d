"""Counts, means and leaders of groups.

Rows whose key is missing belong to no group. Every count and mean is combined on the map side
first, so a key that holds a large share of the rows sends one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tallyfield.functions.missing import nan_to_null
from tallyfield.functions.numbers import percent_above, round_half_even


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows where no key is missing.

    Same rows as ``dropna``, but as plain NULL tests: those reach the Parquet scan, and vanish for
    a derived key that is never NULL.
    """
    for key in keys:
        df = df.where(F.col(key).isNotNull())
        if isinstance(df.schema[key].dataType, (DoubleType, FloatType)):
            df = df.where(~F.isnan(key))
    return df


def group_size(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return with_keys(df, keys).groupBy(*keys).agg(F.count("*").alias(name))


def value_counts(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return group_size(df, [key], name).orderBy(F.desc(name), key)


def largest(groups: DataFrame, measure: str) -> DataFrame:
    """Rows that hold the maximum of ``measure``, ties included.

    The maximum is a scalar subquery over the same shuffle output; ranking over all rows would
    need them in one partition.
    """
    top = groups.agg(F.max(measure)).scalar()
    return groups.where(F.col(measure) == top)


def top_groups(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """The group(s) with most rows, all ties, in key order."""
    return largest(group_size(df, keys, name), name).orderBy(*keys)


def distinct_count(df: DataFrame, column: str, name: str, approximate: bool = False) -> DataFrame:
    """Number of different non-missing values; exact unless the sketch is asked for."""
    count = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return df.agg(count.alias(name))


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with, per name, the number of rows where its condition holds, in one scan."""
    return df.agg(*[F.count_if(condition).alias(name) for name, condition in conditions.items()])


def rounded_mean(df: DataFrame, value: Column, name: str, digits: int = 0) -> DataFrame:
    return df.agg(round_half_even(F.avg(nan_to_null(value)), digits).alias(name))


def mean_per_group(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return (
        with_keys(df, [key]).groupBy(key).agg(F.avg(nan_to_null(F.col(value))).alias(name))
    )


def percent_higher(
    df: DataFrame, flag: str, value: str, name: str, high: str = "t", low: str = "f"
) -> DataFrame:
    """By how many percent the mean of ``value`` is higher where flag = high than where = low.

    Groups are addressed by label, in one pass; NULL if one of them has no values.
    """

    def mean_of(label: str) -> Column:
        return F.avg(F.when(F.col(flag) == label, nan_to_null(F.col(value))))

    return df.agg(percent_above(mean_of(high), mean_of(low)).alias(name))


def profile(df: DataFrame, key: str, **measures: Column) -> DataFrame:
    """Several named aggregates per group."""
    aggregates = [measure.alias(name) for name, measure in measures.items()]
    return with_keys(df, [key]).groupBy(key).agg(*aggregates)

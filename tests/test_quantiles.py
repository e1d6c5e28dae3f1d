"""Quantiles against numpy, bit for bit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import quantiles

PERCENTS = np.arange(1, 101)


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


def samples():
    rng = np.random.default_rng(3)
    skewed = np.concatenate([np.full(4000, 99.0), rng.lognormal(4, 2, 6000).round(2)])
    return {
        "one": [5.0],
        "two": [1.0, 2.0],
        "few": [3.0, -1.0, 2.5, 2.5],
        "all_equal": [7.0] * 500,
        "signs": rng.normal(0, 1, 3000),
        "hot_value": skewed,
        "far_outlier": np.append(rng.random(2000), 1e300),
        "tiny": rng.random(2000) * 1e-300,
        "many_distinct": rng.random(20000),
    }


@pytest.mark.parametrize("name", list(samples()))
def test_percentiles(spark, name):
    values = samples()[name]
    rows = quantiles.percentile_table(frame(spark, values), "x").collect()
    assert [r.percentile for r in rows] == list(PERCENTS)
    assert [r.value for r in rows] == list(np.percentile(np.asarray(values, float), PERCENTS))


def test_extremes_and_missing(spark):
    values = [None, float("nan"), 4.0, 1.0, None, 3.0, 2.0]
    rows = quantiles.exact_quantiles(frame(spark, values), "x", [0.0, 0.5, 1.0]).collect()
    assert sorted((r.fraction, r.value) for r in rows) == [(0.0, 1.0), (0.5, 2.5), (1.0, 4.0)]


def test_no_values(spark):
    rows = quantiles.exact_quantiles(frame(spark, [None, float("nan")]), "x", [0.5]).collect()
    assert [(r.fraction, r.value) for r in rows] == [(0.5, None)]


def test_whole_numbers(spark):
    df = spark.range(1, 102).select(F.col("id").alias("x"))
    rows = quantiles.percentile_table(df, "x").collect()
    assert [r.value for r in rows] == list(np.percentile(np.arange(1, 102), PERCENTS))


def test_approximate_is_an_element(spark):
    rows = quantiles.approximate_quantiles(frame(spark, range(1000)), "x", [0.25, 0.5]).collect()
    for row in rows:
        assert row.value == int(row.value)
        assert abs(row.value - 1000 * row.fraction) <= 2


def test_flag_is_strict_and_missing_is_good(spark):
    values = [*range(1, 201), None, float("nan")]
    flagged = quantiles.flag_above_quantile(frame(spark, values), "x", 0.99)
    above = [r.x for r in flagged.where("outlier_check = 'Outlier'").collect()]
    assert sorted(above) == [v for v in range(1, 201) if v > np.quantile(np.arange(1, 201), 0.99)]
    assert flagged.where("outlier_check = 'Good'").count() == len(values) - len(above)


def test_threshold_shared_by_many_rows(spark):
    flagged = quantiles.flag_above_quantile(frame(spark, [1.0] * 50 + [2.0] * 50), "x", 0.99)
    assert flagged.where("outlier_check = 'Outlier'").count() == 0


def test_top_flagged(spark):
    df = spark.createDataFrame(
        [(1, "Outlier", 5), (2, "Good", 9), (3, "Outlier", 7), (4, "Outlier", 7)],
        "id long, f string, n long",
    )
    top = quantiles.top_flagged(df, "f", "Outlier", "n", 2, "id")
    assert [r.id for r in top.collect()] == [3, 4]


@pytest.mark.parametrize("partitions", ["1", "8", "500"])
def test_number_of_partitions_does_not_matter(spark, partitions):
    values = np.random.default_rng(5).integers(0, 3_000, 5_000).astype(float)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = quantiles.percentile_table(frame(spark, values), "x").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r.value for r in rows] == list(np.percentile(values, PERCENTS))


def test_totals_are_bounded(spark):
    """However many distinct values: 65,536 totals, then 4,096 for each wanted cell."""
    numbers = quantiles.order_numbers(spark.range(300_000).select(F.rand(3).alias("x")), F.col("x"))
    first = quantiles._totals(numbers, None, 64, 48)
    assert first[:, 1].sum() == 300_000 and len(first) <= 65_536
    cell = int(first[first[:, 1].argmax()][0])
    below = quantiles._totals(numbers, [cell], 48, 36)
    assert below[:, 1].sum() == first[:, 1].max() and 1_000 < len(below) <= 4_096


def odd_doubles():
    powers = np.ldexp(1.0, np.arange(-1074, 1024))
    near = [np.nextafter(powers, 0), powers, np.nextafter(powers, np.inf)]
    bits = np.random.default_rng(6).integers(0, 2**63 - 1, 3_000, dtype=np.int64).view(float)
    sizes = np.concatenate([*near, bits[~np.isnan(bits)], [np.inf, np.finfo(float).max, 0.0]])
    return np.concatenate([sizes, -sizes])


def test_order_numbers(spark):
    """The bits of a double, in order, and back."""
    values = odd_doubles()
    df = spark.createDataFrame([(float(v),) for v in [*values, float("nan")]], "x double")
    rows = [r.number for r in quantiles.order_numbers(df, F.col("x")).collect()]
    assert rows.pop() is None
    for number, value in zip(rows, values, strict=True):
        size = int(np.abs(value).view(np.int64))
        assert number == (-size if value < 0 else size)
        assert quantiles._value_of(number) == value


def test_infinite_values(spark):
    values = [float("-inf"), -1.0, 0.0, 2.0, float("inf")]
    rows = quantiles.exact_quantiles(frame(spark, values), "x", [0.0, 0.25, 0.5, 1.0]).collect()
    assert [r.value for r in rows] == [float("-inf"), -1.0, 0.0, float("inf")]


@pytest.mark.parametrize(
    "setting",
    ["spark.sql.adaptive.enabled", "spark.sql.exchange.reuse", "spark.sql.execution.reuseSubquery"],
)
def test_without_shared_stages(spark, setting):
    values = np.random.default_rng(4).random(5000)
    before = spark.conf.get(setting, "true")
    spark.conf.set(setting, "false")
    try:
        rows = quantiles.percentile_table(frame(spark, values), "x").collect()
    finally:
        spark.conf.set(setting, before)
    assert [r.value for r in rows] == list(np.percentile(values, PERCENTS))

"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyfield.operators import quantiles
from tallyfield.plans import registered, registered_sql

SF = "/root/testdata/sf0.001"


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def final_part(plan):
    """Without the plans as they were before they ran."""
    kept, hidden = [], None
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if hidden is not None and depth >= hidden:
            continue
        hidden = depth if "Initial Plan" in line else None
        if hidden is None:
            kept.append(line)
    return "\n".join(kept)


def scans(plan):
    return final_part(plan).count("FileScan")


@pytest.mark.parametrize("name", list(registered.QUERIES))
def test_no_python_no_product_no_whole_table_window(spark, name):
    plan = registered.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert node not in plan
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
    for window in re.findall(r"Window \[(.*?)\n", plan):
        # Running totals over the byte ranges of CSV files, and lines within one range, are the only ones.
        assert "windowspecdefinition(file" in window


def test_one_scan_for_leaders(spark):
    assert scans(executed(registered.q4(spark, SF))) == 1


def test_outliers_are_flagged_in_one_scan(spark):
    """The threshold is found before, in rounds; the plan holds only its one row."""
    plan = executed(registered.q18b(spark, SF))
    assert scans(plan) == 1 and "Exchange hashpartitioning(o_" not in plan


def test_no_table_is_shuffled_for_quantiles(spark):
    """What a round shuffles are counts combined in each task."""
    numbers = quantiles.order_numbers(spark.read.parquet(f"{SF}/orders.parquet"), F.col("o_totalprice"))
    plan = final_part(executed(numbers.groupBy(F.shiftright("number", 48).alias("cell")).count()))
    assert scans(plan) == 1 and plan.count("Exchange") == 1 and "partial_count" in plan
    assert "LOG2" in plan and plan.count("LOG2") == 1  # every number is made once


def test_inserts_are_never_sorted_by_aggregation(spark):
    plan = registered.insert_or_ignore(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_columns_are_pruned_and_null_tests_reach_the_scan(spark):
    plan = executed(registered.QUERIES["q6b"](spark, SF))
    assert "ReadSchema: struct<c_nationkey:int,c_mktsegment:string>" in plan
    assert "IsNotNull(c_nationkey), IsNotNull(c_mktsegment)" in plan


def test_filters_reach_the_scan(spark):
    assert "EqualTo(o_orderstatus,F)" in executed(registered.q5(spark, SF))


@pytest.mark.parametrize("name", ["listings_q17b", "listings_q17c", "listings_q17c_intended"])
def test_countries_are_looked_up_after_counting(spark, name):
    plan = final_part(executed(registered.QUERIES[name](spark, SF)))
    scan_stage = plan[plan.rindex("Exchange hashpartitioning(host_location") :]
    assert "regexp_extract_all" not in scan_stage


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["o_custkey", "n"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(registered.QUERIES) == set(registered_sql.SQL)
    assert registered.QUERIES.keys() <= __spark_entry__.queries().keys()


def test_schema_table_scans_the_table(spark):
    plan = executed(registered.schema_table(spark, SF))
    assert scans(plan) == 1
    assert "ExistingRDD" not in plan

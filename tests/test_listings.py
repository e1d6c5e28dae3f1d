"""Every listings question on a small table with answers worked out by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyfield.plans import listings as q
from tallyfield.schema import LISTINGS

SCHEMA = StructType([StructField("listing_id", LongType()), *LISTINGS.fields])
COLUMNS = [
    "host_id", "host_name", "host_since", "host_location", "host_is_superhost",
    "host_verifications", "host_identity_verified", "neighbourhood_cleansed",
    "neighbourhood_group_cleansed", "property_type", "amenities", "price", "number_of_reviews",
    "reviews_per_month", "instant_bookable", "license", "estimated_occupancy_l365d",
]
A, B, C = date(2015, 4, 1), date(2016, 1, 1), date(2017, 1, 1)
ROWS = [
    (1, "Ana", A, "Madrid, Spain", "t", "['email']", "f", "N1", "D1", "Flat", '["a"]', "$1.00",
     0, 1.0, "f", "ESFC1", 10.0),
    (1, "Ana", A, "Madrid, Spain", "t", "['email']", "f", "N1", "D1", "Flat", '["a","b"]', "$2.00",
     5, 3.0, "t", "x ESFC", 20.0),
    (2, "Bo", B, "Gary, Indiana", "f", "['phone']", "t", "N2", "D1", "Room", "[]", "$3.00",
     0, None, "t", "Exempt", None),
    (2, "Bo", B, "Gary, Indiana", None, "['work_email']", "t", "N3", "D2", "Room", None, "$3.50",
     1, 2.0, None, "En proceso", 30.0),
    (3, None, None, None, "t", None, "t", "N3", "D2", "Room", '["a","b","c"]', None,
     2, 1.0, "f", None, 40.0),
    (4, "Di", C, "Paris", "f", "['phone', 'email']", None, None, None, "Room", "broken", "$9,000.00",
     9, 2.0, "f", None, float("nan")),
]


@pytest.fixture(scope="module")
def df(spark):
    assert LISTINGS.fieldNames() == COLUMNS
    return spark.createDataFrame([(i + 1, *row) for i, row in enumerate(ROWS)], SCHEMA).cache()


ANSWERS = {
    q.q1_rows: [(6,)],
    q.q2_columns: [(18,)],
    q.q3_hosts: [(4,)],
    q.q4_listings_per_host: [(1, "Ana", 2), (2, "Bo", 2), (4, "Di", 1)],
    q.q4_largest_host: [(1, "Ana", 2), (2, "Bo", 2)],
    q.q5_superhosts: [(2,)],
    q.q6_listings_per_district: [("D1", 3), ("D2", 2)],
    q.q6_largest_district: [("D1", 3)],
    q.q6b_neighbourhoods: [("D1", "N1", 2), ("D1", "N2", 1), ("D2", "N3", 2)],
    q.q7_mean_price: [(1802.0,)],
    q.q8_without_reviews: [(2,)],
    q.q9_instant_bookable: [(125.0,)],
    q.q10_without_license: [(2,)],
    q.q11_esfc: [(2, 1)],
    q.q12_declared: [(1, 1)],
    q.q13a_verifications: [
        ("['email']", 2), ("['phone', 'email']", 1), ("['phone']", 1), ("['work_email']", 1),
    ],
    q.q13b_email_by_identity: [("f", 2), ("t", 1)],
    q.q13b_printed: [(2,)],
    q.q13_intended: [(2,)],
    q.q14_max_amenities: [(3, 1)],
    q.q15_record_year: [("2015", 2), ("2016", 2)],
    q.q15_intended: [("2015", 1), ("2016", 1), ("2017", 1)],
    q.q16a_license_categories: [
        ("Missing", 2), ("Other", 2), ("Long ES codes", 1), ("Verbal descriptions", 1),
    ],
    q.q16b_licenses_by_category: [
        ("Long ES codes", "ESFC1", 1), ("Other", "En proceso", 1), ("Other", "x ESFC", 1),
        ("Verbal descriptions", "Exempt", 1),
    ],
    q.q17a_locations: [("Gary, Indiana", 2), ("Madrid, Spain", 2), ("Paris", 1)],
    q.q17b_locations_by_country: [
        ("INDIA", "Gary, Indiana", 2), ("OTHERS", "Paris", 1), ("SPAIN", "Madrid, Spain", 2),
    ],
    q.q17c_countries: [("INDIA", 2), ("SPAIN", 2), ("OTHERS", 1)],
    q.q18b_outlier_profile: [
        ("Good", 2.375, 4, 1.6, 1.5, 25.0), ("Outlier", 9000.0, 1, 9.0, None, None),
    ],
    q.q18c_outliers_by_type: [("Good", "Flat", 2), ("Good", "Room", 3), ("Outlier", "Room", 1)],
    q.q18d_outliers_by_district: [("Good", "D1", 3), ("Good", "D2", 2)],
}


@pytest.mark.parametrize("question", list(ANSWERS), ids=lambda f: f.__name__)
def test_answer(df, question):
    assert [tuple(row) for row in question(df).collect()] == ANSWERS[question]


def test_country_replaces_a_column_of_its_name(df):
    told = q.with_country(q.enriched(df))
    assert told.columns.count("clean_country") == 1
    by_location = {r.host_location: r.clean_country for r in told.collect()}
    assert by_location == {
        "Madrid, Spain": "SPAIN", "Gary, Indiana": "INDIA", None: None, "Paris": "OTHERS",
    }


def test_stored_enriched_table_gives_the_same_reports(df, tmp_path):
    stored = q.store_enriched(df, str(tmp_path / "enriched"))
    assert q.enriched(stored).columns == stored.columns
    for report in (q.q16a_license_categories, q.q18b_outlier_profile, q.q18d_outliers_by_district):
        assert report(stored).collect() == report(df).collect()


def test_countries_other_than_spain(df):
    rows = q.q17c_countries(df, match="longest_word", leave_out="SPAIN").collect()
    assert [tuple(r) for r in rows] == [("UNITED STATES", 2), ("OTHERS", 1)]


def test_percentiles(df):
    prices = {r.percentile: r.price for r in q.q18a_percentiles(df).collect()}
    assert (prices[25], prices[50], prices[100]) == (2.0, 3.0, 9000.0)


def test_most_reviewed_outliers(df):
    rows = q.q18e_most_reviewed(df, k=5).collect()
    assert [(r.listing_id, r.cleaned_price) for r in rows] == [(6, 9000.0)]


def test_only_verified_hosts(df):
    assert q.q13b_printed(df.where("host_identity_verified = 't'")).first().n is None
    assert q.q9_instant_bookable(df.where("instant_bookable = 't'")).first().pct_higher is None


def test_orders_of_reports(spark):
    """Reports come in the order they promise: by count, then by key; or by key."""
    from tallyfield.plans import registered

    sf = "/root/testdata/sf0.001"
    by_count = {"listings_q4_counts": -1, "listings_q6_counts": -1, "listings_q15": -1, "listings_q17c": -1, "value_counts": -1}
    for name in by_count:
        df = registered.QUERIES[name](spark, sf)
        rows = [tuple(r) for r in df.collect()]
        number = df.columns.index("n") if "n" in df.columns else len(df.columns) - 1
        counts = [r[number] for r in rows]
        assert counts == sorted(counts, reverse=True), name
        for n in set(counts):
            keys = [r[:number] + r[number + 1 :] for r in rows if r[number] == n]
            assert keys == sorted(keys), name
    for name in ("listings_q6b", "listings_q16b", "listings_q18b", "listings_q18c", "listings_q18d"):
        df = registered.QUERIES[name](spark, sf)
        rows = [tuple(r) for r in df.collect()]
        keys = 1 if name == "listings_q18b" else len(df.columns) - 1
        assert [r[:keys] for r in rows] == sorted(r[:keys] for r in rows), name


def test_derived_columns_are_told_by_their_mark(spark, tmp_path):
    """A stored table is known again, however it is read; a column that only bears the name is not."""
    from tallyfield.plans.shaped import listings as shaped

    df = shaped(spark, "/root/testdata/sf0.001")
    stored = q.store_enriched(df, str(tmp_path / "stored"))
    for table in (stored, spark.read.parquet(str(tmp_path / "stored")), q.with_country(df)):
        assert q.enriched(table).columns == [*table.columns, *[c for c in stored.columns if c not in table.columns]]
    with pytest.raises(ValueError, match="license_category"):
        q.enriched(df.withColumn("license_category", F.lit("raw")))

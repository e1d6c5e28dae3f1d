"""Declared column types of the two data sets."""

from pyspark.sql.types import (
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# Only columns that some report reads; a listings file may hold any number of others.
LISTINGS = StructType(
    [
        StructField("host_id", LongType()),
        StructField("host_name", StringType()),
        StructField("host_since", DateType()),
        StructField("host_location", StringType()),
        StructField("host_is_superhost", StringType()),
        StructField("host_verifications", StringType()),
        StructField("host_identity_verified", StringType()),
        StructField("neighbourhood_cleansed", StringType()),
        StructField("neighbourhood_group_cleansed", StringType()),
        StructField("property_type", StringType()),
        StructField("amenities", StringType()),
        StructField("price", StringType()),
        StructField("number_of_reviews", LongType()),
        StructField("reviews_per_month", DoubleType()),
        StructField("instant_bookable", StringType()),
        StructField("license", StringType()),
        StructField("estimated_occupancy_l365d", DoubleType()),
    ]
)

BOOKS = StructType(
    [
        StructField("id", LongType()),
        StructField("title", StringType()),
        StructField("author", StringType()),
        StructField("year", LongType()),
    ]
)

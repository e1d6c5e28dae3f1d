"""Driver tables in the form that the reports expect.

The listings data itself is not at hand, so ``orders`` is given the listings columns, row by row
and without a join: an order is a listing, its customer the host. ``part`` becomes the book
catalogue. ``LISTINGS_SQL`` and ``BOOKS_SQL`` say the same in SQL for the check against DuckDB.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Where hosts say they live. Names that need the list order, states, state codes,
# trailing white space, no country, nothing.
PLACES = [
    "Madrid, Spain", "Paris, France", "Bucharest, Romania", "Lagos, Nigeria",
    "Mogadishu, Somalia", "Gary, Indiana", "Albuquerque, New Mexico", "Atlanta, Georgia",
    "Denver, Colorado", "Austin, TX", "Austin, TX\t", "Berlin, DE", "Calle Mayor", "madrid",
    "Port Moresby, Papua New Guinea", "Abidjan, Côte d'Ivoire", "London, United Kingdom",
    "Santo Domingo, Dominican Republic", "Sevilla, SPAIN", None,
]


# Texts that are no list, by the last two digits of the order key.
NO_LISTS = {7: '["a"] x]', 34: '["a"]]', 67: '["a"],["b"]', 99: "none"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_custkey").cast("string")
    status, priority, date = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderdate")

    def with_key(before: str, after: str = "") -> Column:
        return F.concat(F.lit(before), key, F.lit(after))

    licenses = [
        F.lit(None), with_key("ESFCTU"), with_key("es"), with_key("VT-"), with_key("vt"),
        with_key("AM-"), F.lit("amparo"), with_key("HM"), with_key("", "/2020"),
        with_key("en tramite/"), key, F.lit("Exempt"), F.lit("ñandú"), F.lit("En proceso"),
        with_key("Es"), with_key("x ESFC"),
    ]
    slot = F.col("o_custkey") % len(licenses)
    license = reduce(
        lambda chain, i: chain.when(slot == i, licenses[i]),
        range(2, len(licenses)),
        F.when(slot == 1, licenses[1]),
    )
    place = F.get(F.array(*[F.lit(p) for p in PLACES]), (F.col("o_custkey") % 20).cast("int"))
    area = F.concat(F.lit("Area "), (F.col("o_custkey") % 7).cast("string"), F.lit(", "))
    digits = F.regexp_replace(F.col("o_orderkey").cast("string"), "(?<=.)(?=.)", '", "')
    last_two = F.col("o_orderkey") % 100
    broken = reduce(
        lambda chain, k: chain.when(last_two == k, NO_LISTS[k]), list(NO_LISTS)[1:],
        F.when(last_two == 7, NO_LISTS[7]),
    )
    reviews = F.day(date).cast("bigint") - 1
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("listing_id"),
        F.col("o_custkey").alias("host_id"),
        F.when(priority != "4-NOT SPECIFIED", with_key("Host ")).alias("host_name"),
        F.when((status != "P") | (priority != "5-LOW"), date.cast("date")).alias("host_since"),
        F.concat(area, place).alias("host_location"),
        F.when(status == "F", "t").when(status == "O", "f").alias("host_is_superhost"),
        F.when(priority == "1-URGENT", "['email', 'phone']")
        .when(priority == "2-HIGH", "['phone', 'work_email']")
        .when(priority == "3-MEDIUM", "['phone']")
        .when(priority == "5-LOW", "[]")
        .alias("host_verifications"),
        F.when(F.col("o_totalprice") >= 400000, "t")
        .when(F.col("o_totalprice") >= 100000, "f")
        .alias("host_identity_verified"),
        F.concat(
            F.lit("Q"), F.quarter(date).cast("string"), F.lit(" "), F.year(date).cast("string")
        ).alias("neighbourhood_cleansed"),
        F.nullif(F.substring(priority, 3, 20), F.lit("NOT SPECIFIED")).alias(
            "neighbourhood_group_cleansed"
        ),
        F.when(status == "F", "Entire home")
        .when(status == "O", "Private room")
        .otherwise("Hotel room")
        .alias("property_type"),
        F.coalesce(broken, F.concat(F.lit('["'), digits, F.lit('"]'))).alias("amenities"),
        F.when(
            (status != "P") | (priority != "1-URGENT"),
            F.concat(F.lit("$"), F.format_number("o_totalprice", 2)),
        ).alias("price"),
        reviews.alias("number_of_reviews"),
        F.when(reviews > 0, F.month(date) * 0.25).alias("reviews_per_month"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "t").otherwise("f").alias("instant_bookable"),
        license.alias("license"),
        F.dayofyear(date).cast("double").alias("estimated_occupancy_l365d"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as books; the smallest have no author."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_size") > 5, F.col("p_brand")).alias("author"),
        (F.col("p_size") + 1950).cast("bigint").alias("year"),
    )


def _sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


LISTINGS_SQL = f"""
listings AS (
  SELECT o_orderkey AS listing_id, o_custkey AS host_id,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 'Host ' || o_custkey END AS host_name,
    CASE WHEN o_orderstatus <> 'P' OR o_orderpriority <> '5-LOW'
         THEN CAST(o_orderdate AS DATE) END AS host_since,
    'Area ' || (o_custkey % 7) || ', ' ||
      ([{", ".join(_sql_text(p) for p in PLACES)}])[CAST(o_custkey % 20 AS INTEGER) + 1]
      AS host_location,
    CASE o_orderstatus WHEN 'F' THEN 't' WHEN 'O' THEN 'f' END AS host_is_superhost,
    CASE o_orderpriority WHEN '1-URGENT' THEN '[''email'', ''phone'']'
      WHEN '2-HIGH' THEN '[''phone'', ''work_email'']' WHEN '3-MEDIUM' THEN '[''phone'']'
      WHEN '5-LOW' THEN '[]' END AS host_verifications,
    CASE WHEN o_totalprice >= 400000 THEN 't' WHEN o_totalprice >= 100000 THEN 'f' END
      AS host_identity_verified,
    'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS neighbourhood,
    nullif(substr(o_orderpriority, 3), 'NOT SPECIFIED') AS district,
    CASE o_orderstatus WHEN 'F' THEN 'Entire home' WHEN 'O' THEN 'Private room'
      ELSE 'Hotel room' END AS property_type,
    CASE WHEN o_orderkey % 100 NOT IN ({", ".join(map(str, NO_LISTS))})
         THEN length(CAST(o_orderkey AS VARCHAR)) END AS amenities_count,
    CASE WHEN o_orderstatus <> 'P' OR o_orderpriority <> '1-URGENT' THEN o_totalprice END AS price,
    day(o_orderdate) - 1 AS number_of_reviews,
    CASE WHEN day(o_orderdate) > 1 THEN month(o_orderdate) * 0.25::DOUBLE END AS reviews_per_month,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 't' ELSE 'f' END AS instant_bookable,
    ([NULL, 'ESFCTU' || o_custkey, 'es' || o_custkey, 'VT-' || o_custkey, 'vt' || o_custkey,
      'AM-' || o_custkey, 'amparo', 'HM' || o_custkey, o_custkey || '/2020',
      'en tramite/' || o_custkey, CAST(o_custkey AS VARCHAR), 'Exempt', 'ñandú', 'En proceso',
      'Es' || o_custkey, 'x ESFC' || o_custkey])[CAST(o_custkey % 16 AS INTEGER) + 1] AS license,
    CAST(dayofyear(o_orderdate) AS DOUBLE) AS occupancy
  FROM orders)
"""

BOOKS_SQL = """
books AS (
  SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size > 5 THEN p_brand END AS author,
    CAST(p_size + 1950 AS BIGINT) AS "year"
  FROM part)
"""

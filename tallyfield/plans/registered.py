"""The registered queries: every operator on driver tables, and every report on shaped ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyfield.functions.classify import first_rule, lookup_in_order
from tallyfield.functions.numbers import money_lenient, money_strict
from tallyfield.functions.text import (
    contains_any,
    digits_only,
    first_match,
    first_part,
    letters_only,
    list_length,
    starts_with_any,
    strip_end,
)
from tallyfield.operators import groups, insert, inspect, quantiles
from tallyfield.plans import books as book_plans
from tallyfield.plans import listings as reports
from tallyfield.plans import shaped
from tallyfield.plans.shaped import table
from tallyfield.session import scratch_path
from tallyfield.sources import csv_files, json_files, tables

Query = Callable[[SparkSession, str], DataFrame]

DOCUMENTS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)


def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.row_count(table(spark, sf_dir, "lineitem"), "n")


def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.shape(table(spark, sf_dir, "orders"))


def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.distinct_count(table(spark, sf_dir, "orders"), "o_custkey", "n")


def q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.top_groups(table(spark, sf_dir, "orders"), ["o_custkey"])


def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    return groups.distinct_count(finished, "o_custkey", "n")


def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.top_groups(table(spark, sf_dir, "supplier"), ["s_nationkey"])


def q6b(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["c_nationkey", "c_mktsegment"]
    return groups.group_size(table(spark, sf_dir, "customer"), keys).orderBy(*keys)


def q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    return groups.rounded_mean(table(spark, sf_dir, "orders"), money_lenient(price), "m")


def q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.row_count(table(spark, sf_dir, "labels").where(F.col("toxic") == 0), "n")


def q9(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return groups.percent_higher(lines, "l_linestatus", "l_quantity", "pct", high="O", low="F")


def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a quality label, as a left join would count them.

    Both sides are counted per document before the join, so a repeated document is one row in it.
    """
    documents = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count("*").alias("n"))
    unlabelled = (
        table(spark, sf_dir, "labels")
        .groupBy("doc_id")
        .agg(F.count_if(F.col("quality").isNull()).alias("m"))
    )
    return documents.join(unlabelled, "doc_id", "left").agg(
        F.sum(F.col("n") * F.coalesce("m", F.lit(1))).alias("n")
    )


def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return groups.count_where(
        table(spark, sf_dir, "part"), a=name.contains("ring"), b=name.startswith("red")
    )


def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return groups.count_where(
        table(spark, sf_dir, "documents"),
        n_apache=text.contains("Apache License"),
        n_mit=text.contains("MIT License"),
    )


def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents that hold an address, by quality; counted per document before joining."""
    reachable = (
        table(spark, sf_dir, "documents")
        .where(contains_any(F.col("text"), ["@", "http", "https"]))
        .groupBy("doc_id")
        .agg(F.count("*").alias("n"))
    )
    labels = (
        groups.with_keys(table(spark, sf_dir, "labels"), ["quality"])
        .groupBy("doc_id", "quality")
        .agg(F.count("*").alias("m"))
    )
    return (
        reachable.join(labels, "doc_id")
        .groupBy("quality")
        .agg(F.sum(F.col("n") * F.col("m")).alias("n"))
        .orderBy("quality")
    )


def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_join(F.split("p_name", " "), '", "')
    length = list_length(F.concat(F.lit('["'), words, F.lit('"]')))
    return table(spark, sf_dir, "part").agg(F.max(length).cast("bigint").alias("m"))


def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = first_part(F.col("o_orderdate").cast("date").cast("string"), "-").alias("y")
    return (
        table(spark, sf_dir, "orders")
        .select(year, "o_custkey")
        .groupBy("y")
        .agg(F.count_distinct("o_custkey").alias("n"))
        .orderBy("y")
    )


def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = first_part(F.col("text"), " ")
    kind = first_rule(
        [
            (token.isNull(), "Missing"),
            (starts_with_any(token, ["An", "an"]), "an"),
            (token.contains("/"), "slash"),
            (digits_only(token), "digits"),
            (letters_only(token), "alpha"),
        ],
        default="Other",
    )
    return groups.value_counts(table(spark, sf_dir, "documents").select(kind.alias("c")), "c")


def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are looked up once each, after counting."""
    counts = groups.group_size(table(spark, sf_dir, "part"), ["p_name"])
    found = lookup_in_order(F.upper("p_name"), [(["RED", "RING", "BLUE", "GREEN"], None)])
    return (
        counts.groupBy(F.coalesce(found, F.lit("OTHERS")).alias("c"))
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "c")
    )


def q18a(spark: SparkSession, sf_dir: str) -> DataFrame:
    percentiles = quantiles.percentile_table(table(spark, sf_dir, "orders"), "o_totalprice", "v")
    return percentiles.select(F.col("percentile").alias("p"), F.round("v", 6).alias("v"))


def q18a_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few distinct values, each shared by many rows."""
    lines = table(spark, sf_dir, "lineitem")
    return quantiles.percentile_table(lines, "l_quantity").select(
        F.col("percentile").alias("p"), F.round("value", 6).alias("v")
    )


def _flagged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return quantiles.flag_above_quantile(orders, "o_totalprice", 0.99, name="f")


def q18b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.profile(
        _flagged_orders(spark, sf_dir),
        "f",
        m=F.round(F.avg("o_totalprice"), 4),
        n=F.count("o_totalprice"),
    ).orderBy("f")


def q18c(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["f", "o_orderpriority"]
    return groups.group_size(_flagged_orders(spark, sf_dir), keys).orderBy(*keys)


def q18d(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["f", "o_orderstatus"]
    return groups.group_size(_flagged_orders(spark, sf_dir), keys).orderBy(*keys)


def q18e(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = _flagged_orders(spark, sf_dir).select("f", "o_orderkey", "o_totalprice")
    top = quantiles.top_flagged(flagged, "f", "Outlier", "o_totalprice", 10, "o_orderkey")
    return top.drop("f")


def schema_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.schema_table(table(spark, sf_dir, "lineitem"))


def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["o_orderkey", "o_custkey", "o_orderpriority"]
    return inspect.first_rows(table(spark, sf_dir, "orders").select(columns), 5, "o_orderkey")


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.value_counts(table(spark, sf_dir, "events"), "event_type")


def mean_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = groups.mean_per_group(table(spark, sf_dir, "events"), "event_type", "value", "m")
    return means.select("event_type", F.round("m", 6).alias("m")).orderBy("event_type")


def money_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances written as money, read back strictly."""
    written = F.concat(F.lit("$"), F.format_number("c_acctbal", 2))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", money_strict(written).alias("amount")
    )


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts without trailing white space, by length and hash."""
    text = strip_end(F.concat("text", F.lit(" \t \n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("hash"))


def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, plus customers that ordered, by first order; keys in use are skipped."""
    stored = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")
    )
    batch = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderkey").alias("seq"),
    )
    return insert.insert_or_ignore(stored, batch, "id", "seq")


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return json_files.json_rows(events, name="j")


def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return json_files.json_array_lines(customers, "c_custkey")


def json_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def first_match_in_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = first_match(F.col("url"), r"https?://[-a-z0-9]+\.example\.com", "none")
    return table(spark, sf_dir, "pages").select("page_id", host.alias("h"))


def csv_scan(spark: SparkSession, sf_dir: str, split_files: bool = False) -> DataFrame:
    """Documents written as CSV (quotes, commas and line breaks in the text) and read back."""
    path = scratch_path(spark, "documents-csv")
    table(spark, sf_dir, "documents").write.csv(
        path,
        header=True,
        quoteAll=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    back = csv_files.read_csv(spark, path, DOCUMENTS, split_files=split_files)
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("hash"))


def csv_scan_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, each file read by as many tasks as it has byte ranges."""
    return csv_scan(spark, sf_dir, split_files=True)


def csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV, with long ids and truth values, and read back without types."""
    path = scratch_path(spark, "orders-csv")
    table(spark, sf_dir, "orders").select(
        F.concat(F.lit("1003253567"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("id"),
        F.when(F.col("o_orderstatus") == "F", "True").otherwise("False").alias("finished"),
        F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"),
    ).write.csv(path, header=True)
    return csv_files.read_csv(spark, path)


def csv_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV without line breaks in fields, converted to Parquet."""
    path = scratch_path(spark, "customer-csv")
    columns = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    customers = table(spark, sf_dir, "customer").select(columns)
    customers.write.csv(path, header=True)
    out = scratch_path(spark, "customer-parquet")
    return csv_files.csv_to_parquet(spark, path, out, customers.schema, line_breaks_in_fields=False)


def books_b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table filled twice with the same books, each offered twice; the first offer stays."""
    location = scratch_path(spark, "books")
    name = "books_" + location.rsplit("-", 1)[1]
    book_plans.create_books(spark, name, location)
    offered = shaped.books(spark, sf_dir).withColumn("seq", F.col("id"))
    again = offered.withColumns({"title": F.upper("title"), "seq": F.col("seq") + 1})
    batch = offered.unionByName(again)
    book_plans.add_books(spark, batch, name)
    return book_plans.add_books(spark, batch, name)


def books_b1_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in a table stored by key."""
    location = scratch_path(spark, "books-by-key")
    name = "books_" + location.rsplit("-", 1)[1]
    batch = shaped.books(spark, sf_dir).withColumn("seq", F.lit(0))
    tables.create_if_absent(
        spark, name, batch.drop("seq").schema, location, key="id", buckets=8
    )
    book_plans.add_books(spark, batch, name)
    return book_plans.add_books(spark, batch, name)


def books_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table seeded twice, then offered all parts: the seed books keep their ids."""
    location = scratch_path(spark, "books-seeded")
    name = "books_" + location.rsplit("-", 1)[1]
    book_plans.seed_books(spark, name, location)
    book_plans.seed_books(spark, name, location)
    batch = shaped.books(spark, sf_dir).withColumn("seq", F.lit(0))
    return book_plans.add_books(spark, batch, name)


def books_b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_plans.books_json(shaped.books(spark, sf_dir))


def books_b2_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_files.json_array_lines(shaped.books(spark, sf_dir), "id")


def books_b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books written as JSON and read back."""
    path = scratch_path(spark, "books-json")
    json_files.write_json(shaped.books(spark, sf_dir), path)
    return json_files.read_json(spark, path, book_plans.BOOKS, one_per_line=True)


def books_b3_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books landed as files of one JSON array each (up to 500 books) and read back."""
    path = scratch_path(spark, "books-arrays")
    books = shaped.books(spark, sf_dir)
    arrays = books.groupBy(F.floor(F.col("id") / 500).alias("file")).agg(
        F.to_json(F.collect_list(F.struct(*books.columns)), {"ignoreNullFields": "false"}).alias("body")
    )
    arrays.select("body").write.option("maxRecordsPerFile", 1).text(path)
    return book_plans.books_from_json(spark, path)


def books_b3_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books from responses held as text, one array each."""
    response = F.concat(F.lit("["), "json", F.lit("]")).alias("body")
    bodies = book_plans.books_json(shaped.books(spark, sf_dir), indented=True).select(response)
    return json_files.records_of(bodies, "body", book_plans.BOOKS)


def books_b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first web address in each document, with the default where there is none."""
    found = book_plans.address_in(
        table(spark, sf_dir, "documents").select("doc_id", "text"), "text", r"https?://[-a-z0-9.]+"
    )
    return found.select("doc_id", "url")


def _on_listings(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(shaped.listings(spark, sf_dir))


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _outlier_profile(df: DataFrame) -> DataFrame:
    means = ["mean_price", "mean_reviews", "mean_amenities", "mean_occupancy"]
    return _rounded(reports.q18b_outlier_profile(df), 4, *means)


def _most_reviewed(df: DataFrame) -> DataFrame:
    columns = ["listing_id", "cleaned_price", "number_of_reviews", "amenities_count"]
    top = reports.q18e_most_reviewed(df).select(*columns)
    return top.withColumn("amenities_count", F.col("amenities_count").cast("bigint"))


def _countries(df: DataFrame) -> DataFrame:
    return reports.with_country(df).select("listing_id", "clean_country")


def _outlier_profile_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outlier profile over the enriched table, stored once."""
    path = scratch_path(spark, "enriched")
    return _outlier_profile(reports.store_enriched(shaped.listings(spark, sf_dir), path))


QUERIES: dict[str, Query] = {
    "q1": q1,
    "q2": q2,
    "q3": q3,
    "q4": q4,
    "q5": q5,
    "q6": q6,
    "q6b": q6b,
    "q7": q7,
    "q8": q8,
    "q9": q9,
    "q10": q10,
    "q11": q11,
    "q12": q12,
    "q13": q13,
    "q14": q14,
    "q15": q15,
    "q16": q16,
    "q17": q17,
    "q18a": q18a,
    "q18a_lineitem": q18a_lineitem,
    "q18b": q18b,
    "q18c": q18c,
    "q18d": q18d,
    "q18e": q18e,
    "schema_table": schema_table,
    "head": head,
    "value_counts": value_counts,
    "mean_per_group": mean_per_group,
    "money_text": money_text,
    "clean_text": clean_text,
    "insert_or_ignore": insert_or_ignore,
    "json_rows": json_rows,
    "json_array": json_array,
    "json_in": json_in,
    "first_match": first_match_in_url,
    "csv_scan": csv_scan,
    "csv_scan_split": csv_scan_split,
    "csv_inferred": csv_inferred,
    "csv_parquet": csv_parquet,
    "books_b1": books_b1,
    "books_b1_bucketed": books_b1_bucketed,
    "books_seeded": books_seeded,
    "books_b2": books_b2,
    "books_b2_array": books_b2_array,
    "books_b3": books_b3,
    "books_b3_array": books_b3_array,
    "books_b3_responses": books_b3_responses,
    "books_b4": books_b4,
    "listings_q1": _on_listings(reports.q1_rows),
    "listings_q2": _on_listings(reports.q2_columns),
    "listings_q3": _on_listings(reports.q3_hosts),
    "listings_q4_counts": _on_listings(reports.q4_listings_per_host),
    "listings_q4": _on_listings(reports.q4_largest_host),
    "listings_q5": _on_listings(reports.q5_superhosts),
    "listings_q6_counts": _on_listings(reports.q6_listings_per_district),
    "listings_q6": _on_listings(reports.q6_largest_district),
    "listings_q6b": _on_listings(reports.q6b_neighbourhoods),
    "listings_q7": _on_listings(reports.q7_mean_price),
    "listings_q8": _on_listings(reports.q8_without_reviews),
    "listings_q9": _on_listings(lambda df: _rounded(reports.q9_instant_bookable(df), 4, "pct_higher")),
    "listings_q10": _on_listings(reports.q10_without_license),
    "listings_q11": _on_listings(reports.q11_esfc),
    "listings_q12": _on_listings(reports.q12_declared),
    "listings_q13a": _on_listings(reports.q13a_verifications),
    "listings_q13b": _on_listings(reports.q13b_email_by_identity),
    "listings_q13b_printed": _on_listings(reports.q13b_printed),
    "listings_q13_intended": _on_listings(reports.q13_intended),
    "listings_q14": _on_listings(reports.q14_max_amenities),
    "listings_q15": _on_listings(reports.q15_record_year),
    "listings_q15_intended": _on_listings(reports.q15_intended),
    "listings_q16a": _on_listings(reports.q16a_license_categories),
    "listings_q16b": _on_listings(reports.q16b_licenses_by_category),
    "listings_q17a": _on_listings(reports.q17a_locations),
    "listings_q17b": _on_listings(reports.q17b_locations_by_country),
    "listings_q17c": _on_listings(reports.q17c_countries),
    "listings_q17c_intended": _on_listings(
        lambda df: reports.q17c_countries(df, match="longest_word", leave_out="SPAIN")
    ),
    "listings_country": _on_listings(_countries),
    "listings_country_by_row": _on_listings(lambda df: _countries(reports.enriched(df))),
    "listings_q18a": _on_listings(
        lambda df: _rounded(reports.q18a_percentiles(df), 6, "price")
    ),
    "listings_q18b": _on_listings(_outlier_profile),
    "listings_q18b_stored": _outlier_profile_stored,
    "listings_q18c": _on_listings(reports.q18c_outliers_by_type),
    "listings_q18d": _on_listings(reports.q18d_outliers_by_district),
    "listings_q18e": _on_listings(_most_reviewed),
}

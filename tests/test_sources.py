"""CSV and JSON files."""

import csv
import io
import json
import random
from collections import Counter
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql.types import LongType, StructField, StructType

from tallyfield.operators import inspect
from tallyfield.plans import books, listings
from tallyfield.schema import BOOKS, LISTINGS
from tallyfield.session import scratch_path, scratch_removed
from tallyfield.sources import csv_files, json_files, tables

ROW = {
    "id": "1",
    "host_id": "1001",
    "host_name": 'Ana "la jefa", S.L.',
    "host_since": "2015-04-01",
    "host_location": "Madrid,\nSpain",
    "host_is_superhost": "t",
    "host_verifications": "['email', 'phone']",
    "host_identity_verified": "f",
    "neighbourhood_cleansed": "N1",
    "neighbourhood_group_cleansed": "D1",
    "property_type": "Entire home",
    "amenities": '["Wifi", "55\\" TV"]',
    "price": "$1,234.00",
    "number_of_reviews": "0",
    "reviews_per_month": "",
    "instant_bookable": "t",
    "license": "N/A",
    "estimated_occupancy_l365d": "30",
    "notes, extra": " kept ",
}


def csv_text(rows):
    quoted = [['"' + v.replace('"', '""') + '"' for v in row] for row in [list(ROW), *rows]]
    return "\n".join(",".join(row) for row in quoted) + "\n"


@pytest.fixture
def listings_csv(tmp_path):
    path = tmp_path / "listings.csv"
    second = {**ROW, "id": "2", "host_id": "1002", "price": "nan", "reviews_per_month": "1.25"}
    path.write_text(csv_text([ROW.values(), second.values()]), encoding="utf8")
    return str(path)


def test_csv_fields_stay_in_place(spark, listings_csv):
    df = csv_files.read_csv(spark, listings_csv, LISTINGS)
    assert df.columns == list(ROW)
    row = df.where("host_id = 1001").first()
    assert row.host_name == 'Ana "la jefa", S.L.'
    assert row.host_since == date(2015, 4, 1)
    assert row.host_location == "Madrid,\nSpain"
    assert row.amenities == '["Wifi", "55\\" TV"]'
    assert (row.number_of_reviews, row.reviews_per_month) == (0, None)
    assert (row.license, row.estimated_occupancy_l365d) == (None, 30.0)
    assert row["notes, extra"] == " kept "


def test_reports_on_csv(spark, listings_csv):
    df = csv_files.read_csv(spark, listings_csv, LISTINGS)
    assert listings.q1_rows(df).first().n_rows == 2
    assert listings.q2_columns(df).first().n_cols == len(ROW)
    assert listings.q7_mean_price(df).first().mean_price == 1234.0
    assert listings.q14_max_amenities(df).first().max_amenities == 2
    assert listings.q17c_countries(df).first().clean_country == "SPAIN"


def test_csv_only_reads_used_columns(spark, listings_csv):
    df = csv_files.read_csv(spark, listings_csv, LISTINGS).select("host_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<host_id:string>" in plan


def test_csv_types_inferred(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,d,e\n1,1.5,x,NA,7\n,2,3,,1e3\n", encoding="utf8")
    df = csv_files.read_csv(spark, str(path))
    assert [tuple(r) for r in inspect.schema_table(df).collect()] == [
        ("a", "bigint", 1),
        ("b", "double", 2),
        ("c", "string", 2),
        ("d", "string", 0),
        ("e", "double", 2),
    ]
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, "x", None, 7.0),
        (None, 2.0, "3", None, 1000.0),
    ]


def test_csv_long_numbers_and_truth(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "a,b,c\n1003253567012345678,12345678901234567890,True\n1003253567012345679,1.5,False\n,,\n",
        encoding="utf8",
    )
    df = csv_files.read_csv(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "string", "boolean"]
    assert [tuple(r) for r in df.collect()] == [
        (1003253567012345678, "12345678901234567890", True),
        (1003253567012345679, "1.5", False),
        (None, None, None),
    ]


@pytest.mark.parametrize("lines", [True, False])
@pytest.mark.parametrize("row", ["1,x,EXTRA", "1"])
def test_csv_row_of_another_length_fails(spark, tmp_path, row, lines):
    path = tmp_path / "t.csv"
    path.write_text(f"a,b\n2,y\n{row}\n", encoding="utf8")
    types = StructType().add("a", "long").add("b", "string")
    for columns in (["a", "b"], ["a"]):
        with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
            csv_files.read_csv(spark, str(path), types, lines).select(columns).collect()


@pytest.mark.parametrize("lines", [True, False])
def test_csv_files_with_other_column_order_fail(spark, tmp_path, lines):
    (tmp_path / "1.csv").write_text("a,b\n1,x\n", encoding="utf8")
    (tmp_path / "2.csv").write_text("b,a\ny,2\n", encoding="utf8")
    with pytest.raises(Exception, match="CSV header|FAILED_READ"):
        csv_files.read_csv(spark, str(tmp_path), StructType(), lines).collect()


def test_csv_bad_number_fails(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("host_id\nabc\n", encoding="utf8")
    types = StructType([LISTINGS["host_id"]])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        csv_files.read_csv(spark, str(path), types).collect()


def test_csv_absent_column(spark, listings_csv):
    types = StructType([*BOOKS.fields])
    with pytest.raises(ValueError, match="title"):
        csv_files.read_csv(spark, listings_csv, types)


def test_csv_to_parquet(spark, listings_csv, tmp_path):
    stored = csv_files.csv_to_parquet(spark, listings_csv, str(tmp_path / "out"), LISTINGS)
    direct = csv_files.read_csv(spark, listings_csv, LISTINGS)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, direct.collect()))


BOOK_ROWS = [(1, "1984", "George Orwell", 1949), (2, 'Du"ne', None, 1965)]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_in(spark, tmp_path, indent):
    path = tmp_path / "books.json"
    records = [dict(zip(BOOKS.fieldNames(), row, strict=True)) for row in BOOK_ROWS]
    path.write_text(json.dumps(records, indent=indent), encoding="utf8")
    assert sorted(map(tuple, books.books_from_json(spark, str(path)).collect())) == BOOK_ROWS


def test_json_lines_round_trip(spark, tmp_path):
    out = str(tmp_path / "lines")
    json_files.write_json(spark.createDataFrame(BOOK_ROWS, BOOKS), out)
    written = "".join(p.read_text() for p in Path(out).glob("part-*"))
    assert '"author":null' in written
    back = json_files.read_json(spark, out, BOOKS, one_per_line=True)
    assert sorted(map(tuple, back.collect())) == BOOK_ROWS


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_json_array_out(spark, tmp_path, n):
    out = str(tmp_path / "array")
    df = spark.range(n).selectExpr("id", "if(id % 2 = 0, null, 'x,\"') AS v")
    json_files.write_json_array(df.repartition(7), "id", out)
    document = "".join(p.read_text() for p in sorted(Path(out).glob("part-*")))
    assert json.loads(document) == [
        {"id": i, "v": None if i % 2 == 0 else 'x,"'} for i in range(n)
    ]


@pytest.mark.parametrize(
    "text", ['[{"id": 1, "title": "a"}', '[{"id": "x"}]', "nothing", '[{"id": 1}, {"id": 2']
)
def test_json_that_does_not_parse_fails(spark, tmp_path, text):
    path = tmp_path / "cut.json"
    path.write_text(text, encoding="utf8")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        books.books_from_json(spark, str(path)).collect()
    bodies = spark.createDataFrame([('[{"id": 1}]',), (text,), (None,)], "body string")
    with pytest.raises(Exception, match="MALFORMED"):
        json_files.records_of(bodies, "body", BOOKS).collect()


@pytest.mark.parametrize("keys,fails", [([1, 2, 2], True), ([1, None, 2], True), ([1, 1, 2], False)])
def test_json_array_keys(spark, tmp_path, keys, fails):
    df = spark.createDataFrame([(k, "v") for k in keys], "id long, v string")
    out = str(tmp_path / "array")
    if fails:
        with pytest.raises(Exception, match="column id"):
            json_files.write_json_array(df, "id", out)
        return
    json_files.write_json_array(df, "id", out)
    document = "".join(p.read_text() for p in sorted(Path(out).glob("part-*")))
    assert [r["id"] for r in json.loads(document)] == keys


def test_table_with_quotes_in_names(spark, tmp_path):
    schema = StructType().add("i`d", "long").add("v", "string")
    location = str(tmp_path / "it's here")
    tables.create_if_absent(spark, "odd_names", schema, location, key="i`d", buckets=2)
    spark.createDataFrame([(1, "a")], schema).write.insertInto("odd_names")
    assert spark.table("odd_names").columns == ["i`d", "v"]
    assert Path(location).exists()


def test_indented_json(spark):
    df = spark.createDataFrame(BOOK_ROWS, BOOKS)
    texts = [r.json for r in books.books_json(df, indented=True).collect()]
    assert all("\n" in t for t in texts)
    assert [tuple(json.loads(t).values()) for t in texts] == BOOK_ROWS


def test_address_in_log(spark):
    lines = ["go https://ab-1.trycloudflare.com now", "nothing"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r.url for r in books.address_in(df, "line").collect()] == [
        "https://ab-1.trycloudflare.com",
        books.NOT_YET,
    ]


def random_csv(rng, eol, rows=80):
    parts = ["a", "bb", ",", '"', "\n", "\n\n", " ", "é", "x\ny", "'", "7"]
    field = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
    text = io.StringIO(newline="")
    writer = csv.writer(text, lineterminator=eol)
    writer.writerows([["id", "a", "b"], *([i, field(), field()] for i in range(rows))])
    return text.getvalue()


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_csv_split_between_tasks(spark, tmp_path, small_ranges, eol):
    rng = random.Random(4)
    for n in range(3):
        (tmp_path / f"{n}.csv").write_text(random_csv(rng, eol), encoding="utf8", newline="")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    one = csv_files.read_csv(spark, str(tmp_path), LETTERS)
    many = csv_files.read_csv(spark, str(tmp_path), LETTERS, split_files=True)
    assert many.schema == one.schema
    assert Counter(many.collect()) == Counter(one.collect()) and one.count() == 240


LETTERS = StructType([StructField("id", LongType())])


def test_csv_split_one_record_over_all_ranges(spark, tmp_path, small_ranges):
    text = "\n".join(f"line {i}, and more" for i in range(300))
    (tmp_path / "t.csv").write_text(f'id,a,b\n1,"{text}",x\n2,y,\n', encoding="utf8")
    rows = csv_files.read_csv(spark, str(tmp_path), LETTERS, split_files=True).collect()
    assert sorted(map(tuple, rows)) == [(1, text, "x"), (2, "y", None)]


@pytest.mark.parametrize("content", ["id,a,b\n1,x\n", "id,a,b\n1,x,y,z\n", 'id,a,b\n1,5" nail,y\n2,x,z\n', "id,a,b\n1,x,y\n"])
def test_csv_split_fails_like_in_one_piece(spark, tmp_path, content):
    (tmp_path / "1.csv").write_text(content, encoding="utf8")
    (tmp_path / "2.csv").write_text("id,b,a\n1,x,y\n", encoding="utf8")
    only = str(tmp_path / "1.csv")
    if content.endswith("1,x,y\n"):
        assert csv_files.read_csv(spark, only, LETTERS, split_files=True).count() == 1
        only = str(tmp_path)
    with pytest.raises(Exception, match="MALFORMED|header"):
        csv_files.read_csv(spark, only, LETTERS, split_files=True).select("id").collect()


def test_csv_split_without_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\ufeffid,a,b\n\n", encoding="utf8")
    assert csv_files.read_csv(spark, str(tmp_path), LETTERS, split_files=True).collect() == []


def test_scratch_is_removed(spark):
    outside = scratch_path(spark, "kept")
    with scratch_removed(spark):
        inside = scratch_path(spark, "gone")
        spark.range(3).write.parquet(inside)
        spark.read.parquet(inside).write.parquet(outside)
    assert spark.read.parquet(outside).count() == 3
    assert not Path(inside).exists()

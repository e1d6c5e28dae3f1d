"""CSV with a header, quotes, and line breaks inside fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType,
)

from tallyfield.functions.missing import tokens_to_null
from tallyfield.functions.numbers import NUMBER

WHOLE_NUMBER = r"\A\s*+[+-]?\d++\s*+\z"
TRUTH = r"(?i)\A(true|false)\z"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _type_of(kind) -> DataType:
    if kind.truth:
        return BooleanType()
    if kind.whole and kind.fits:
        return LongType()
    return DoubleType() if kind.number and kind.fits else StringType()


def inferred_types(text: DataFrame) -> StructType:
    """The narrowest of boolean, long, double, string that holds every value of each column, in one
    scan. A column with a whole number too long for a long stays text: a double would round it."""
    kinds = []
    for i, name in enumerate(text.columns):
        value = F.col(_quoted(name))
        whole = value.rlike(WHOLE_NUMBER)
        kinds.append(
            F.struct(
                F.bool_and(value.rlike(TRUTH)).alias("truth"),
                F.bool_and(whole).alias("whole"),
                F.bool_and(F.when(whole, value.try_cast("bigint").isNotNull()).when(value.isNotNull(), True)).alias("fits"),
                F.bool_and(value.rlike(NUMBER)).alias("number"),
            ).alias(f"c{i}")
        )
    found = text.agg(*kinds).first()
    return StructType(
        [StructField(c, _type_of(kind)) for c, kind in zip(text.columns, found, strict=True)]
    )


# Else fields past the wanted ones are not counted.
FORM = {"quote": '"', "escape": '"', "mode": "FAILFAST", "columnPruning": "false"}


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def split_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``record, first``: the records of CSV files with line breaks inside fields, each file read by as
    many tasks as it has byte ranges; ``first`` marks a file's first record.

    A line begins inside a field if the quotes before it, in its file, are odd in number. Tasks count
    the quotes of their byte range; one row per range, summed up in order, says how each range
    begins, and the lines of a range go on from there. The lines of a longer record meet by the line
    that begins it, across ranges too. A quote inside a field that is not quoted breaks this count;
    the record then has a wrong number of fields, and parsing fails.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("line"),
        "value",
        (_quotes(F.col("value")) % 2).alias("odd"),
    )
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = lines.groupBy("file", "range").agg(F.sum("odd").alias("odds")).select(
        F.col("file").alias("f"), F.col("range").alias("r"),
        (F.coalesce(F.sum("odds").over(earlier), F.lit(0)) % 2).alias("open"),
    )
    in_range = Window.partitionBy("file", "range").orderBy("line")
    upto = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Both ways a range may begin are kept until it is known which holds.
    state = (F.sum("odd").over(upto) - F.col("odd")) % 2
    begun = lambda s: F.last(F.when(F.col("state") == s, F.col("line")), ignorenulls=True).over(upto)
    lines = (
        lines.withColumn("state", state)
        .withColumns({"begun0": begun(0), "begun1": begun(1), "place": F.row_number().over(in_range)})
        .join(ranges, (F.col("file") == F.col("f")) & (F.col("range") == F.col("r")))
        .select(
            "file", "range", "line", "value",
            (F.col("state") != F.col("open")).alias("inside"),
            (F.col("odd") == 0).alias("closed"),
            F.when(F.col("open") == 0, F.col("begun0")).otherwise(F.col("begun1")).alias("begun"),
            ((F.col("range") == 0) & (F.col("place") == 1)).alias("first"),
        )
    )
    alone = ~F.col("inside") & F.col("closed")
    # The last beginning in earlier ranges, for lines that go on from there: one row per range.
    carried = lines.groupBy("file", "range").agg(F.max("begun").alias("last")).select(
        F.col("file").alias("f"), F.col("range").alias("r"),
        F.last(F.when(F.col("last").isNotNull(), F.struct("range", "last")), ignorenulls=True).over(earlier).alias("from"),
    )
    parts = lines.where(~alone).join(carried, (F.col("file") == F.col("f")) & (F.col("range") == F.col("r")))
    own = F.when(F.col("begun").isNotNull(), F.struct(F.col("range"), F.col("begun").alias("last")))
    longer = parts.groupBy("file", F.coalesce(own, F.col("from")).alias("begins")).agg(
        F.sort_array(F.collect_list(F.struct("range", "line", "value"))).alias("parts"), F.bool_or("first").alias("first")
    )
    joined = F.array_join(F.transform("parts", lambda x: x["value"]), "\n")
    records = lines.where(alone).select(F.col("value").alias("record"), "first").unionByName(
        longer.select(joined.alias("record"), "first")
    )
    # As in one piece: a line feed's carriage return and a byte order mark are not content.
    bare = F.regexp_replace(F.regexp_replace("record", "\r\\z", ""), r"\A\x{FEFF}", "")
    return records.withColumn("record", bare).where(F.col("record") != "")


def _split_fields(spark: SparkSession, path: str | list[str], names: list[str]) -> DataFrame:
    """Text columns of the records of ``split_records``; every file must begin with ``names``."""
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    fields = F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), FORM)
    parsed = split_records(spark, path).select(fields.alias("fields"), "first")
    head = F.array(*[F.col("fields")[f"c{i}"] for i in range(len(names))])
    other = F.raise_error(F.lit(f"a file's header differs from {names}")).cast("boolean")
    row = F.when(~F.col("first"), True).when(head == F.array(*map(F.lit, names)), False).otherwise(other)
    return parsed.where(row).select(*[F.col("fields")[f"c{i}"].alias(c) for i, c in enumerate(names)])


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    types: StructType | None = None,
    line_breaks_in_fields: bool = True,
    split_files: bool = False,
) -> DataFrame:
    """All columns of the file(s), by header name; missing-value texts become NULL.

    Columns named in ``types`` are cast, the others stay text; without ``types`` the types are
    inferred, which costs one more scan. Without line breaks inside fields, a file is split between
    tasks at lines (``line_breaks_in_fields=False``). With them, a file is one task, or, by
    ``split_files``, many tasks at the cost of shuffling its lines once: the way to read few large
    files. Either way, convert the table to Parquet once (``csv_to_parquet``).
    """
    raw = spark.read.options(**FORM, header=True, multiLine=line_breaks_in_fields, enforceSchema=False).csv(path)
    fields = _split_fields(spark, path, raw.columns) if split_files and line_breaks_in_fields else raw
    text = fields.select(*[tokens_to_null(F.col(_quoted(c))).alias(c) for c in raw.columns])
    wanted = inferred_types(text) if types is None else types
    absent = set(wanted.fieldNames()) - set(raw.columns)
    if absent:
        raise ValueError(f"columns not in the file: {sorted(absent)}")
    type_of = {field.name: field.dataType for field in wanted}
    return text.select(
        *[F.col(_quoted(c)).cast(type_of.get(c, StringType())).alias(c) for c in raw.columns]
    )


def csv_to_parquet(
    spark: SparkSession,
    path: str | list[str],
    out: str,
    types: StructType | None = None,
    line_breaks_in_fields: bool = True,
    split_files: bool = False,
) -> DataFrame:
    """Converts once; afterwards reports read only the columns they use."""
    table = read_csv(spark, path, types, line_breaks_in_fields, split_files)
    table.write.option("maxRecordsPerFile", 5_000_000).parquet(out)
    return spark.read.schema(table.schema).parquet(out)

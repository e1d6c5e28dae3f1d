"""Line dedup across documents with levelled sorted runs of line hashes.

The runs hold every line key seen so far with the first document that holds it. A batch of documents
(all ids above those before) is reduced to its distinct keys, which are looked up in the runs by a
merge join; keys that no run holds become a run of their own. Runs of a level are merged into one of
the next level when there are ``FANOUT`` of them, so that a key is rewritten once a level and a batch
meets few runs. Runs are bucketed and sorted tables: a look-up does not shuffle them.

Keys are compared by 128 bits of hash.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import BLANKS, stored

LEAST_CHARS = 10
BATCHES = 4
FANOUT = 2
NO_ID = (1 << 63) - 1  # rows without an id count as one document after all others
SPARK_SEED = 42  # fixed value: the seed of Spark's xxhash64, so both sides agree on a text's hash
_STRIP = BLANKS.encode()
_HASH = ("h1", "h2")


def line_key(line: bytes) -> bytes:
    """A line stripped of blanks at both ends, A-Z lower-cased."""
    return line.strip(_STRIP).lower()


def _code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _lines(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to one row per line long enough: id, hash of the text, position, key hash."""
    for batch in batches:
        columns: tuple[list, ...] = ([], [], [], [], [])
        texts = batch.column(1).cast(pa.binary())
        for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            data = text.as_py() or b""
            whole = _signed(xxhash.xxh64_intdigest(data, SPARK_SEED))
            for position, line in enumerate(data.split(b"\n")):
                key = line_key(line)
                if len(key) >= least and _code_points(key) >= least:
                    digest = xxhash.xxh3_128_intdigest(key)
                    for column, value in zip(
                        columns,
                        (doc, whole, position, _signed(digest >> 64), _signed(digest & (1 << 64) - 1)),
                        strict=True,
                    ):
                        column.append(value)
            if len(columns[0]) >= 50_000:
                yield _line_batch(columns)
                columns = ([], [], [], [], [])
        yield _line_batch(columns)


def _line_batch(columns: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["doc", "whole", "position", *_HASH])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, positions to drop) to id, kept text, number of lines, number dropped."""
    for batch in batches:
        texts, lines, dropped = [], [], []
        for text, drop in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
            parts = (text.as_py() or b"").split(b"\n")
            gone = set(drop.as_py() or ())
            lines.append(len(parts))
            dropped.append(len(gone))
            texts.append(b"\n".join(p for i, p in enumerate(parts) if i not in gone) if gone else b"\n".join(parts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
            ["doc_id", "kept_text", "n_lines", "n_dropped"],
        )


class LineRuns:
    """First document of every line key, as levelled sorted runs in the warehouse."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.fanout = fanout
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        keys = keys.select(*_HASH, "first").repartition(self.buckets, *_HASH)
        writer = keys.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH)
        writer.format("parquet").saveAsTable(name)
        return name

    def _add(self, name: str, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged = functools.reduce(DataFrame.unionByName, map(self.spark.table, self.levels[level]))
            whole = self._write(merged)
            for old in self.levels[level]:
                self.spark.sql(f"DROP TABLE {old}")
            self.levels[level] = []
            self._add(whole, level + 1)

    def owners(self, keys: DataFrame) -> DataFrame:
        """``keys`` (h1, h2, first, last: smallest and largest document of the batch) with
        ``known``, the document of an earlier batch that owns the key, if any."""
        known = F.lit(None).cast("long")
        for name in [n for level in reversed(self.levels) for n in level]:
            run = self.spark.table(name).withColumnRenamed("first", "seen")
            keys = keys.join(run, list(_HASH), "left").withColumn(
                "known", F.coalesce(known, F.col("seen"))
            ).drop("seen")
            known = F.col("known")
        return keys if self.levels else keys.withColumn("known", known)

    def add(self, lines: DataFrame) -> DataFrame:
        """Takes a batch of lines (doc, whole, position, h1, h2), all of documents above those taken
        before, and returns the lines to drop (doc, whole, position)."""
        keys = lines.groupBy(*_HASH).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        keys = stored(self.owners(keys), "line-keys")
        # Only keys that some document must drop meet the lines; a key that a third of all documents
        # hold is one row here, and Spark splits its lines at run time.
        owner = F.coalesce("known", "first")
        shared = keys.where("last > coalesce(known, first)").select(*_HASH, owner.alias("owner"))
        drops = lines.join(shared, list(_HASH)).where("doc > owner").select("doc", "whole", "position")
        drops = stored(drops, "line-drops")
        self._add(self._write(keys.where("known is null")))
        return drops

    def close(self) -> None:
        for name in [n for level in self.levels for n in level]:
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = LEAST_CHARS,
    batches: int = BATCHES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept_text, n_lines, n_dropped.

    A line whose key has ``least`` code points or more and is found in several documents stays only
    in the one with the smallest id. A NULL or empty text is one empty line; rows without an id
    count as one document, the last; rows that share an id are one document, each with its own
    text; a very long text or line is taken whole; an empty table gives no rows. Other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranked = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    lines = plain.select(ranked.alias("doc"), "text").mapInArrow(
        functools.partial(_lines, least), "doc long, whole long, position int, h1 long, h2 long"
    )
    # Batches are ranges of ids; where they are cut affects balance, never the result.
    shares = [i / batches for i in range(1, batches)]
    cuts = plain.where("doc_id is not null").approxQuantile("doc_id", shares, 0.01) if shares else []
    batch = F.lit(0)
    for cut in sorted(set(cuts)):
        batch = batch + (F.col("doc") >= int(cut)).cast("int")
    lines = stored(lines.withColumn("batch", batch), "lines")
    runs = LineRuns(spark)
    try:
        drops = [runs.add(lines.where(F.col("batch") == i).drop("batch")) for i in range(len(set(cuts)) + 1)]
    finally:
        runs.close()
    per_text = (
        functools.reduce(DataFrame.unionByName, drops)
        .groupBy("doc", "whole")
        .agg(F.collect_set("position").alias("drop"))
    )
    met = plain.withColumn("doc", ranked).withColumn("whole", F.xxhash64("text"))
    met = met.join(per_text, ["doc", "whole"], "left").select("doc_id", "text", "drop")
    return met.mapInArrow(_kept, "doc_id long, kept_text string, n_lines long, n_dropped long")

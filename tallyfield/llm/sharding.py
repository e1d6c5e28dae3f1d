"""Sharding by extendible hashing.

A document's hash bits lead it through a binary directory. A bucket that holds more bytes than the
limit splits on the next bit, and only that bucket, until every bucket fits; a shard is named by the
bits that lead to it. The bytes under every prefix follow from sums over longer prefixes, so one
aggregation of the documents per pass builds all levels of that pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import numbered, stored, whole_row

SHARD_BYTES = 16 * 1024 * 1024
# Bits of the hash that are used, and the most bits that one pass resolves: its directory has at
# most 2 ** PASS_BITS entries for each bucket left over by the pass before.
HASH_BITS = 60
PASS_BITS = 16


def _prefix(bits: int) -> Column:
    return F.shiftright(F.col("__hash"), HASH_BITS - bits)


def _pass(rows: DataFrame, done: int, bits: int, limit: int) -> DataFrame:
    """For each prefix of ``done + bits`` bits: the depth of its shard (NULL: still too large),
    with the shard's bytes and rows, and whether all its rows have the same hash."""
    deep = done + bits
    leaves = rows.groupBy(_prefix(deep).alias("__prefix")).agg(
        F.sum("__bytes").alias("__b"), F.count("*").alias("__n"),
        F.min("__hash").alias("__lo"), F.max("__hash").alias("__hi"),
    )
    leaves = stored(leaves, "shard-directory")
    depth = F.explode(F.sequence(F.lit(done), F.lit(deep))).alias("__depth")
    paths = leaves.select("*", depth).withColumn(
        "__node", F.expr(f"shiftright(__prefix, {deep} - __depth)")
    )
    nodes = paths.groupBy("__depth", "__node").agg(
        F.sum("__b").alias("__shard_bytes"), F.sum("__n").alias("__shard_rows"),
        (F.min("__lo") == F.max("__hi")).alias("__same"),
    )
    final = nodes.where((F.col("__shard_bytes") <= limit) | F.col("__same"))
    found = F.struct("__depth", "__shard_bytes", "__shard_rows", "__same")
    first = paths.select("__prefix", "__depth", "__node").join(final, ["__depth", "__node"])
    first = first.groupBy("__prefix").agg(F.min(found).alias("__found"))
    left = leaves.select("__prefix", "__b").join(first, "__prefix", "left")
    return stored(left.select("__prefix", "__b", "__found.*"), "shard-pass")


def assign(
    docs: DataFrame,
    limit: int = SHARD_BYTES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with shard (its bits as text), depth, piece, n_bytes and shard_bytes.

    Bytes are those of the text in UTF-8 (NULL: 0). The hash covers id and text, so rows that only
    share an id part. Rows that share both cannot part by hash: if together they exceed the limit,
    they are numbered, not gathered, whatever their other columns hold, and dealt to numbered pieces
    of their shard that fit it. A single document above the limit, however long, has a shard or a
    piece of its own. An empty table gives no rows. Columns of ``docs`` named like a new one are
    replaced by it.
    """
    new = ["shard", "depth", "piece", "n_bytes", "shard_bytes"]
    kept = [c for c in docs.columns if c not in new]
    key = F.concat_ws(
        "\x00", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    )
    digits = F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4)
    # The document travels as one struct, so that its columns cannot clash with these.
    rows = docs.select(
        whole_row(docs, kept).alias("__row"),
        F.conv(digits, 16, 10).cast("long").alias("__hash"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__bytes"),
    )
    narrow = stored(rows.select("__hash", "__bytes"), "shard-rows")
    most = narrow.agg(F.sum("__bytes")).first()[0] or 0
    done, parts = 0, []
    while True:
        bits = min(HASH_BITS - done, PASS_BITS, max(4, math.ceil(math.log2(max(1, most / limit))) + 4))
        directory = _pass(narrow, done, bits, limit)
        # The first directory is bounded by 2 ** PASS_BITS rows; later ones cover leftovers only.
        small = F.broadcast(directory) if done == 0 else directory
        met = rows.withColumn("__prefix", _prefix(done + bits)).join(small, "__prefix")
        parts.append(met.where("__depth is not null"))
        open_ = directory.where("__depth is null")
        most = open_.agg(F.max("__b")).first()[0]
        if most is None:
            break
        leftover = open_.select("__prefix")
        rows = met.where("__depth is null").select("__row", "__hash", "__bytes")
        narrow = narrow.withColumn("__prefix", _prefix(done + bits)).join(leftover, "__prefix")
        narrow = stored(narrow.select("__hash", "__bytes"), "shard-rows")
        done += bits
        if done == HASH_BITS:
            break
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    bits_text = F.lpad(F.conv(F.shiftright(F.col("__hash"), HASH_BITS - 48).cast("string"), 10, 2), 48, "0")
    low = F.col("__hash").bitwiseAND(F.lit((1 << (HASH_BITS - 48)) - 1))
    low_text = F.lpad(F.conv(low.cast("string"), 10, 2), HASH_BITS - 48, "0")
    named = found.withColumn(
        "shard", F.substring(F.concat(bits_text, low_text), F.lit(1), F.col("__depth"))
    )
    return _pieces(named, limit).select("__row.*", *new)


def _pieces(found: DataFrame, limit: int) -> DataFrame:
    """Deals rows whose shard cannot split to pieces within the limit: as they share id and text, all
    rows of such a shard have the same bytes."""
    large = F.col("__same") & (F.col("__shard_rows") > 1) & (F.col("__shard_bytes") > limit)
    tail = [F.col("__depth").cast("int").alias("depth")]
    plain = found.where(~large).select(
        "__row", "shard", *tail, F.lit(0).cast("long").alias("piece"),
        F.col("__bytes").alias("n_bytes"), F.col("__shard_bytes").alias("shard_bytes"),
    )
    many = numbered(
        found.where(large).select("__row", "shard", "__depth", "__bytes", "__shard_rows"), "shard", "shard-pieces"
    )
    each = F.greatest(F.floor(F.lit(limit) / F.col("__bytes")), F.lit(1))
    piece = F.floor(F.col("__rank") / each)
    here = F.least(each, F.col("__shard_rows") - piece * each)
    return plain.unionByName(
        many.select(
            "__row", "shard", *tail, piece.alias("piece"), F.col("__bytes").alias("n_bytes"),
            (F.col("__bytes") * here).alias("shard_bytes"),
        )
    )

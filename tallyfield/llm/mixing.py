"""Mixing sources to target weights by a low-discrepancy schedule.

Every slot of the schedule takes one block of equal size. Slot ``i`` stands at the ``i``-th van der
Corput point (the bits of ``i`` reversed, as a fraction), the point falls into one source's share of
the cumulative targets, and the slot's rank among the slots of its source says which block it takes.
A source is one stream of words: its documents in the order of a hash of id and text, cut into blocks
of equal size without regard to where documents end. Each prefix of the schedule therefore holds the
sources in nearly their shares, and a rerun gives the same schedule.

The number of slots is between ``SLOTS`` and twice that for any corpus of at least so many words: a
block grows with the corpus. A source's words miss its target by a few blocks at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import n_words, stored, whole_row

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SLOTS = 65_536
CELLS = 4_096


def _order(doc_id: Column, text: Column) -> Column:
    """Where a document stands in its source's stream: a hash of its id and its text, so that rows
    which share an id, or have none, are spread."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))


def targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS
) -> DataFrame:
    """One row per source of ``sized`` (source, size): its number in code-point order (NULL last),
    its words, its target and where its share begins among the cumulative targets.

    Targets share the sum of all sizes by weight. A target stops at ``most_repeats`` times its
    source's size; the excess goes to the others by weight until no target is above. With sources
    ordered by (limit / weight), the sources that stop are a prefix, so running sums find the level.
    One row per source stands in these windows, never a document.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), number % len(weights) + 1)
    numbered = per_source.select(
        "source",
        "source_size",
        number.alias("source_no"),
        weight.cast("double").alias("weight"),
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
        F.sum(weight).over(Window.partitionBy()).cast("double").alias("all_weights"),
    ).withColumn("most", most_repeats * F.col("source_size").cast("double"))
    before = Window.orderBy(F.col("most") / F.col("weight"), "source_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = numbered.withColumn("level", level)
    within = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    # Behind the first source below its limit levels only fall, so the largest is the one sought.
    shared = levelled.withColumn("level", F.max(within).over(Window.partitionBy()))
    reached = F.least(
        F.col("most"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight")
    )
    until = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        shared.withColumn("target", reached)
        .withColumn("until", F.sum("target").over(until))
        .select(
            "source", "source_no", "source_size", "target", "total",
            (F.col("until") - F.col("target")).alias("share_from"),
            F.col("until").alias("share_to"),
        )
    )


def plan_size(total: int, slots: int = SLOTS) -> tuple[int, int, int]:
    """Words in a block, number of slots, and bits of the point sequence for ``total`` words."""
    block = max(1, total // slots)
    n_slots = (2 * total + block) // (2 * block)
    return block, n_slots, max(0, n_slots - 1).bit_length()


def schedule(
    source_targets: DataFrame,
    total: int,
    slots: int = SLOTS,
    most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """Rows (slot, source_no, repeat, block): which block of which source each slot takes.

    Points meet shares by an equi join on cells of the unit interval, then by the exact bounds.
    """
    spark = source_targets.sparkSession
    block, n_slots, bits = plan_size(total, slots)
    slot = F.col("id")
    point = F.lit(0).cast("long")
    for bit in range(bits):
        point = point + F.shiftleft(F.shiftright(slot, bit).bitwiseAND(F.lit(1)), bits - 1 - bit)
    place = point.cast("double") * float(total) / float(1 << bits)
    cell = lambda x: F.floor(x / float(max(total, 1)) * CELLS)
    points = spark.range(n_slots).select(slot.alias("slot"), place.alias("place"))
    shares = source_targets.where("share_to > share_from").withColumn(
        "cell", F.explode(F.sequence(cell(F.col("share_from")), cell(F.col("share_to"))))
    )
    met = points.withColumn("cell", cell(F.col("place"))).join(shares, "cell")
    met = met.where("place >= share_from and place < share_to")
    rank = F.row_number().over(Window.partitionBy("source_no").orderBy("slot")) - 1
    blocks = F.ceil(F.col("source_size") / F.lit(block))
    return (
        met.withColumn("rank", rank)
        .withColumn("blocks", blocks)
        .where(F.col("rank") < most_repeats * F.col("blocks"))
        .select(
            "slot", "source_no",
            F.floor(F.col("rank") / F.col("blocks")).alias("repeat"),
            (F.col("rank") % F.col("blocks")).cast("long").alias("block"),
        )
    )


def streams(sized: DataFrame, source_targets: DataFrame) -> DataFrame:
    """``sized`` (doc_id, source, size, order) with its source's columns, ``row`` (one number per document
    within source and bucket) and ``begin``, the document's first word in its source's stream.

    The running sum of a source is split over 4,096 ranges of the hash: each range is summed, the
    few sums are accumulated per source, and documents accumulate within their range only. A source
    with a third of all rows is spread over all tasks.
    """
    ordered = sized.withColumn("bucket", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))
    per_bucket = ordered.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = per_bucket.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    t = source_targets.withColumnRenamed("source", "s")
    offsets = offsets.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s", "bucket_size")
    offsets = offsets.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    here = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size")
    placed = ordered.withColumn("row", F.row_number().over(here)).withColumn(
        "within", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    return placed.join(offsets, same).select(
        "doc_id", "size", "source_no", "source_size", "target", "bucket", "row",
        (F.col("offset") + F.col("within")).alias("begin"),
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    slots: int = SLOTS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (words), source_size, target, taken (words the mix
    takes from it, repeats counted).

    A NULL source is a source of its own, placed last; a NULL text has no words, is never taken and
    keeps its row; repeated rows and repeated ids are documents of their own; a very long text is
    cut into as many blocks as it fills; an empty table gives no rows. Other columns of ``docs`` are
    not looked at, whatever their names.
    """
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
        _order(F.col(doc_id), F.col(text)).alias("order"),
    )
    sized = stored(sized, "mix-sizes")
    source_targets = stored(targets(sized, weights, most_repeats), "mix-targets")
    first = source_targets.agg(F.max("total")).first()
    total = int(first[0] or 0)
    block = plan_size(total, slots)[0]
    uses = (
        schedule(source_targets, total, slots, most_repeats)
        .groupBy("source_no", "block")
        .agg(F.count("*").alias("uses"))
    )
    placed = streams(sized, source_targets)
    key = ["source_no", "bucket", "row"]
    last = F.floor((F.col("begin") + F.col("size") - 1) / F.lit(block))
    pieces = placed.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("begin") / F.lit(block)), last))
    )
    words = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(
        F.col("begin"), F.col("block") * block
    )
    # Documents without words take part as a block that no slot takes.
    nothing = placed.where("size = 0").withColumn("block", F.lit(-1).cast("long"))
    taken = F.sum(F.when(F.col("block") >= 0, words * F.coalesce(F.col("uses"), F.lit(0))).otherwise(0))
    return (
        pieces.unionByName(nothing)
        .join(uses, ["source_no", "block"], "left")
        .groupBy(*key, "doc_id", "size", "source_size", "target")
        .agg(taken.cast("long").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix as documents: each row as often as the mix takes its words, rounded to whole
    documents (so 0 to ``most_repeats`` times). Rows of one id are decided together."""
    per_id = (
        mix(docs, **parameters)
        .groupBy(F.col("doc_id").alias("mix_id"))
        .agg(F.sum("size").alias("mix_size"), F.sum("taken").alias("mix_taken"))
        .where("mix_size > 0")
        .select("mix_id", F.round(F.col("mix_taken") / F.col("mix_size")).cast("int").alias("mix_times"))
        .where("mix_times > 0")
    )
    key = F.col(parameters.get("doc_id", "doc_id"))
    rows = docs.select(key.alias("__id"), whole_row(docs).alias("__row"))
    times = F.explode(F.array_repeat(F.lit(1), F.col("mix_times"))).alias("__time")
    met = rows.join(per_id, F.col("__id").eqNullSafe(F.col("mix_id")))
    return met.select("__row", times).select("__row.*")

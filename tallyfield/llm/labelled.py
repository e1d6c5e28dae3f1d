"""Labels, folds and bounded training samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def label_of(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """(label_id, label: 0 or 1), one row per id; rows without an id or a label are left out, and of
    several labels the smallest holds."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
    return known.groupBy(F.col(doc_id).alias("label_id")).agg(F.min(label).cast("int").alias("label"))


def first_by_hash(ids: DataFrame, most: int, salt: str) -> DataFrame:
    """At most ``most`` distinct ids of the column doc_id, those with the smallest hash: the documented
    bound of a training sample.

    Only ids under a threshold of the hash, some twice as many as wanted, are compared with each other,
    so no task gets more; the threshold is left out should it leave too few.
    """
    place = F.xxhash64(F.lit(salt), "doc_id")
    known = ids.select("doc_id").where("doc_id is not null")
    n = known.agg(F.approx_count_distinct("doc_id")).first()[0]
    if n > 4 * most:
        low = known.where(place < -(1 << 63) + (1 << 64) * 2 * most // n).distinct()
        if low.count() >= most:
            return low.orderBy(place, "doc_id").limit(most)
    return known.distinct().orderBy(place, "doc_id").limit(most)

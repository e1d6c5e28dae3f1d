"""Insert by key, skipping keys that are already there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_rows(table: DataFrame, batch: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows of ``batch`` to append to ``table``: new keys only, the lowest ``seq`` per new key.

    ``seq`` gives the order of the batch and is not part of the result; a missing one comes first.
    Which row wins is told by minima of fixed width, so the batch is aggregated by hashing and never
    sorted: per key and ``seq`` the smallest hash of a row, then per key the lowest ``seq`` with its
    hash. Both combine before the shuffle, so one key may fill a third of the batch. Rows are met
    again by key, ``seq`` and hash, for new keys only, and of equal rows one is kept. The anti join
    reads only the key of the table. A missing key fails the query. No column may be a map.
    """
    payload = [c for c in batch.columns if c not in (key, seq)]
    present = F.when(
        F.col(key).isNull(), F.raise_error(F.lit(f"missing key in column {key}"))
    ).otherwise(F.col(key))
    rows = batch.select(
        present.alias("__key"),
        F.col(seq).alias("__seq"),
        F.xxhash64(*payload).alias("__mark") if payload else F.lit(0).cast("long").alias("__mark"),
        *payload,
    )
    none = F.col("__seq").isNull()
    first = (
        rows.groupBy("__key", "__seq")
        .agg(F.min("__mark").alias("mark"))
        .groupBy("__key")
        .agg(
            F.min("__seq").alias("lowest"),
            F.min_by("mark", "__seq").alias("its_mark"),
            F.min(F.when(none, F.col("mark"))).alias("unnumbered"),
        )
    )
    fresh = first.join(table.select(F.col(key).alias("__key")), "__key", "left_anti").select(
        F.col("__key").alias("__fresh_key"),
        F.when(F.col("unnumbered").isNull(), F.col("lowest")).alias("__fresh_seq"),
        F.coalesce("unnumbered", "its_mark").alias("__fresh_mark"),
    )
    same = (
        (F.col("__key") == F.col("__fresh_key"))
        & F.col("__seq").eqNullSafe(F.col("__fresh_seq"))
        & (F.col("__mark") == F.col("__fresh_mark"))
    )
    return (
        rows.join(fresh, same, "left_semi")
        .distinct()
        .select(*[F.col("__key").alias(key) if c == key else c for c in batch.columns if c != seq])
    )


def insert_or_ignore(table: DataFrame, batch: DataFrame, key: str, seq: str) -> DataFrame:
    """The table as it is after the insert."""
    return table.unionByName(new_rows(table, batch, key, seq))

"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (id, component): the smallest id each vertex reaches.

    Every round takes the smallest label among the neighbours, then the label of that label, so the
    number of rounds grows with the logarithm of a chain's length. Labels are written each round; no
    link or label passes through the driver.
    """
    both = stored(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        "links",
    )
    labels = stored(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
        .select("id", F.least("id", "component").alias("component")),
        "labels",
    )
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, F.col("id") == F.col("a")).select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        up = hooked.select(F.col("id").alias("up"), F.col("component").alias("above"))
        jumped = hooked.join(up, F.col("component") == F.col("up")).select(
            "id", "old", F.least("component", "above").alias("component")
        )
        jumped = stored(jumped, "labels")
        labels = jumped.select("id", "component")
        if jumped.where("old <> component").limit(1).count() == 0:
            return labels

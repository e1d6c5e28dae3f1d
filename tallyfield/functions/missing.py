"""One meaning of "missing": SQL NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that a CSV reader in the pandas family takes as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def tokens_to_null(text: Column) -> Column:
    return F.when(~text.isin(*NA_TOKENS), text)


def nan_to_null(number: Column) -> Column:
    """``avg`` skips NULL but not NaN, and NaN compares above everything."""
    return F.when(~F.isnan(number), number)

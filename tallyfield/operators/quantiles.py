"""Exact interpolated quantiles that no single task has to hold, and outlier flags.

The built-in ``percentile`` keeps every distinct value in one task. Here the values at the wanted ranks are
found by radix selection: every value becomes a whole number of 64 bits in the same order, and the rows are
counted by its leading 16 bits, then by 12 more bits at a time, but only below the cells that hold a wanted
rank, until each of these holds one number. A round scans the one column, combines its counts in every task
and shuffles nothing else; it ends in at most 65,536 totals, later in 4,096 for each of at most two cells per
wanted fraction, whatever the size of the table or the cluster. These totals are all that the driver sees.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.missing import nan_to_null

# Bits of a double: fraction, and what the exponent is raised by.
_FRACTION = 52
_RAISED = 1023
# Bits left after each round.
ROUNDS = (48, 36, 24, 12, 0)


def _array(values: Sequence[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{v!r}{'D' * isinstance(v, float)}" for v in values) + ")")


def order_numbers(df: DataFrame, value: Column) -> DataFrame:
    """``number``: each double as a whole number of 64 bits in the same order, both zeros as 0: its bits
    without the sign, negated for negative values. NULL and NaN give NULL.

    The logarithm may be off by one beside a power of two; comparing with the power puts that right, and
    all else is exact: dividing by a power of two, and taking away 1. Each step is a projection of its own,
    so that no expression is written out where it is used.
    """
    power = F.pow(F.lit(2.0), F.col("near"))
    size, exponent = F.col("size"), F.col("exponent")
    fraction = (size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << _FRACTION)
    bits = (
        F.when(size == 0, F.lit(0).cast("long"))
        .when(size == float("inf"), F.lit((2 * _RAISED + 1) << _FRACTION))
        .when(size < 2.0 ** (1 - _RAISED), (size * 2.0**537 * 2.0**537).cast("long"))
        .otherwise(F.shiftleft(exponent.cast("long") + _RAISED, _FRACTION) + fraction.cast("long"))
    )
    return (
        df.select(nan_to_null(value.cast("double")).alias("value"))
        .select(F.abs("value").alias("size"), (F.col("value") < 0).alias("negative"))
        .select("size", "negative", F.least(F.floor(F.log2(size)), F.lit(_RAISED)).alias("near"))
        .select("size", "negative", "near", power.alias("power"))
        .select(
            "size", "negative",
            (F.col("near") - (size < F.col("power")).cast("int") + (size >= F.col("power") * 2).cast("int")).alias("exponent"),
        )
        .select("negative", bits.alias("bits"))
        .select(F.when(F.col("negative"), -F.col("bits")).otherwise(F.col("bits")).alias("number"))
    )


def _value_of(number: int) -> float:
    """The double that ``order_numbers`` made the number of."""
    size = struct.unpack("<d", struct.pack("<q", abs(number)))[0]
    return -size if number < 0 else size


def _totals(numbers: DataFrame, wanted: list[int] | None, kept: int, left: int) -> np.ndarray:
    """The cells told by the bits before the last ``left``, below the ``wanted`` cells of the round before
    (told by the bits before the last ``kept``): cell, rows, least and greatest number, in order of cells.
    """
    cell = F.shiftright("number", left)
    if wanted is not None:
        # No filter: Catalyst would push it to the scan, where every number would be made a second time.
        cell = F.when(F.expr(f"shiftright(number, {kept}) IN ({', '.join(map(str, wanted))})"), cell)
    cells = numbers.groupBy(cell.alias("cell")).agg(
        F.count("*").alias("rows"), F.min("number").alias("least"), F.max("number").alias("greatest")
    )
    found = cells.toArrow()
    found = found.filter(pc.is_valid(found.column("cell")))
    table = np.column_stack([found.column(c).to_numpy() for c in ("cell", "rows", "least", "greatest")])
    return table[np.argsort(table[:, 0])]


def _at_ranks(numbers: DataFrame, fractions: Sequence[float]) -> tuple[int, dict[int, int]]:
    """The last rank, and the number at each rank next to a wanted position."""
    cells, kept, last, ranks = None, 64, -1, np.zeros(0, np.int64)
    before: dict[int, int] = {}  # rows before each wanted cell
    for left in ROUNDS:
        totals = _totals(numbers, None if cells is None else sorted(before), kept, left)
        if cells is None:
            last = int(totals[:, 1].sum()) - 1
            if last < 0:
                return last, {}
            places = [last * float(f) for f in fractions]
            ranks = np.unique([near(p) for p in places for near in (math.floor, math.ceil)])
            begins = totals[:, 1].cumsum() - totals[:, 1]
        else:
            upper = totals[:, 0] >> (kept - left)
            first = np.flatnonzero(np.r_[True, upper[1:] != upper[:-1]])
            running = totals[:, 1].cumsum() - totals[:, 1]
            offset = np.array([before[int(u)] for u in upper[first]]) - running[first]
            begins = running + np.repeat(offset, np.diff(np.r_[first, len(upper)]))
        # Cells in order hold ranks in order, as all wanted cells of the round before are here.
        at = np.searchsorted(begins, ranks, "right") - 1
        cells, kept = totals[at], left
        before = dict(zip(cells[:, 0].tolist(), begins[at].tolist(), strict=True))
        if (cells[:, 2] == cells[:, 3]).all():
            break
    return last, dict(zip(ranks.tolist(), cells[:, 2].tolist(), strict=True))


def exact_quantiles(df: DataFrame, column: str, fractions: Sequence[float]) -> DataFrame:
    """``fraction, value``, interpolated linearly between the two nearest ranks.

    Missing values do not count; without any value the result is NULL per fraction. The rounds run when
    this is called; the result is a table of one row per fraction.
    """
    last, numbers_at = _at_ranks(order_numbers(df, F.col(column)), fractions)
    ranks = list(numbers_at)
    values = dict(zip(ranks, map(_value_of, numbers_at.values()), strict=True))

    def interpolated(fraction: float) -> float | None:
        if last < 0:
            return None
        position = last * fraction
        below, above = values[math.floor(position)], values[math.ceil(position)]
        part = position - math.floor(position)
        if below == above:
            return below
        return below + (above - below) * part if part < 0.5 else above - (above - below) * (1 - part)

    found = {"fraction": [float(f) for f in fractions], "value": [interpolated(float(f)) for f in fractions]}
    schema = pa.schema([("fraction", pa.float64()), ("value", pa.float64())])
    return df.sparkSession.createDataFrame(pa.table(found, schema=schema))


def approximate_quantiles(
    df: DataFrame, column: str, fractions: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """``fraction, value`` from a sketch: an element of the data, off by 1/accuracy of the rows."""
    wanted = _array([float(f) for f in fractions])
    found = F.percentile_approx(nan_to_null(F.col(column).cast("double")), wanted, accuracy)
    pairs = F.arrays_zip(wanted.alias("fraction"), "found")
    return (
        df.agg(found.alias("found"))
        .select(F.explode(pairs).alias("pair"))
        .select("pair.fraction", F.col("pair.found").alias("value"))
    )


def percentile_table(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """``percentile`` 1 to 100 and the value at it, in order."""
    table = exact_quantiles(df, column, [k / 100 for k in range(1, 101)])
    return table.select(
        F.round(F.col("fraction") * 100).cast("bigint").alias("percentile"),
        F.col("value").alias(name),
    ).orderBy("percentile")


def flag_above_quantile(
    df: DataFrame,
    column: str,
    fraction: float = 0.99,
    name: str = "outlier_check",
    above: str = "Outlier",
    rest: str = "Good",
) -> DataFrame:
    """Labels rows strictly above the quantile; rows without a value belong to the rest."""
    threshold = exact_quantiles(df, column, [fraction]).select("value").scalar()
    return df.withColumn(
        name, F.when(nan_to_null(F.col(column)) > threshold, above).otherwise(rest)
    )


def top_flagged(
    df: DataFrame, flag: str, label: str, measure: str, k: int, tie_break: str
) -> DataFrame:
    """The k labelled rows with the highest measure: a top-k per task, then one merge."""
    return df.where(F.col(flag) == label).orderBy(F.desc(measure), tie_break).limit(k)

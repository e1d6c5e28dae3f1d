"""Money text to numbers, and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ``cast`` alone also reads "1d", "nan" and "Infinity" as numbers.
NUMBER = r"\A\s*+[+-]?(\d++(\.\d*+)?|\.\d++)([eE][+-]?\d++)?\s*+\z"
NAN = r"(?i)\A\s*[+-]?nan\s*\z"


def plain_digits(money: Column) -> Column:
    """``"$1,234.00"`` to ``"1234.00"``."""
    return F.translate(money.cast("string"), "$,", "")


def money_lenient(money: Column) -> Column:
    """The amount as a double; text that is not a number becomes NULL, as do the
    words inf and nan. Digits beyond the range of a double, such as 1e400, become infinity."""
    text = plain_digits(money)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def money_strict(money: Column) -> Column:
    """The amount as a double; text that is not a number fails the query, in any ANSI mode."""
    text = plain_digits(money)
    return (
        F.when(text.rlike(NUMBER), text.try_cast("double"))
        .when(text.isNull() | text.rlike(NAN), F.lit(None).cast("double"))
        .otherwise(F.raise_error(F.concat(F.lit("not an amount: "), text)).cast("double"))
    )


def round_half_even(number: Column, digits: int = 0) -> Column:
    return F.bround(number, digits)


def percent_above(high: Column, low: Column) -> Column:
    """By how many percent ``high`` exceeds ``low``; NULL when either is missing or low is 0."""
    return round_half_even(F.try_divide(high, low) - 1, 3) * 100

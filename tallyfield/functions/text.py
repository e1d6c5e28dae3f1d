"""Text tests and extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal digits of any script, plus the digit-like signs (superscripts, circled digits and so
# on) that Unicode gives the numeric type "digit".
DIGITS_ONLY = (
    r"\A[\p{Nd}²³¹፩-፱᧚⁰⁴-⁹₀-₉"
    r"①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾"
    r"➀-➈➊-➒\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}"
    r"\x{1F100}-\x{1F10A}]++\z"
)
# ``^...$`` would also accept a final line break.
LETTERS_ONLY = r"\A\p{L}++\z"
# Tried only where a run of white space begins, so that long runs inside a text cost no more.
TRAILING_SPACE = r"(?U)(?<![\s\x1C-\x1F])[\s\x1C-\x1F]++\z"


def digits_only(text: Column) -> Column:
    return text.rlike(DIGITS_ONLY)


def letters_only(text: Column) -> Column:
    return text.rlike(LETTERS_ONLY)


def strip_end(text: Column) -> Column:
    """Remove trailing white space of any kind; ``rtrim`` removes blanks only."""
    return F.regexp_replace(text, TRAILING_SPACE, "")


def first_part(text: Column, separator: str) -> Column:
    return F.substring_index(text, separator, 1)


def contains_any(text: Column, parts: list[str]) -> Column:
    """True where any part occurs. A part that holds another part adds nothing and is left out."""
    needed = [p for p in dict.fromkeys(parts) if not any(q != p and q in p for q in parts)]
    return reduce(lambda a, b: a | b, [text.contains(p) for p in needed])


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])


def first_match(text: Column, pattern: str, default: str | None = None) -> Column:
    """The first match of a regular expression in the whole text, else ``default``."""
    found = F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    return found if default is None else F.coalesce(found, F.lit(default))


def list_length(text: Column) -> Column:
    """Number of elements of a list written as text: ``["Wifi", 'TV']`` is 2.

    Single and double quotes and backslash escapes are read. NULL for missing or malformed text. The text
    is read once, as the first of two elements of an array; the second holds the text's hash. A JSON reader
    stops at the bracket that closes what it reads, so only if the hash is met in its place was the text one
    whole list and nothing else.
    """
    mark = F.xxhash64(text).cast("string")
    both = F.concat(F.lit("["), text, F.lit(',["'), mark, F.lit('"]]'))
    read = F.from_json(both, "array<array<string>>", {"allowBackslashEscapingAnyCharacter": "true"})
    whole = (F.array_size(read) == 2) & (F.get(F.get(read, F.lit(1)), F.lit(0)) == mark)
    return F.when(whole, F.array_size(F.get(read, F.lit(0))))

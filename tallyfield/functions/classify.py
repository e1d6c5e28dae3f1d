"""Sorting free text into classes by ordered rules and by ordered word lists."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfield.functions.text import (
    digits_only,
    letters_only,
    starts_with_any,
    strip_end,
)
from tallyfield.lookups import COUNTRIES, US_STATE_CODES, US_STATES


def first_rule(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds; a NULL condition does not hold."""
    (condition, label), *rest = rules
    chain = F.when(condition, label)
    for condition, label in rest:
        chain = chain.when(condition, label)
    return chain.otherwise(default)


def _trie(ranks: dict[str, int]) -> str:
    """A regular expression for the names that keys of ``ranks`` end in, as a trie folded into groups: at
    each place of the text one letter is tried once, however many names share it. Where a name is the
    beginning of others, those of better rank are tried first and the rest are left out."""
    here = ranks.get("")
    below: dict[str, dict[str, int]] = {}
    for name, rank in ranks.items():
        if name and (here is None or rank < here):
            below.setdefault(name[0], {})[name[1:]] = rank
    branches = [re.escape(letter) + _trie(rest) for letter, rest in sorted(below.items())]
    if here is not None:
        return f"(?:{'|'.join(branches)}|)" if branches else ""
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def _any_of(names: Sequence[str]) -> str:
    """A regular expression for any of the names, earlier names first where several fit at one place."""
    ranks: dict[str, int] = {}
    for rank, name in enumerate(names):
        ranks.setdefault(name, rank)
    return _trie(ranks)


def _literals(values: Sequence[str]) -> Column:
    """A constant array; split from one literal, which is folded and far quicker to build."""
    return F.split(F.lit("\n".join(values)), "\n")


def _ranked(tiers: Sequence[tuple[Sequence[str], str | None]]) -> dict[str, str]:
    """Name to label over all tiers, in rank order; a name in two tiers keeps the earlier one."""
    ranked: dict[str, str] = {}
    for names, label in tiers:
        for name in names:
            ranked.setdefault(name, label or name)
    return ranked


def lookup_in_order(text: Column, tiers: Sequence[tuple[Sequence[str], str | None]]) -> Column:
    """Label of the best-ranked name that occurs anywhere in the text, else NULL.

    ``tiers`` holds ``(names, label)``; a label of None means the name itself. All names are found
    in one scan of the text (the look-ahead lets matches overlap); the lowest list position wins,
    whichever occurs first in the text.
    """
    labels = _ranked(tiers)
    names = _literals(list(labels))
    found = F.regexp_extract_all(text, F.lit(f"(?=({_any_of(list(labels))}))"), 1)
    best = F.array_min(F.transform(found, lambda name: F.array_position(names, name)))
    return F.get(_literals(list(labels.values())), best.cast("int") - 1)


def lookup_longest_word(text: Column, tiers: Sequence[tuple[Sequence[str], str | None]]) -> Column:
    """Label of the longest name that occurs as whole words, else NULL; ties go by rank."""
    labels = _ranked(tiers)
    by_length = sorted(labels, key=len, reverse=True)
    found = F.regexp_extract_all(text, F.lit(rf"(?<!\p{{L}})(?=({_any_of(by_length)})(?!\p{{L}}))"), 1)
    best = F.array_min(
        F.transform(found, lambda name: F.array_position(_literals(by_length), name))
    )
    return F.get(_literals([labels[n] for n in by_length]), best.cast("int") - 1)


def country_of(location: Column, match: str = "list_order") -> Column:
    """The country named in a free-text location; ``OTHERS`` if none, NULL stays NULL.

    A country name anywhere in the text, then a US state name, then a US state code as the last
    word. With ``match="list_order"`` the earliest name of the list wins on any substring, so
    "Romania" is OMAN and "Indiana" is INDIA. With ``match="longest_word"`` names must be whole
    words and the longest wins, so "Romania" is ROMANIA and "New Mexico" is UNITED STATES.
    """
    find = {"list_order": lookup_in_order, "longest_word": lookup_longest_word}[match]
    text = F.upper(location)
    named = find(text, [(COUNTRIES, None), (US_STATES, "UNITED STATES")])
    coded = strip_end(text).rlike(rf" (?:{_any_of(US_STATE_CODES)})\z")
    return F.when(
        location.isNotNull(),
        F.coalesce(named, F.when(coded, "UNITED STATES"), F.lit("OTHERS")),
    )


def license_category(license: Column) -> Column:
    """The kind of a license text, by its first fitting form."""
    # The labels and the beginnings that tell them.
    return first_rule(
        [
            (license.isNull(), "Missing"),
            (starts_with_any(license, ["ES", "es"]), "Long ES codes"),
            (starts_with_any(license, ["VT", "vt"]), "VT codes"),
            (starts_with_any(license, ["AM", "am"]), "AM codes"),
            (starts_with_any(license, ["HM", "hm"]), "HM codes"),
            (license.contains("/"), "Fraction codes"),
            (digits_only(license), "Numeric-only codes"),
            (letters_only(license), "Verbal descriptions"),
        ],
        default="Other",
    )

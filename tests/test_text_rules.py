"""Column functions against answers worked out by hand, and against short Python restatements."""

import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import classify, missing, numbers, text
from tallyfield.lookups import COUNTRIES, US_STATE_CODES, US_STATES

LICENSES = {
    None: "Missing",
    "ESFCTU00": "Long ES codes",
    "es1": "Long ES codes",
    "ES/1": "Long ES codes",
    "VT-1": "VT codes",
    "vt1": "VT codes",
    "AM-9": "AM codes",
    "amparo": "AM codes",
    "HM1": "HM codes",
    "123/2020": "Fraction codes",
    "en tramite/1": "Fraction codes",
    "12345": "Numeric-only codes",
    "²": "Numeric-only codes",
    "٣": "Numeric-only codes",
    "Exempt": "Verbal descriptions",
    "ñandú": "Verbal descriptions",
    "Es1": "Other",
    "Vt-1": "Other",
    "En proceso": "Other",
    "A1": "Other",
    "": "Other",
    "abc\n": "Other",
    "12\n": "Other",
}
COUNTRY = {
    None: None,
    "Madrid, Spain": "SPAIN",
    "Bucharest, Romania": "OMAN",
    "Lagos, Nigeria": "NIGER",
    "Mogadishu, Somalia": "MALI",
    "Santo Domingo, Dominican Republic": "DOMINICA",
    "Bissau, Guinea-Bissau": "GUINEA",
    "Gary, Indiana": "INDIA",
    "Albuquerque, New Mexico": "MEXICO",
    "Atlanta, Georgia": "GEORGIA",
    "Abidjan, Côte d'Ivoire": "CÔTE D'IVOIRE",
    "Congo (Congo-Brazzaville)": "CONGO (CONGO-BRAZZAVILLE)",
    "From Spain to Chile": "CHILE",
    "Denver, Colorado": "UNITED STATES",
    "Austin, TX": "UNITED STATES",
    "Austin, TX\t": "UNITED STATES",
    "Austin, tx \u00a0\n": "UNITED STATES",
    "Berlin, DE": "UNITED STATES",
    "TX": "OTHERS",
    "madrid": "OTHERS",
    "": "OTHERS",
}
LONGEST = {
    None: None,
    "Bucharest, Romania": "ROMANIA",
    "Lagos, Nigeria": "NIGERIA",
    "Bissau, Guinea-Bissau": "GUINEA-BISSAU",
    "Port Moresby, Papua New Guinea": "PAPUA NEW GUINEA",
    "Santo Domingo, Dominican Republic": "DOMINICAN REPUBLIC",
    "Gary, Indiana": "UNITED STATES",
    "Albuquerque, New Mexico": "UNITED STATES",
    "Atlanta, Georgia": "GEORGIA",
    "Austin, TX": "UNITED STATES",
    "Spaniard": "OTHERS",
    "Congo (Congo-Brazzaville)": "CONGO (CONGO-BRAZZAVILLE)",
}
PRICES = {
    "$1,234.00": 1234.0,
    "-$3.00": -3.0,
    "1e3": 1000.0,
    " $5 ": 5.0,
    "\t7\n": 7.0,
    ".5": 0.5,
    "5.": 5.0,
    None: None,
    "nan": None,
    "abc": None,
    "$": None,
    "": None,
    "1d": None,
    "0x1A": None,
    "inf": None,
    "1 2": None,
}
AMENITIES = {
    '["a", "b"]': 2,
    "['a']": 1,
    r"['it\'s']": 1,
    r'["55\" TV"]': 1,
    r'["caf\u00e9", "\x41"]': 2,
    "[]": 0,
    '["a, b", "[c]"]': 2,
    None: None,
    '["a"]\n': 1,
    '["a"] x': None,
    '["a"] x]': None,
    '["a"]]': None,
    "[]]": None,
    '["a"],["b"]': None,
    '["a"],"w":["b"]': None,
    '["a"]} x]': None,
    '[["a", "b"], "c"]': 2,
    '["a"': None,
    '{"a": 1}': None,
    "not a list": None,
    "": None,
}


def apply(spark, values, function):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i long, x string").select("i", function(F.col("x")))
    return [row[1] for row in df.orderBy("i").collect()]


@pytest.mark.parametrize(
    "expected,function",
    [
        (LICENSES, classify.license_category),
        (COUNTRY, classify.country_of),
        (LONGEST, lambda c: classify.country_of(c, "longest_word")),
        (PRICES, numbers.money_lenient),
        (AMENITIES, text.list_length),
    ],
    ids=["license", "country", "country_longest", "price", "amenities"],
)
def test_by_hand(spark, expected, function):
    assert dict(zip(expected, apply(spark, expected, function), strict=True)) == expected


def python_category(x):
    if x is None:
        return "Missing"
    for prefix, label in (("ES", "Long ES"), ("VT", "VT"), ("AM", "AM"), ("HM", "HM")):
        if x.startswith((prefix, prefix.lower())):
            return f"{label} codes"
    if "/" in x:
        return "Fraction codes"
    if x.isdigit():
        return "Numeric-only codes"
    return "Verbal descriptions" if x.isalpha() else "Other"


def python_country(x):
    if x is None:
        return None
    up = x.upper()
    named = [c for c in COUNTRIES if c in up]
    if named:
        return named[0]
    if any(s in up for s in US_STATES) or up.rstrip().endswith(
        tuple(" " + c for c in US_STATE_CODES)
    ):
        return "UNITED STATES"
    return "OTHERS"


def generated(pieces, n=3000):
    rng = random.Random(7)
    return [None] + ["".join(rng.choices(pieces, k=rng.randint(0, 4))) for _ in range(n)]


def test_license_restated(spark):
    pieces = ["ES", "es", "VT", "am", "Hm", "HM", "/", "1", "٣", "²", "①", "½", "a", "ñ", "ß", " "]
    values = generated([*pieces, "\n", "-", "Ⅷ", "漢"])
    assert apply(spark, values, classify.license_category) == [python_category(v) for v in values]


def test_country_restated(spark):
    rng = random.Random(8)
    names = [n.title() for n in COUNTRIES + US_STATES] + [" " + c for c in US_STATE_CODES]
    pieces = [*names, *["Calle ", ", ", " ", "\t", "x", "\u2003", "."] * 20]
    values = generated(pieces)
    rng.shuffle(values)
    assert apply(spark, values, classify.country_of) == [python_country(v) for v in values]


def test_digits_are_those_of_python():
    java_classes = re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", text.DIGITS_ONLY)
    beyond = {c for lo, hi in java_classes for c in range(int(lo, 16), int(hi, 16) + 1)}
    plain = re.sub(r"\\x\{\w+\}-?", "", text.DIGITS_ONLY)
    inside = plain[plain.index("}") + 1 : plain.index("]")]
    listed = {c for c in range(sys.maxunicode + 1) if re.match(f"[{inside}]", chr(c))} | beyond
    wanted = {c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit() and not c.isdecimal()}
    assert {chr(c) for c in listed} == wanted


def test_money_round_trip(spark):
    amounts = [0.0, 1.5, 1234.56, 9999999.99, -0.01]
    df = spark.createDataFrame([(a,) for a in amounts], "a double")
    written = F.concat(F.lit("$"), F.format_number("a", 2))
    rows = df.select("a", numbers.money_strict(written).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_strict_money_fails_on_text(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="not an amount"):
            apply(spark, ["$1", "on request"], numbers.money_strict)
        assert apply(spark, ["$1,000", None, "nan"], numbers.money_strict) == [1000.0, None, None]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_half_even(spark):
    values = ["0.5", "1.5", "2.5", "-2.5", "2.51"]
    rounded = apply(spark, values, lambda c: numbers.round_half_even(c.cast("double")))
    assert rounded == [0.0, 2.0, 2.0, -2.0, 3.0]


def test_small_text_functions(spark):
    assert apply(spark, ["2015-04-01", "2015", None], lambda c: text.first_part(c, "-")) == [
        "2015",
        "2015",
        None,
    ]
    assert apply(spark, ["a \t\n", "a\u00a0", " a b ", "\x1c"], text.strip_end) == [
        "a",
        "a",
        " a b",
        "",
    ]
    log = ["at https://a-1.example.org ok", "https://b.example.org https://c.example.org", "none"]
    pattern = r"https://[-a-z0-9]+\.example\.org"
    assert apply(spark, log, lambda c: text.first_match(c, pattern, "wait")) == [
        "https://a-1.example.org",
        "https://b.example.org",
        "wait",
    ]
    assert apply(spark, log, lambda c: text.first_match(c, pattern))[2] is None
    assert apply(
        spark, ["email", "work_email", "phone", None], lambda c: text.contains_any(c, ["email", "work_email"])
    ) == [True, True, False, None]


def test_missing_tokens(spark):
    assert apply(spark, ["", "NA", "n/a", "Na", " ", None], missing.tokens_to_null) == [
        None,
        None,
        None,
        "Na",
        " ",
        None,
    ]


def test_long_runs_of_space_and_digits_are_quick(spark):
    long = " " * 300_000 + "x"
    assert apply(spark, [long], text.strip_end) == [long]
    assert apply(spark, ["1" * 300_000 + "x"], numbers.money_lenient) == [None]

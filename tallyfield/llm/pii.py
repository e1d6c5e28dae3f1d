"""Personal data by bootstrapped contextual extraction.

Fixed rules find the seeds: e-mail addresses, IP addresses, card numbers, phone numbers. The words
beside a seed are lexical patterns (the word before, the word after, the two words before). Patterns and
instances form a graph: a pattern is as good as the share of its distinct instances that are known to be
of a kind, an instance as sure as the good patterns around it make it. After some rounds of scoring, the
surest patterns name further identifiers among what else stands in them: words with a digit or another
sign that plain words lack, and runs of groups of digits. How many digits those have, or how long they or
their contexts are, does not matter; only the graph decides.

All steps are DataFrame functions. Character positions come from splitting a text at the matches: gaps
and matches alternate, and a running sum of their lengths per text gives every start. Positions are code
points.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import BLANKS, stored

KINDS = ("email", "ip", "card", "phone")
# Possessive forms and look-behinds leave the leftmost matches as they are and make them linear: a run
# of characters is entered at its beginning, or where the match before ended, and never given back. A
# card pattern names just the chains of digits that have 16 to 19.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # What could be an identifier, the instances that patterns are tried on: a word with a digit, an @, a
    # bracket, a low line or an inner dot, and groups of digits with single blanks between.
    "word": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@\[\](){}_.]*+(?:[0-9@\[\](){}_]|\.(?=[\p{L}0-9]))[^\x20\x09-\x0D]*+",
    "run": r"(?<![^\x20\x09-\x0D])[+(]*+[0-9][0-9().-]*+(?:\x20[(]?+[0-9][0-9().-]*+)++(?![^\x20\x09-\x0D.,;:!?])",
}
OTHERS = ("word", "run")
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
ROUNDS = 3
LEAST_SEEDS = 3
GOOD_PATTERN = 0.5
SURE = 0.8
_TEXT = ["doc_id", "whole"]


def _last_words(text: Column) -> tuple[Column, Column]:
    """The last word of a text and the one before it, in time linear in the text."""
    flat = F.rtrim(F.translate(text, BLANKS, " " * len(BLANKS)))
    last = F.substring_index(flat, " ", -1)
    rest = F.rtrim(F.left(flat, F.length(flat) - F.length(last)))
    return last, F.substring_index(rest, " ", -1)


def _entries(kind: str) -> Column:
    """Matches of one kind, each with its place among them, the length of the gap before it, and the words
    beside it. Columns ``m_<kind>`` and ``g_<kind>`` hold matches and the gaps around them. Where little
    stands between matches, the two next matches count as words of the context."""
    matches, gaps = F.col(f"m_{kind}"), F.col(f"g_{kind}")
    at = lambda array, i: F.get(array, i.cast("int"))

    def entry(x: Column, i: Column) -> Column:
        before = F.concat_ws("", at(gaps, i - 2), at(matches, i - 2), at(gaps, i - 1), at(matches, i - 1), at(gaps, i))
        after = F.concat_ws("", at(gaps, i + 1), at(matches, i + 1), at(gaps, i + 2))
        last, second = _last_words(before)
        first = F.substring_index(F.ltrim(F.translate(after, BLANKS, " " * len(BLANKS))), " ", 1)
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), x.alias("value"), F.length(at(gaps, i)).alias("gap"),
            last.alias("before"), second.alias("second"), first.alias("after"),
        )

    return F.transform(matches, entry)


def _matched(plain: DataFrame) -> DataFrame:
    """Per text (doc_id, whole: its hash) all matches of all kinds, as one array."""
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = []
    for kind, pattern in PATTERNS.items():
        has = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else F.lit(True)
        # A text without the needed character gives no match either way.
        seen = F.when(has, text).otherwise(F.lit(""))
        columns.append(F.regexp_extract_all(seen, F.lit(pattern), F.lit(0)).alias(f"m_{kind}"))
        columns.append(F.split(seen, pattern, -1).alias(f"g_{kind}"))
    found = plain.select("doc_id", F.xxhash64("text").alias("whole"), *columns)
    return found.select(*_TEXT, F.flatten(F.array(*map(_entries, PATTERNS))).alias("entries"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int"))
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(kind: Column, value: Column) -> Column:
    """Whether a match of a kind is a seed."""
    digits = _digits(value)
    parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small)
        .when(kind == "card", luhn(digits))
        .when(kind == "phone", F.length(digits).between(8, 15))
        .otherwise(F.lit(False))
    )


def _placed(matched: DataFrame) -> DataFrame:
    """Each match with its start and end, once per distinct text of an id."""
    texts = matched.where(F.size("entries") > 0).groupBy(*_TEXT).agg(F.first("entries").alias("entries"))
    each = texts.select(*_TEXT, F.explode("entries").alias("e")).select(*_TEXT, "e.*")
    so_far = Window.partitionBy(*_TEXT, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(so_far)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    placed = placed.withColumn("seed", _passes(F.col("kind"), F.col("value")))
    return placed.where(F.col("seed") | F.col("kind").isin(*OTHERS)).drop("gap", "i")


def _contexts() -> Column:
    """Lexical patterns around a match: the word before, the two words before, the word after."""
    before, second, after = (F.lower(c) for c in ("before", "second", "after"))
    return F.array_compact(
        F.array(
            F.when(before != "", F.concat(F.lit("L "), before)),
            F.when(second != "", F.concat(F.lit("B "), second, F.lit(" "), before)),
            F.when(after != "", F.concat(F.lit("R "), after)),
        )
    )


def _apart(placed: DataFrame) -> DataFrame:
    """Words and runs that could be identifiers and touch no seed."""
    here = Window.partitionBy(*_TEXT).orderBy("start", "end")
    ended = F.max(F.when(F.col("seed"), F.col("end"))).over(here.rowsBetween(Window.unboundedPreceding, 0))
    coming = F.min(F.when(F.col("seed"), F.col("start"))).over(here.rowsBetween(0, Window.unboundedFollowing))
    marked = placed.withColumn("ended", ended).withColumn("coming", coming)
    # A sentence's punctuation at the end of a word is not part of the identifier.
    bare = F.regexp_replace("value", r"[.,;:!?]+$", "")
    alone = (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.col("end") <= F.coalesce("coming", "end"))
    words = marked.where(F.col("kind").isin(*OTHERS) & alone).withColumn("value", bare)
    return words.where("value <> ''").withColumn("end", F.col("start") + F.length("value"))


def _outermost(found: DataFrame) -> DataFrame:
    """Without the spans inside another one: a run's single groups of digits."""
    before = Window.partitionBy(*_TEXT).orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    return found.withColumn("reached", reached).where("end > reached").drop("reached")


def _learnt(seeds: DataFrame, words: DataFrame) -> DataFrame:
    """(value, kind) of the words that the pattern-instance graph makes sure of."""
    edge = lambda rows: rows.select("value", F.explode(_contexts()).alias("pattern"))
    edges = stored(edge(seeds).unionByName(edge(words)).distinct(), "pii-edges")
    totals = stored(edges.groupBy("pattern").agg(F.count("*").alias("instances")), "pii-totals")
    known = stored(seeds.select("value", "kind", F.lit(1.0).alias("score")).distinct(), "pii-known")
    unknown = words.select("value").distinct().join(known, "value", "left_anti")
    unknown = stored(unknown, "pii-unknown")
    scores = known
    found = None
    for _ in range(ROUNDS):
        weight = edges.join(scores, "value").groupBy("pattern", "kind").agg(
            F.sum("score").alias("weight"), F.count_if(F.col("score") >= SURE).alias("sure")
        )
        good = weight.join(totals, "pattern").select(
            "pattern", "kind", F.least(F.col("weight") / F.col("instances"), F.lit(0.99)).alias("good"), "sure"
        ).where((F.col("good") >= GOOD_PATTERN) & (F.col("sure") >= LEAST_SEEDS))
        doubt = F.exp(F.sum(F.log(1 - F.col("good"))))
        found = edges.join(unknown, "value").join(good, "pattern").groupBy("value", "kind").agg(
            (1 - doubt).alias("score")
        )
        found = stored(found, "pii-scores")
        scores = known.unionByName(found)
    best = found.where(F.col("score") >= SURE).groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b"))
    return best.select("value", F.col("b.kind").alias("kind"))


def _joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the number of seeds by kind (n_email, n_ip, n_card, n_phone),
    base_spans (the seeds) and spans (seeds and discoveries) as text, and n_found (discoveries).

    Spans are ordered by kind, then start. A NULL or empty text has none; repeated rows have equal
    results; rows that share an id, or have none, each have the results of their own text; a very long text
    is matched whole, in time linear in its length; an empty table gives no rows. Other columns of ``docs``
    are not looked at.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    matched = stored(_matched(plain), "pii-matches")
    placed = stored(_placed(matched), "pii-placed")
    seeds, words = placed.where("seed"), stored(_apart(placed), "pii-words")
    learnt = _learnt(seeds, words)
    number = functools.reduce(
        lambda c, k: c.when(F.col("kind") == KINDS[k], k), range(1, len(KINDS)), F.when(F.col("kind") == KINDS[0], 0)
    )
    columns = [*_TEXT, number.alias("k"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")]
    discovered = _outermost(words.drop("kind").join(learnt, "value").select(*columns).distinct())
    spans = seeds.select(*columns, F.lit(True).alias("base")).unionByName(discovered.withColumn("base", F.lit(False)))
    span = F.struct("k", "start", "end")
    counts = [F.count_if(F.col("base") & (F.col("k") == i)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    per_text = spans.groupBy(*_TEXT).agg(
        *counts, F.count_if(~F.col("base")).alias("n_found"),
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("b"), F.sort_array(F.collect_list(span)).alias("a"),
    )
    per_text = per_text.select(
        F.col("doc_id").alias("d"), F.col("whole").alias("w"), *[f"n_{k}" for k in KINDS], "n_found",
        _joined(F.col("b")).alias("base_spans"), _joined(F.col("a")).alias("spans"),
    )
    met = matched.select(*_TEXT).join(
        per_text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("whole") == F.col("w")), "left"
    )
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return met.select(
        "doc_id", *zero, F.coalesce("base_spans", F.lit("")).alias("base_spans"),
        F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"),
    )

"""Odd documents that every operator must take, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
# Names that operators use inside; a table may have columns of the same names.
CLASHES = (
    "size target taken score label held_out predicted node rep shard depth piece positive x row block "
    "start end kind value vector whole n hi lo sketch a b component kept doc position h1 h2 first last "
    "item_id n_shared bucket mix_id bad_id gone_id leak_id __hash __prefix shard_bytes again_id again text_hash order "
    "place found base spans key chunk a.b `c` mix_time mix_times mix_size mix_taken __row __id __time __key __part "
    "__rank __at __held __before __first __bytes __depth __same m r h t one"
).split()


def documents(spark: SparkSession, rows: list[tuple], clashes: bool = True) -> DataFrame:
    """(doc_id, text[, source]) as a documents table, with clashing columns."""
    rows = [(*r, *("src0", "en")[: 3 - len(r)]) if len(r) < 3 else r for r in rows]
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "doc_id long, text string, source string")
    df = df.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    if clashes:
        df = df.withColumns({c: F.lit("clash") for c in CLASHES})
        df = df.withColumn("a map", F.create_map(F.lit("k"), F.col("doc_id")))
    return df


LONG = " ".join(f"w{i % 977} v{i}" for i in range(30_000))
ODD_ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "b"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "b"),
    (3, None, None),
    (4, "", "a"),
    (5, " \t\n\x0b\x0c\r ", "b"),
    (None, "a text without an id but with several words in it", "a"),
    (None, None, None),
    (6, LONG, "a"),
    (7, LONG + " and a tail", "b"),
    (8, "one", "c"),
    (9, "One", "c"),
    (10, "one two", None),
    (11, "line of some length\nline of some length\n\nother line here", "a"),
    (12, "Line of some length \r\nanother line here\nline of some length", "b"),
    (12, "a second text of one id\nline of some length", "b"),
    (13, "\x00 odd   ünï cödé 😀 text with a nul and other spaces", "a"),
    (14, "x" * 200_000, "a"),
]


def odd(spark: SparkSession) -> DataFrame:
    return documents(spark, ODD_ROWS)


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, ODD_ROWS).where("false")


def words(text: str | None) -> list[bytes]:
    return [w.lower() for w in WORD.findall((text or "").encode())]


def shingles(text: str | None, width: int) -> set[tuple]:
    found = words(text)
    if not found:
        return set()
    width = min(width, len(found))
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def plain_components(rows: list[tuple], width: int, share: tuple[int, int]) -> dict[int, int]:
    """Smallest id each id reaches, by comparing all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for at, (i, a) in enumerate(sets):
        for j, b in sets[at + 1 :]:
            both = len(a & b)
            if a and b and share[1] * both >= share[0] * (len(a) + len(b) - both):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: root(i) for i in parent}


def plain_lines(rows: list[tuple], least: int = 10) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, sha256 of the kept text), by one pass over all lines."""
    key = lambda line: line.strip(b" \t\n\x0b\x0c\r").lower()
    owner: dict[bytes, float] = defaultdict(lambda: float("inf"))
    number = lambda i: float("inf") if i is None else i
    split = [(i, (t or "").encode().split(b"\n")) for i, t in rows]
    for i, lines in split:
        for line in lines:
            owner[key(line)] = min(owner[key(line)], number(i))
    result = []
    for i, lines in split:
        kept = [x for x in lines if len(key(x).decode()) < least or owner[key(x)] == number(i)]
        digest = hashlib.sha256(b"\n".join(kept)).hexdigest()
        result.append((i, len(lines), len(lines) - len(kept), digest))
    return result


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def plain_spans(text: str | None) -> list[str]:
    found = []
    for kind, pattern in BASE.items():
        for match in pattern.finditer(text or ""):
            value = match.group()
            digits = re.sub("[^0-9]", "", value)
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and _luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append(f"{kind}:{match.start()}:{match.end()}")
    return found


def in_fold(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def plain_personal_data(rows: list[tuple]) -> dict:
    """All spans per document, base and added, by one pass over a graph held in memory."""
    from tallyfield.llm import pii

    patterns = {kind: regex.compile(p) for kind, p in pii.PATTERNS.items() if kind in pii.OTHERS}
    places, edges, known = [], defaultdict(set), set()
    for doc, text in rows:
        seeds = [s.split(":") for s in plain_spans(text)]
        ends = [(int(a), int(b)) for _, a, b in seeds]
        known.update((text[int(a) : int(b)], k) for k, a, b in seeds)
        others = []
        for pattern in patterns.values():
            for m in pattern.finditer(text):
                if not any(a < m.end() and m.start() < b for a, b in ends):
                    value = re.sub("[.,;:!?]+$", "", m.group())
                    others.append((m.start(), m.start() + len(value), m.end()))
        whole = [(int(a), int(b), int(b)) for _, a, b in seeds] + others
        for start, end, last in whole:
            before, after = text[:start].lower().split(), text[last:].lower().split()
            value = text[start:end]
            edges[value].update([f"L {before[-1]}"] if before else [], [f"B {' '.join(before[-2:])}"] if len(before) > 1 else [])
            edges[value].update([f"R {after[0]}"] if after else [])
        places.append((doc, seeds, others, text))
    instances = defaultdict(int)
    for found in edges.values():
        for pattern in found:
            instances[pattern] += 1
    scores, seeded = {v: 1.0 for v in known}, {value for value, _ in known}
    for _ in range(pii.ROUNDS):
        weight, sure = defaultdict(float), defaultdict(int)
        for (value, kind), score in scores.items():
            for pattern in edges[value]:
                weight[pattern, kind] += score
                sure[pattern, kind] += score >= pii.SURE
        good = {k: min(w / instances[k[0]], 0.99) for k, w in weight.items() if sure[k] >= pii.LEAST_SEEDS}
        doubt = defaultdict(float)
        for value, found in edges.items():
            if value not in seeded:
                for (pattern, kind), share in good.items():
                    if pattern in found and share >= pii.GOOD_PATTERN:
                        doubt[value, kind] += math.log(1 - share)
        scores = {v: 1.0 for v in known} | {k: 1 - math.exp(d) for k, d in doubt.items()}
    best: dict = {}
    for (value, kind), score in scores.items():
        if value not in seeded and score >= pii.SURE:
            best[value] = max(best.get(value, (0, "")), (score, kind))
    result = {}
    for doc, seeds, others, text in places:
        found = sorted({(a, -b, best[text[a:b]][1]) for a, b, _ in others if text[a:b] in best})
        kept, reached = [], 0
        for a, b, kind in found:
            if -b > reached:
                kept.append((kind, a, -b))
            reached = max(reached, -b)
        every = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in [*seeds, *kept]]
        result[doc] = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(every))
    return result

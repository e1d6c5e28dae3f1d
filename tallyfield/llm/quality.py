"""Quality by a generalised additive model with pairwise interactions.

A text becomes some numbers (lengths, shares of kinds of characters, repetition). Each is cut into bins
at quantiles of the training rows. Boosting goes round the features in cycles: for each, a tree of at
most three leaves over its bins is fitted to the residuals and added, scaled down, to the feature's
look-up table. Then the pairs whose four-quadrant fit gains most are boosted likewise, each into a table
over two features' bins. A score is the sum of the looked-up values through a logistic curve.

The model is fitted on at most ``MOST_ROWS`` labelled rows, those with the smallest hash of their id.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import stored
from tallyfield.llm.labelled import first_by_hash, fold, label_of

MOST_ROWS = 20_000
BINS = 32
CYCLES = 120
PAIRS = 8
PAIR_CYCLES = 40
RATE = 0.15
RIDGE = 1.0

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
FEATURES = [
    "log_chars", "log_words", "word_length", "upper", "digits", "symbols", "exclamations", "bars",
    "distinct_words", "top_word", "adjacent_repeats", "distinct_lines", "line_length", "sentence_ends",
    "longest_word", "distinct_pairs", "compressed", "non_ascii",
]


def features(data: bytes | None) -> list[float]:
    """The numbers of one UTF-8 text; zeros if it has no words."""
    data = data or b""
    words = data.split()
    n, k = len(data), len(words)
    if k == 0:
        return [0.0] * len(FEATURES)
    share = lambda chars: (n - len(data.translate(None, chars))) / n
    counts = Counter(words)
    lines = data.split(b"\n")
    return [
        math.log1p(n), math.log1p(k), n / k, share(_UPPER), share(_DIGITS), share(_SYMBOLS),
        data.count(b"!") / k, data.count(b"|") / k, len(counts) / k, max(counts.values()) / k,
        sum(map(operator.eq, words, words[1:])) / k, len(set(lines)) / len(lines),
        math.log1p(n / len(lines)), sum(1 for w in words if w[-1] == 46) / k,
        math.log1p(max(map(len, counts))), len(set(zip(words, words[1:]))) / k if k > 1 else 1.0,
        len(zlib.compress(data, 1)) / n, 1 - len(data.decode("utf-8", "replace")) / n,
    ]


@dataclass
class AdditiveModel:
    """Bin edges, one table per feature, and one table per chosen pair."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.binned(x)
        total = np.full(len(x), self.base)
        for i, values in enumerate(self.tables):
            total += values[at[:, i]]
        for i, j, values in self.pairs:
            total += values[at[:, i], at[:, j]]
        return 1 / (1 + np.exp(-total))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins with summed residuals and weights."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    best = int(np.argmax(gain))
    return float(gain[best]), best + 1


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return RATE * g.sum() / (h.sum() + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with up to three leaves."""
    _, first = _cut(g, h)
    parts = [slice(0, first), slice(first, len(g))] if first else [slice(0, len(g))]
    gains = [_cut(g[p], h[p]) for p in parts]
    most = max(range(len(parts)), key=lambda i: gains[i][0])
    if gains[most][0] > 0:
        start = parts[most].start
        middle = start + gains[most][1]
        parts[most : most + 1] = [slice(start, middle), slice(middle, parts[most].stop)]
    values = np.zeros(len(g))
    for p in parts:
        values[p] = _leaf(g[p], h[p])
    return values


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values per cell of a tree that cuts one axis and then each half on the other."""
    best, values = 0.0, np.zeros(g.shape)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, first = _cut(a.sum(axis=1), b.sum(axis=1))
        found, gain = np.zeros(a.shape), -(a.sum() ** 2) / (b.sum() + RIDGE)
        for rows in (slice(0, first), slice(first, len(a))):
            _, middle = _cut(a[rows].sum(axis=0), b[rows].sum(axis=0))
            for columns in (slice(0, middle), slice(middle, a.shape[1])):
                p, q = a[rows, columns], b[rows, columns]
                found[rows, columns] = _leaf(p, q)
                gain += p.sum() ** 2 / (q.sum() + RIDGE)
        if gain > best:
            best, values = gain, found.T if turned else found
    return best, values


def fit(x: np.ndarray, y: np.ndarray, cycles: int = CYCLES, pairs: int = PAIRS) -> AdditiveModel:
    """A model of the chance of label 1. Without rows it says 0.5; with one label only, nearly that."""
    at = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, i], at)) if len(x) else np.zeros(0) for i in range(len(FEATURES))]
    mean = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(edges, math.log(mean / (1 - mean)), [np.zeros(len(e) + 1) for e in edges])
    if not len(x):
        return model
    bins = model.binned(x)
    total = np.full(len(y), model.base)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(cycles):
        for i, values in enumerate(model.tables):
            g, h = residuals()
            size = len(values)
            added = _tree(np.bincount(bins[:, i], g, size), np.bincount(bins[:, i], h, size))
            values += added
            total += added[bins[:, i]]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.tables[i]), len(model.tables[j])
        flat = bins[:, i] * shape[1] + bins[:, j]
        g, h = residuals()
        n = shape[0] * shape[1]
        return np.bincount(flat, g, n).reshape(shape), np.bincount(flat, h, n).reshape(shape)

    gains = {(i, j): _quadrants(*cells(i, j))[0] for i, j in itertools.combinations(range(len(FEATURES)), 2)}
    chosen = sorted(gains, key=lambda k: (-gains[k], k))[:pairs]
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for i, j in chosen]
    for _ in range(PAIR_CYCLES):
        for i, j, values in model.pairs:
            _, added = _quadrants(*cells(i, j))
            values += added
            total += added[bins[:, i], bins[:, j]]
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])


def _scored(model: AdditiveModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 3,
    held: int = 1,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (chance of label 1), predicted.

    Fitted on labelled rows whose fold is not ``held``. Only the text is an input. A NULL or empty text
    scores as one with all features 0; without an id a row is scored and not held out; repeated rows get
    equal scores; a very long text is scored whole; an empty table gives no rows; without labels every score is 0.5. Other columns of
    ``docs`` are not looked at.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    featured = stored(plain.mapInArrow(_featured, "doc_id long, x array<double>"), "quality-features")
    known = label_of(labels, label)
    train = featured.where(fold(F.col("doc_id"), folds) != held).join(known, F.col("doc_id") == F.col("label_id"))
    sample = first_by_hash(train, most_rows, "quality").withColumnRenamed("doc_id", "sample_id")
    # The bound holds for rows: one row per sampled id, and all in one order.
    rows = train.join(F.broadcast(sample), F.col("doc_id") == F.col("sample_id")).groupBy("doc_id")
    rows = rows.agg(F.min(F.struct("x", "label")).alias("r")).select("doc_id", "r.*").toArrow().sort_by("doc_id")
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    model = fit(x, np.array(rows.column("label").to_pylist(), float))
    scored = featured.mapInArrow(functools.partial(_scored, model), "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the rows that the classifier rejects. Rows of one id go if one of them is
    rejected; rows without an id stay."""
    name = parameters.get("doc_id", "doc_id")
    bad = quality_scores(docs, labels, **parameters).where("predicted = 0")
    bad = bad.select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs[name] == bad["bad_id"], "left_anti")

"""Toxicity by non-negative positive-unlabelled learning.

Known are some toxic texts (P) and texts of unknown kind (U); labels of other texts are used for nothing
but the class prior. With prior p, the risk of calling clean texts toxic is what U shows less p times
what P shows, and is kept from going below 0: where a batch drives it there, the step goes back. The
classifiers are linear, over the presence of words and beginnings of words, written in numpy; a few are
trained from different seeds and their margins averaged. The prior also places the cut between the two.
It is held between 0.0001 and 0.5: labels with more than half toxic get a prior that is too small.

P and U are bounded samples (``MOST_POSITIVE``, ``MOST_UNLABELLED`` documents, those with the smallest
hash of their id); whole texts of them are used, and every document is scored on its whole text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.labelled import first_by_hash, fold, label_of

MOST_POSITIVE = 3_000
MOST_UNLABELLED = 9_000
SPACE = 1 << 20
CHOSEN = 384
LEAST_DOCUMENTS = 3
STARTS = (4, 5, 6)
CLASSIFIERS = 3
EPOCHS = 20
BATCH = 512
RATE = 0.1
DECAY = 1e-4
_EDGES = ".,;:!?\"'()[]{}*#$%&-_"
_MOST_WORDS = 300_000


def word_features(word: str) -> set[int]:
    """Places of a lower-cased word and its beginnings in the hashed feature space."""
    word = word.strip(_EDGES)
    if not word:
        return set()
    parts = [f"={word}", *(f"^{word[:n]}" for n in STARTS if len(word) > n)]
    return {xxhash.xxh3_64_intdigest(p) % SPACE for p in parts}


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, set[int]] = {}
    for batch in batches:
        rows = []
        for text in batch.column(2).to_pylist():
            found: set[int] = set()
            for word in set((text or "").lower().split()):
                if word not in cache:
                    if len(cache) > _MOST_WORDS // 6:
                        cache.clear()
                    cache[word] = word_features(word)
                found |= cache[word]
            rows.append(sorted(found))
        columns = [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["positive", "doc_id", "x"])


@dataclass
class ToxicModel:
    """Weights of the chosen features, and the margin without any."""

    weights: dict[int, float]
    base: float

    def score(self, found: set[int]) -> float:
        margin = self.base + sum(self.weights[f] for f in found)
        return float(_chance(np.float64(margin)))


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _cut(margins: np.ndarray, prior: float) -> float:
    """Where unlabelled margins part: the prior says about how many are toxic, and the cut goes
    through the widest gap between half and twice that many."""
    ordered = np.sort(margins)
    n = len(ordered)
    start, end = int(n * (1 - 2 * prior)), min(n, int(np.ceil(n * (1 - prior / 2))) + 1)
    near = ordered[max(0, start) : end]
    if len(near) < 2:
        return 0.0
    widest = int(np.argmax(np.diff(near)))
    return float(near[widest] + near[widest + 1]) / 2


def _train(p: np.ndarray, u: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and base of one linear classifier, by Adam on the non-negative risk."""
    rng = np.random.default_rng(seed)
    w, first, second = (np.zeros(p.shape[1] + 1, np.float32) for _ in range(3))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(u))
        for start in range(0, len(order), BATCH):
            some_u = u[order[start : start + BATCH]].astype(np.float32)
            some_p = p[rng.integers(0, len(p), min(BATCH, len(p)))].astype(np.float32)
            s_p, s_u = (_chance(x @ w[1:] + w[0]) for x in (some_p, some_u))
            # The sigmoid loss of a margin is the other class's probability.
            slope_p, slope_u = s_p * (1 - s_p) / len(s_p), s_u * (1 - s_u) / len(s_u)
            negative = s_u.mean() - prior * s_p.mean()
            to_p = prior * slope_p
            if negative >= 0:
                d_p, d_u = -to_p - to_p, slope_u
            else:
                d_p, d_u = to_p, -slope_u
            grad = np.concatenate(([d_p.sum() + d_u.sum()], d_p @ some_p + d_u @ some_u)).astype(np.float32)
            grad[1:] += DECAY * w[1:]
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad**2
            w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[1:], float(w[0])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> ToxicModel:
    """A model from the feature sets of both samples; without toxic examples it finds nothing toxic."""
    prior = min(max(prior, 1e-4), 0.5)
    base = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return ToxicModel({}, base)
    in_p = np.bincount(np.concatenate(positive), minlength=SPACE)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=SPACE)
    share = (in_p + in_u) / (len(positive) + len(unlabelled))
    spread = np.sqrt(share * (1 - share) * (1 / len(positive) + 1 / len(unlabelled))) + 1e-12
    z = (in_p / len(positive) - in_u / len(unlabelled)) / spread
    z[(in_p < LEAST_DOCUMENTS) | (z < 2)] = 0
    chosen = np.argsort(-z, kind="stable")[:CHOSEN]
    chosen = chosen[z[chosen] > 0]
    if not len(chosen):
        return ToxicModel({}, base)
    place = np.full(SPACE, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        made = np.zeros((len(rows), len(chosen)), np.uint8)
        for i, row in enumerate(rows):
            at = place[row]
            made[i, at[at >= 0]] = 1
        return made

    p, u = matrix(positive), matrix(unlabelled)
    trained = [_train(p, u, prior, seed) for seed in range(CLASSIFIERS)]
    weights = np.mean([w for w, _ in trained], axis=0)
    cut = _cut(u.astype(np.float32) @ weights, prior)
    return ToxicModel(dict(zip(chosen.tolist(), weights.tolist(), strict=True)), -cut)


def _scored(model: ToxicModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = model.weights.keys()
    nothing: frozenset[int] = frozenset()
    cache: dict[str, frozenset[int]] = {}
    for batch in batches:
        scores = []
        for text in batch.column(1).to_pylist():
            found: set[int] = set()
            for word in set((text or "").lower().split()):
                has = cache.get(word)
                if has is None:
                    if len(cache) > _MOST_WORDS:
                        cache.clear()
                    has = cache[word] = frozenset(word_features(word) & known) or nothing
                if has:
                    found |= has
            scores.append(model.score(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    folds: int = 5,
    held: int = 0,
    most_positive: int = MOST_POSITIVE,
    most_unlabelled: int = MOST_UNLABELLED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (chance of label 1), predicted.

    Learnt from rows whose fold is not ``held``: toxic examples from the labels, unlabelled texts from
    all documents, the prior from the share of label 1 among labelled rows. Only the text is an input. A
    NULL or empty text has no features and scores the base; without an id a row is scored and not held
    out; repeated rows get equal scores; a very long text is scored whole; an empty table gives no rows; without toxic examples every score
    is below 0.5. Other columns of ``docs`` are not looked at.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    train = fold(F.col("doc_id"), folds) != held
    known = label_of(labels, label).withColumnRenamed("label_id", "doc_id").where(train)
    prior = known.agg(F.avg("label")).first()[0] or 0.0
    ids = plain.select("doc_id").where(train)
    # Bounded samples of ids, whose texts alone are read for them.
    p = first_by_hash(known.where("label = 1").select("doc_id"), most_positive, "positive")
    u = first_by_hash(ids, most_unlabelled, "unlabelled")
    sample = p.select("doc_id", F.lit(True).alias("positive")).unionByName(
        u.select("doc_id", F.lit(False).alias("positive"))
    )
    met = plain.join(F.broadcast(sample.distinct()), "doc_id")
    # The bound holds for rows: of several rows of an id the one with the smallest hash of its text.
    row = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r")
    texts = met.groupBy("positive", "doc_id").agg(row).select("positive", "doc_id", "r.text")
    # In one order, however the rows were dealt: the same sample gives the same model.
    rows = texts.mapInArrow(_collected, "positive boolean, doc_id long, x array<int>").toArrow()
    rows = rows.sort_by([("positive", "ascending"), ("doc_id", "ascending")])
    is_positive = rows.column("positive").to_pylist()
    sets = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in rows.column("x")]
    model = fit(
        [x for x, positive in zip(sets, is_positive, strict=True) if positive],
        [x for x, positive in zip(sets, is_positive, strict=True) if not positive],
        prior,
    )
    scored = plain.mapInArrow(functools.partial(_scored, model), "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

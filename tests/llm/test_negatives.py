"""Hard negatives against brute force; cover trees and their bounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import negatives as ng


def plain(rows, every=50, positives=5, n=3):
    """Rows (vec_id, label, vector) to the contract's result, by comparing all."""
    good = []
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        good.append((i, label, [math.floor(256 * x) for x in vector]))
    found = []
    for at, (i, label, v) in enumerate(good):
        if i % every:
            continue
        scored = sorted(
            ((-sum(a * b for a, b in zip(v, w, strict=True)), j, k, m) for k, (j, m, w) in enumerate(good) if k != at)
        )
        for p, j, _, m in [s for s in scored if s[3] == label][:positives]:
            fits = [(-s, k) for s, k, _, o in scored if o != label and 50 * -p <= 100 * -s <= 95 * -p]
            found += [(i, j, rank, k, -p, s) for rank, (s, k) in enumerate(fits[:n], 1)]
        del m
    return sorted(found)


def frame(spark, rows, clashes=True):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    names = ["row", "vector", "bucket", "cell", "block", "piece", "qid", "score", "rank", "low", "high", "reached", "found_id"]
    return df.withColumns({c: F.lit("clash") for c in names}) if clashes else df


def mined(spark, rows, **more):
    found = ng.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def clustered(n, size=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, size))
    rows = centres[rng.integers(0, 12, n)] + 0.2 * rng.standard_normal((n, size))
    return [(i, int(rng.integers(0, 4)), [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


def small_ints(n, seed=2):
    """Few distinct vectors: many ties."""
    rng = random.Random(seed)
    return [(i, rng.randrange(3), [rng.randrange(-2, 3) / 4 for _ in range(3)]) for i in range(n)]


@pytest.mark.parametrize("rows", [clustered(900), small_ints(700)])
@pytest.mark.parametrize("block_rows", [4_096, 40])
def test_as_by_brute_force(spark, rows, block_rows):
    assert mined(spark, rows, block_rows=block_rows) == plain(rows)


def test_a_hot_label_and_a_hot_vector(spark):
    rows = [(i, 1 if i % 3 else i % 11, v) for i, _, v in clustered(600, 6)]
    rows += [(i, i % 2, [0.5] * 6) for i in range(1_000, 1_400)]
    assert mined(spark, rows, block_rows=64) == plain(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(200, 4)
    rows += [
        (50, None, [1.0] * 4), (100, 1, None), (150, 1, [1.0, None, 1.0, 1.0]), (200, 1, [nan] * 4), (250, 1, [inf, 0.0, 0.0, 0.0]),
        (300, 1, [0.0] * 4), (350, 2, [-0.001] * 4), (0, 1, [0.25] * 4), (0, 1, [0.25] * 4), (None, 1, [1.0] * 4), (-50, 2, [0.5] * 4),
    ]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, [*rows, (400, 1, [1.0] * 3)]) == plain(rows)  # another length takes no part
    assert mined(spark, rows[:0]) == []
    assert mined(spark, [(0, 1, [1.0] * 4)]) == []
    with pytest.raises(ValueError, match="2\\*\\*53"):
        mined(spark, [(0, 1, [1e9] * 4), (1, 1, [1e9] * 4)])


def test_cover_tree_covers():
    rng = np.random.default_rng(3)
    points = ng.augmented(rng.standard_normal((3_000, 3)), 6.0)
    order, tree = ng.cover_tree(points)
    assert sorted(order.tolist()) == list(range(3_000))
    for centre, radius, parent, start, end, leaf in zip(*(tree[c] for c in ("centre", "radius", "parent", "start", "end", "leaf")), strict=True):
        members = order[start:end]
        assert centre in members
        assert np.sqrt(((points[members] - points[centre]) ** 2).sum(axis=1)).max() <= radius + 1e-12
        if parent >= 0:
            assert tree["start"][parent] <= start and end <= tree["end"][parent]
        assert leaf == (end - start <= ng.LEAF_ROWS or radius == 0)
    full = [i for i in range(len(tree["radius"])) if tree["parent"][i] >= 0]
    assert np.median(tree["radius"][full] / tree["radius"][tree["parent"][full]]) <= 0.5 + 1e-9


def test_bounds_hold_and_nodes_are_skipped():
    rng = np.random.default_rng(4)
    centres = 20 * rng.standard_normal((9, 4))
    vectors = np.floor(centres[rng.integers(0, 9, 4_000)] + rng.standard_normal((4_000, 4)))
    norm = float(np.sqrt((vectors**2).sum(axis=1).max()))
    points = ng.augmented(vectors, norm)
    order, tree = ng.cover_tree(points)
    queries = vectors[::40]
    least, most = ng.bounds(queries, points[tree["centre"]], tree["radius"], norm)
    scores = queries @ vectors[order].T
    for node, (start, end) in enumerate(zip(tree["start"], tree["end"], strict=True)):
        assert (scores[:, start:end].min(axis=1) >= least[:, node]).all()
        assert (scores[:, start:end].max(axis=1) <= most[:, node]).all()
    best = scores.max(axis=1)
    skipped = (most < best[:, None]) & tree["leaf"][None, :]
    assert skipped.sum() / (len(queries) * tree["leaf"].sum()) > 0.5

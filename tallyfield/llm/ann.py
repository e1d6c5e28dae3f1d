"""Nearest neighbours by stable projections of few dimensions, indexed by kd-trees.

Largest inner product becomes smallest distance by one more coordinate (the root of what a vector's
squared norm lacks to the largest) and by scaling queries to that norm. A 2-stable (Gaussian) projection
to m dimensions turns a distance d into d * sqrt(chi-square with m degrees of freedom). A kd-tree over
the projections yields leaves in ascending distance from a query's projection; their points are verified
on the original vectors, and the search stops as soon as the distance reached is so large that a point
nearer than the k-th found would have been met before with probability ``SURE``.

The upper levels of the kd-tree are laid out on a bounded sample: they deal vectors to cells, hence to
blocks of about ``BLOCK_ROWS`` that have a place in space, each with the lower levels as a tree of its own. A
query first visits the block whose box is nearest to its projection, which gives it a k-th found; then only
blocks whose boxes pass the same chi-square test against that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import stored

NEAREST = 20
DIMENSIONS = 8
SURE = 0.97
BLOCK_ROWS = 8_192
QUERY_ROWS = 8_192
LEAF_ROWS = 128
# The most cells, vectors sampled for each, and boxes that a task compares with queries at a time.
CELLS = 4_096
SAMPLED = 32
BOX_ROWS = 8_192
_AT_ONCE = 512
_INDEX = (
    "block long, box_low binary, box_high binary, rows binary, ids binary, vectors binary, low binary, high binary, starts binary"
)


def chi_square_quantile(share: float, degrees: int) -> float:
    """Where the chi-square distribution with an even number of degrees reaches ``share``."""
    def reached(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))

    low, high = 0.0, 1_000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if reached(middle) < share else (low, middle)
    return high


def _projection(size: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((size + 1, DIMENSIONS))


def kd_leaves(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> list[np.ndarray]:
    """Leaves of a kd-tree as arrays of row numbers: halves at the median place of the widest side, so
    that equal points part too."""
    leaves, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        if len(rows) <= leaf_rows:
            leaves.append(rows)
            continue
        part = points[rows]
        side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        middle = len(rows) // 2
        order = np.argpartition(part[:, side], middle)
        open_ += [rows[order[:middle]], rows[order[middle:]]]
    return leaves


def _vectors(table: pa.Table) -> np.ndarray:
    column = table.column("vector").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _projected(vectors: np.ndarray, norm: float) -> np.ndarray:
    lacking = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0))
    return np.column_stack([vectors, lacking]) @ _projection(vectors.shape[1])


def upper_levels(points: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Sides and places of the splits of a kd-tree with so many cells (a power of two): the children of
    split ``i`` are ``2 * i + 1`` and ``2 * i + 2``. A split is at the median of the widest side."""
    sides, places = np.zeros(cells - 1, np.int64), np.zeros(cells - 1)
    held = [points]
    for i in range(cells - 1):
        part = held[i]
        if len(part):
            sides[i] = np.argmax(part.max(axis=0) - part.min(axis=0))
            places[i] = np.median(part[:, sides[i]])
        right = part[:, sides[i]] >= places[i]
        held += [part[~right], part[right]]
    return sides, places


def cell_of(points: np.ndarray, sides: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The cell of each point: its way through the splits."""
    at = np.zeros(len(points), np.int64)
    while len(at) and at[0] < len(sides):
        at = 2 * at + 1 + (points[np.arange(len(points)), sides[at]] >= places[at])
    return at - len(sides)


def _index(norm: float, table: pa.Table) -> pa.Table:
    """The index of one block, as one row."""
    vectors, ids = _vectors(table), table.column("vec_id").to_numpy()
    projected = _projected(vectors, norm)
    leaves = kd_leaves(projected)
    order = np.concatenate(leaves)
    low = np.stack([projected[r].min(axis=0) for r in leaves])
    high = np.stack([projected[r].max(axis=0) for r in leaves])
    starts = np.cumsum([0, *map(len, leaves)]).astype(np.int64)
    rows = table.column("row").to_numpy()
    arrays = [low.min(axis=0), high.max(axis=0), rows[order], ids[order], vectors[order], low, high, starts]
    row = [table.column("block")[0].as_py(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]
    return pa.table({f.split()[0]: [v] for f, v in zip(_INDEX.split(", "), row, strict=True)})


def box_distance(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The squared distance of each point to each box."""
    bound = np.zeros((len(at), len(low)))
    for d in range(at.shape[1]):
        x = at[:, d, None]
        bound += np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0) ** 2
    return bound


class Query:
    """Queries on the scale of the candidates, and when their search may stop."""

    def __init__(self, queries: np.ndarray, norm: float, sure: float):
        self.scaled = norm / np.sqrt((queries**2).sum(axis=1))
        self.at = (queries * self.scaled[:, None]) @ _projection(queries.shape[1])[:-1]
        self.norm, self.limit = norm, chi_square_quantile(sure, DIMENSIONS)

    def goes_on(self, bound: np.ndarray, best: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether what is at least ``bound`` (squared, projected) away may matter beside the k-th found.
        Not strictly: points equal to the k-th found are at the same place and must be met."""
        kth = 2 * self.norm**2 - 2 * best * self.scaled[which]
        return ~(bound > self.limit * np.maximum(kth, 0))


class Block:
    """An index block opened for searching."""

    def __init__(self, row: dict, size: int):
        of = lambda name, kind, width: np.frombuffer(row[name], kind).reshape(-1, width)
        self.rows, self.ids = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
        self.vectors = of("vectors", np.float64, size)
        self.low, self.high = of("low", np.float64, DIMENSIONS), of("high", np.float64, DIMENSIONS)
        self.starts = np.frombuffer(row["starts"], np.int64)

    def search(self, own: np.ndarray, queries: np.ndarray, reached: np.ndarray, k: int, query: Query) -> np.ndarray:
        """Numbers of the k best found for each query (-1: none). ``own`` are the queries' own rows,
        ``reached`` the scores of what they found elsewhere."""
        bound = box_distance(query.at, self.low, self.high)
        order = np.argsort(bound, axis=1, kind="stable")
        best = np.full((len(queries), k), -np.inf)
        rows = np.full((len(queries), k), -1, np.int64)
        going = np.arange(len(queries))
        for step in range(order.shape[1]):
            leaf = order[going, step]
            go = query.goes_on(bound[going, leaf], np.maximum(best[going, -1], reached[going]), going)
            going, leaf = going[go], leaf[go]
            if not len(going):
                break
            for one in np.unique(leaf):
                here = going[leaf == one]
                start, end = self.starts[one], self.starts[one + 1]
                # Rounded, so that equal vectors tie whatever the order of summation.
                scores = np.round(queries[here] @ self.vectors[start:end].T, 12)
                scores[own[here][:, None] == self.rows[None, start:end]] = -np.inf
                better = scores.max(axis=1) >= np.maximum(best[here, -1], reached[here])
                here, scores = here[better], scores[better]
                if len(here):
                    pool = np.concatenate([best[here], scores], axis=1)
                    numbers = np.broadcast_to(np.arange(start, end), scores.shape)
                    pool_rows = np.concatenate([rows[here], numbers], axis=1)
                    pool_ids = np.where(pool_rows >= 0, self.ids[pool_rows], np.iinfo(np.int64).max)
                    chosen = np.lexsort((pool_ids, -pool), axis=1)[:, :k]
                    best[here] = np.take_along_axis(pool, chosen, 1)
                    found = np.take_along_axis(pool_rows, chosen, 1)
                    found[np.isneginf(best[here])] = -1
                    rows[here] = found
        return rows


_FOUND = "row long, query_id long, vec_id long, score double"


def _searched(norm: float, k: int, sure: float, index: pa.Table, queries: pa.Table) -> pa.Table:
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not index.num_rows or not queries.num_rows:
        return schema.empty_table()
    vectors, own, ids, reached = _vectors(queries), *(queries.column(c).to_numpy() for c in ("row", "vec_id", "reached"))
    block = Block(index.to_pylist()[0], vectors.shape[1])
    parts = []
    for start in range(0, len(ids), _AT_ONCE):
        some = slice(start, start + _AT_ONCE)
        rows = block.search(own[some], vectors[some], reached[some], k, Query(vectors[some], norm, sure))
        query, place = np.nonzero(rows >= 0)
        chosen = rows[query, place]
        # The score itself, summed in one fixed order.
        score = (vectors[some][query] * block.vectors[chosen]).sum(axis=1)
        parts.append(pa.table([own[some][query], ids[some][query], block.ids[chosen], score], schema=schema))
    return pa.concat_tables(parts)


def _routed(norm: float, sure: float, first: bool, queries: pa.Table, boxes: pa.Table) -> pa.Table:
    """The blocks each query visits: that of the nearest box, or all others whose boxes pass the test."""
    schema = pa.schema([("row", pa.int64()), ("block", pa.int64()), ("bound", pa.float64())])
    if not queries.num_rows or not boxes.num_rows:
        return schema.empty_table()
    low, high = (np.stack([np.frombuffer(x) for x in boxes.column(c).to_pylist()]) for c in ("box_low", "box_high"))
    numbers, parts = boxes.column("block").to_numpy(), []
    vectors, own = _vectors(queries), queries.column("row").to_numpy()
    for start in range(0, len(own), _AT_ONCE):
        some = slice(start, start + _AT_ONCE)
        query = Query(vectors[some], norm, sure)
        bound = box_distance(query.at, low, high)
        if first:
            who, block = np.arange(len(bound)), bound.argmin(axis=1)
        else:
            reached, visited = (queries.column(c).to_numpy()[some] for c in ("reached", "visited"))
            passes = query.goes_on(bound, reached[:, None], np.arange(len(bound))[:, None])
            who, block = np.nonzero(passes & (visited[:, None] != numbers[None, :]))
        parts.append(pa.table([own[some][who], numbers[block], bound[who, block]], schema=schema))
    return pa.concat_tables(parts)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(row, vec_id, vector: doubles) of the rows that take part."""
    doubles = F.col(vector).cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(finite, doubles).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.exists("vector", lambda x: x != 0))
    return rows.withColumn("row", F.monotonically_increasing_id())


def _explode_to(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def nearest(
    vectors: DataFrame,
    are_queries: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = NEAREST,
    sure: float = SURE,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query the ``k`` candidates with the largest inner
    product among those found, best first, ties to the smaller id. Queries are the rows for which
    ``are_queries`` (a condition on vec_id) holds; candidates all rows but the query's own.

    Vectors that are NULL, zero, or hold a NULL or a number that is not finite take no part, nor do those
    whose length is not the commonest one, nor rows without an id. Repeated rows, and rows that share an
    id, are queries and candidates of their own; an empty table gives no rows. Other columns are not looked
    at.
    """
    good = stored(usable(vectors, vec_id, vector), "ann-vectors")
    sizes = good.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    common = sizes.agg(F.max(F.struct("n", "size")).alias("m")).first()["m"]
    size, total = (common["size"], common["n"]) if common else (0, 0)
    if not total:
        return good.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    good = good.where(F.size("vector") == size)
    squared = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    norm = math.sqrt(good.agg(F.max(squared)).first()[0])

    # The upper levels of the tree, from a bounded sample: those with the smallest hashes, of the few below a
    # threshold.
    cells = min(CELLS, 1 << max(0, math.ceil(math.log2(total / block_rows))))
    drawn = F.pmod(F.xxhash64("row", F.lit("sample")), F.lit(1 << 40))
    wanted = cells * SAMPLED
    below = min(1 << 40, math.ceil((1 << 40) * 4 * wanted / total))
    sample = good.where(drawn < below).orderBy(drawn).limit(wanted).select("vector").toArrow()
    points = _projected(_vectors(sample), norm) if sample.num_rows else np.zeros((0, DIMENSIONS))
    sides, places = upper_levels(points, cells)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = cell_of(_projected(_vectors(pa.table(batch)), norm), sides, places)
                yield batch.append_column("cell", pa.array(cell))

    placed = good.select("row", "vec_id", "vector").mapInArrow(celled, "row long, vec_id long, vector array<double>, cell long")
    placed = stored(placed, "ann-cells")
    # At most CELLS rows. Equal vectors share a cell, whose rows are then dealt to pieces by a hash.
    held = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block_rows)).alias("pieces"))
    piece = F.pmod(F.xxhash64("row", F.lit("piece")), F.col("pieces"))
    dealt = placed.join(F.broadcast(held), "cell").withColumn("block", F.col("cell") * F.lit(1 << 32) + piece)

    def indexed(rows: pa.Table) -> pa.Table:
        return _index(norm, rows)

    dealt = dealt.select("block", "row", "vec_id", "vector")
    index = stored(dealt.groupBy("block").applyInArrow(indexed, _INDEX), "ann-index")
    asked = good.where(are_queries)
    n_queries, n_blocks = asked.count(), index.count()
    groups, parts = max(1, math.ceil(n_queries / query_rows)), max(1, math.ceil(n_blocks / BOX_ROWS))
    boxes = index.select("block", "box_low", "box_high").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
    boxes = boxes.withColumn("group", _explode_to(groups))
    group = F.pmod(F.xxhash64("row", F.lit("query")), F.lit(groups))

    def routes(queries: DataFrame, first: bool) -> DataFrame:
        def routed(left: pa.Table, right: pa.Table) -> pa.Table:
            return _routed(norm, sure, first, left, right)

        left = queries.withColumn("group", group).withColumn("part", _explode_to(parts))
        met = left.groupBy("group", "part").cogroup(boxes.groupBy("group", "part"))
        return met.applyInArrow(routed, "row long, block long, bound double")

    def visited(queries: DataFrame, to: DataFrame) -> DataFrame:
        def searched(left: pa.Table, right: pa.Table) -> pa.Table:
            return _searched(norm, k, sure, left, right)

        visits = stored(to.select("row", "block").join(queries, "row").withColumn("group", group), "ann-visits")
        places = visits.select(F.col("block").alias("visited_block"), F.col("group").alias("visitors")).distinct()
        met = index.join(places, F.col("block") == F.col("visited_block")).groupBy("visited_block", "visitors")
        return met.cogroup(visits.groupBy("block", "group")).applyInArrow(searched, _FOUND)

    fresh = asked.select("row", "vec_id", "vector", F.lit(float("-inf")).alias("reached"))
    start = routes(fresh, True).groupBy("row").agg(F.min_by("block", F.struct("bound", "block")).alias("block"))
    start = stored(start, "ann-first-blocks")
    found = stored(visited(fresh, start), "ann-first")
    kth = found.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    going = fresh.drop("reached").join(start.withColumnRenamed("block", "visited"), "row").join(kth, "row", "left")
    # A little lower, as the scores compared with it are rounded.
    going = going.withColumn("reached", F.coalesce(F.col("kth") - 1e-11, F.lit(float("-inf")))).drop("kth")
    going = stored(going, "ann-going")
    every = found.unionByName(visited(going, routes(going, False)))
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

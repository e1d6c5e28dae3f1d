"""Hard negatives by cover trees over norm-augmented candidates.

One more coordinate (the root of what a vector's squared norm lacks to the largest) puts all candidates on
one sphere, where the nearest to a query is the one with the largest inner product. A cover tree halves its
covering radius from level to level; the angle between a query and a node's centre, give or take the angle
of the covering radius, bounds the inner products below a node on both sides. A search descends best first:
nodes outside the wanted window, or below the k-th best found, are skipped, leaves are verified exactly.

Candidates are dealt to blocks of bounded size, by label and by the nearest of some sampled centres, each
with a tree of its own. A query first visits the block with the highest bound, which gives it a k-th best;
then all other blocks that its window and this bound do not rule out. Everything is exact: the sample
decides only which rows share a block.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import stored

POSITIVES = 5
NEGATIVES = 3
BLOCK_ROWS = 4_096
QUERY_ROWS = 4_096
SUMMARY_ROWS = 4_096
CENTRES = 1_024
LABEL_BUCKETS = 64
LEAF_ROWS = 256
BRANCHES = 32
EXACT = float(1 << 53)

_INDEX = (
    "block long, bucket long, centre binary, radius double, rows binary, ids binary, labels binary, vectors binary, "
    "centres binary, radii binary, parents binary, starts binary, ends binary"
)


def augmented(vectors: np.ndarray, norm: float) -> np.ndarray:
    """The vectors with one more coordinate, so that all have length ``norm``."""
    lacking = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0))
    return np.column_stack([vectors, lacking])


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the points and the nodes of a cover tree in it, parents first: centre (a point's
    number), covering radius, parent (-1: root), first and last place, and whether it is a leaf.

    A node's children are centres that cover its points within half its radius, the farthest uncovered
    point first; where ``BRANCHES`` do not suffice, points go to the nearest and radii are what they are.
    """
    order = np.arange(len(points))
    nodes, open_ = [], [(0, len(points), 0, -1)]
    while open_:
        start, end, centre, parent = open_.pop()
        members = order[start:end]
        away = np.sqrt(((points[members] - points[centre]) ** 2).sum(axis=1))
        radius = float(away.max())
        nodes.append((centre, radius, parent, start, end, end - start <= LEAF_ROWS or radius == 0))
        if nodes[-1][-1]:
            continue
        centres, nearest, owner = [centre], away, np.zeros(len(members), np.int64)
        while len(centres) < BRANCHES and nearest.max() > radius / 2:
            farthest = int(members[int(nearest.argmax())])
            from_it = np.sqrt(((points[members] - points[farthest]) ** 2).sum(axis=1))
            owner = np.where(from_it < nearest, len(centres), owner)
            nearest = np.minimum(nearest, from_it)
            centres.append(farthest)
        by_owner = np.argsort(owner, kind="stable")
        order[start:end] = members[by_owner]
        edges = start + np.searchsorted(owner[by_owner], np.arange(len(centres) + 1))
        me = len(nodes) - 1
        open_ += [(int(a), int(b), c, me) for c, a, b in zip(centres, edges[:-1], edges[1:], strict=True) if b > a]
    names = ("centre", "radius", "parent", "start", "end", "leaf")
    return order, dict(zip(names, map(np.array, zip(*nodes, strict=True)), strict=True))


def bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product of each query with what is within each radius of each
    centre on the sphere, with room for rounding."""
    length = np.sqrt((queries**2).sum(axis=1))[:, None]
    room = 1e-6 * length * norm + 1e-6
    scale = np.maximum(length * norm, 1e-300)
    angle = np.arccos(np.clip(queries @ centres[:, :-1].T / scale, -1, 1))
    wide = 2 * np.arcsin(np.clip(radii * (1 + 1e-9) / (2 * max(norm, 1e-300)), 0, 1))[None, :]
    low = length * norm * np.cos(np.minimum(angle + wide, np.pi))
    high = length * norm * np.cos(np.maximum(angle - wide, 0))
    return low - room, high + room


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _index(norm: float, table: pa.Table) -> pa.Table:
    """One block with its tree, as one row."""
    vectors = _vectors(table.column("vector"))
    points = augmented(vectors, norm)
    order, tree = cover_tree(points)
    ints = {c: table.column(c).to_numpy()[order] for c in ("row", "vec_id", "label")}
    first = {c: table.column(c)[0].as_py() for c in ("block", "bucket")}
    centres = points[tree["centre"]]
    ends = np.where(tree["leaf"], tree["end"], -tree["end"] - 1)
    arrays = [*ints.values(), vectors[order], centres, tree["radius"], tree["parent"], tree["start"], ends]
    row = [*first.values(), centres[0].tobytes(), float(tree["radius"][0]), *(np.ascontiguousarray(a).tobytes() for a in arrays)]
    names = [f.split()[0] for f in _INDEX.split(", ")]
    return pa.table({n: [v] for n, v in zip(names, row, strict=True)})


class Block:
    """A block opened for searching."""

    def __init__(self, row: dict, size: int, norm: float):
        self.norm = norm
        self.rows, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"]).reshape(-1, size)
        self.centres = np.frombuffer(row["centres"]).reshape(-1, size + 1)
        self.radii = np.frombuffer(row["radii"])
        self.parents, self.starts, ends = (np.frombuffer(row[c], np.int64) for c in ("parents", "starts", "ends"))
        self.leaf = ends >= 0
        self.ends = np.where(self.leaf, ends, -ends - 1)

    def search(self, q: dict[str, np.ndarray], k: int, same: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row number, score) of the k best of each query's window in this block."""
        vectors, low, high, reached = q["vector"], q["low"], q["high"], q["reached"].copy()
        least, most = bounds(vectors, self.centres, self.radii, self.norm)
        seen = (least <= high[:, None]) & (most >= np.maximum(low, reached)[:, None])
        for node in range(1, len(self.parents)):  # parents stand before their children
            seen[:, node] &= seen[:, self.parents[node]]
        seen &= self.leaf[None, :]
        best_first = np.argsort(np.where(seen, -most, np.inf), axis=1, kind="stable")
        n_seen = seen.sum(axis=1)
        scores = np.full((len(vectors), k), -np.inf)
        places = np.full((len(vectors), k), -1, np.int64)
        going = np.flatnonzero(n_seen)
        for step in range(int(n_seen.max(initial=0))):
            going = going[step < n_seen[going]]
            leaf = best_first[going, step]
            # Strictly below: an equal score with a smaller id may be in there.
            on = most[going, leaf] >= reached[going]
            going, leaf = going[on], leaf[on]
            if not len(going):
                break
            for one in np.unique(leaf):
                here = going[leaf == one]
                start, end = self.starts[one], self.ends[one]
                found = vectors[here] @ self.vectors[start:end].T
                fits = (self.labels[None, start:end] == q["label"][here, None]) == same
                fits &= self.rows[None, start:end] != q["row"][here, None]
                fits &= (found >= np.maximum(low, reached)[here, None]) & (found <= high[here, None])
                any_ = fits.any(axis=1)
                here, found = here[any_], np.where(fits, found, -np.inf)[any_]
                if not len(here):
                    continue
                pool = np.concatenate([scores[here], found], axis=1)
                numbers = np.concatenate([places[here], np.broadcast_to(np.arange(start, end), found.shape)], axis=1)
                ids = np.where(numbers >= 0, self.ids[numbers], np.iinfo(np.int64).max)
                chosen = np.lexsort((ids, -pool), axis=1)[:, :k]
                scores[here] = np.take_along_axis(pool, chosen, 1)
                places[here] = np.where(np.isneginf(scores[here]), -1, np.take_along_axis(numbers, chosen, 1))
                reached[here] = np.maximum(reached[here], scores[here, -1])
        query, rank = np.nonzero(places >= 0)
        return query, places[query, rank], scores[query, rank]


_QUERY = ["qid", "row", "label", "low", "high", "reached"]


def _opened(queries: pa.Table) -> dict[str, np.ndarray]:
    return {c: queries.column(c).to_numpy() for c in _QUERY} | {"vector": _vectors(queries.column("vector"))}


def _searched(norm: float, k: int, same: bool, index: pa.Table, queries: pa.Table) -> pa.Table:
    schema = pa.schema([("qid", pa.int64()), ("found_row", pa.int64()), ("found_id", pa.int64()), ("score", pa.int64())])
    if not index.num_rows or not queries.num_rows:
        return schema.empty_table()
    q = _opened(queries)
    block = Block(index.to_pylist()[0], q["vector"].shape[1], norm)
    query, place, score = block.search(q, k, same)
    return pa.table([q["qid"][query], block.rows[place], block.ids[place], score.astype(np.int64)], schema=schema)


def _routed(norm: float, same: bool, first: bool, queries: pa.Table, blocks: pa.Table) -> pa.Table:
    """The blocks that may hold something for each query: the one with the highest bound, or all."""
    schema = pa.schema([("qid", pa.int64()), ("block", pa.int64()), ("bound", pa.float64())])
    if not queries.num_rows or not blocks.num_rows:
        return schema.empty_table()
    q = _opened(queries)
    centres = np.stack([np.frombuffer(c) for c in blocks.column("centre").to_pylist()])
    numbers = blocks.column("block").to_numpy()
    least, most = bounds(q["vector"], centres, blocks.column("radius").to_numpy(), norm)
    fits = (least <= q["high"][:, None]) & (most >= np.maximum(q["low"], q["reached"])[:, None])
    if same:
        fits &= queries.column("bucket").to_numpy()[:, None] == blocks.column("bucket").to_numpy()[None, :]
    if first:
        most = np.where(fits, most, -np.inf)
        query = np.flatnonzero(fits.any(axis=1))
        block = most[query].argmax(axis=1)
    else:
        fits &= queries.column("visited").to_numpy()[:, None] != numbers[None, :]
        query, block = np.nonzero(fits)
    return pa.table([q["qid"][query], numbers[block], most[query, block]], schema=schema)


class _Candidates:
    """All candidates in blocks of cover trees, and the searches over them."""

    def __init__(self, rows: DataFrame, block_rows: int):
        """``rows``: row, vec_id, label, vector (whole numbers as doubles)."""
        sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
        common = sizes.agg(F.max(F.struct("n", "size")).alias("m")).first()["m"]
        self.size, self.total = (common["size"], common["n"]) if common else (0, 0)
        self.rows = rows.where(F.size("vector") == self.size)
        if not self.total:
            return
        squared = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
        largest = self.rows.agg(F.max(squared)).first()[0]
        if largest >= EXACT:
            raise ValueError("inner products beyond 2**53 are not exact in double precision")
        self.norm = math.sqrt(largest)
        bucket = F.pmod(F.xxhash64("label"), F.lit(LABEL_BUCKETS))
        self.rows = self.rows.withColumn("bucket", bucket)
        most = self.rows.groupBy("bucket").count().agg(F.max("count")).first()[0]
        wanted = min(CENTRES, math.ceil(most / block_rows))
        # Few rows of a partition pass the threshold, so little is sorted for the sample.
        drawn = F.pmod(F.xxhash64("row", F.lit("centre")), F.lit(1 << 40))
        threshold = min(1 << 40, math.ceil((1 << 40) * 8 * (wanted + 8) / self.total))
        sample = self.rows.where(drawn < threshold).orderBy(drawn).limit(wanted).select("vector").toArrow()
        if not sample.num_rows:
            sample = self.rows.limit(1).select("vector").toArrow()
        centres = augmented(_vectors(sample.column("vector")), self.norm)
        norm = self.norm

        def dealt(batches):
            for batch in batches:
                if batch.num_rows:
                    points = augmented(_vectors(pa.table(batch).column("vector")), norm)
                    cell = (points @ centres.T).argmax(axis=1)  # all have one length: the nearest
                    yield batch.append_column("cell", pa.array(cell.astype(np.int64)))

        placed = self.rows.select("row", "vec_id", "label", "bucket", "vector").mapInArrow(
            dealt, "row long, vec_id long, label long, bucket long, vector array<double>, cell long"
        )
        placed = stored(placed, "negatives-cells")
        # At most LABEL_BUCKETS * CENTRES rows.
        held = placed.groupBy("bucket", "cell").agg(F.ceil(F.count("*") / F.lit(block_rows)).alias("pieces"))
        piece = F.pmod(F.xxhash64("row", F.lit("piece")), F.col("pieces"))
        number = (F.col("bucket") * CENTRES + F.col("cell")) * F.lit(1 << 32) + piece
        blocks = placed.join(F.broadcast(held), ["bucket", "cell"]).withColumn("block", number)

        def indexed(table: pa.Table) -> pa.Table:
            return _index(norm, table)

        blocks = blocks.select("block", "bucket", "row", "vec_id", "label", "vector")
        self.index = stored(blocks.groupBy("block").applyInArrow(indexed, _INDEX), "negatives-index")

    def _route(self, queries: DataFrame, n_queries: int, same: bool, first: bool) -> DataFrame:
        norm = self.norm

        def routed(left: pa.Table, right: pa.Table) -> pa.Table:
            return _routed(norm, same, first, left, right)

        blocks = self.index.select("block", "bucket", "centre", "radius")
        n_blocks = blocks.count()
        parts, groups = max(1, math.ceil(n_blocks / SUMMARY_ROWS)), max(1, math.ceil(n_queries / QUERY_ROWS))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = queries.withColumn("group", F.pmod(F.xxhash64("qid"), F.lit(groups))).withColumn("part", each(parts))
        right = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts))).withColumn("group", each(groups))
        met = left.groupBy("group", "part").cogroup(right.groupBy("group", "part"))
        return met.applyInArrow(routed, "qid long, block long, bound double")

    def _visit(self, queries: DataFrame, routes: DataFrame, n_queries: int, k: int, same: bool) -> DataFrame:
        norm = self.norm

        def searched(left: pa.Table, right: pa.Table) -> pa.Table:
            return _searched(norm, k, same, left, right)

        groups = max(1, math.ceil(n_queries / QUERY_ROWS))
        asked = routes.select("qid", "block").join(queries, "qid").withColumn("group", F.pmod(F.xxhash64("qid"), F.lit(groups)))
        asked = stored(asked, "negatives-visits")
        visits = asked.select(F.col("block").alias("visited_block"), F.col("group").alias("visitors")).distinct()
        index = self.index.join(visits, F.col("block") == F.col("visited_block"))
        met = index.groupBy("visited_block", "visitors").cogroup(asked.groupBy("block", "group"))
        return met.applyInArrow(searched, "qid long, found_row long, found_id long, score long")

    def best(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(qid, rank, found_row, found_id, score): the k best of every query's window. ``queries``: qid, row,
        label, bucket, vector, low, high (doubles)."""
        ranked = Window.partitionBy("qid").orderBy(F.col("score").desc(), "found_id", "found_row")
        n_queries = queries.count()
        fresh = queries.withColumn("reached", F.lit(float("-inf")))
        routes = self._route(fresh, n_queries, same, True).groupBy("qid").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
        routes = stored(routes, "negatives-routes")
        found = stored(self._visit(fresh, routes, n_queries, k, same), "negatives-first")
        # What the first block gave: the k-th best, if there are as many.
        kth = found.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("kth"))
        seen = queries.join(routes.withColumnRenamed("block", "visited"), "qid").join(kth, "qid", "left")
        seen = stored(seen.withColumn("reached", F.coalesce("kth", F.lit(float("-inf")))).drop("kth"), "negatives-seen")
        rest = self._visit(seen, self._route(seen, n_queries, same, False), n_queries, k, same)
        every = found.unionByName(rest).withColumn("rank", F.row_number().over(ranked))
        return stored(every.where(F.col("rank") <= k), "negatives-best")


def usable(table: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(row, vec_id, label, vector) of the rows that take part, each component scaled and floored."""
    doubles = F.col(vector).cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(doubles, lambda x: F.floor(x * float(scale)).cast("double"))
    rows = table.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.when(finite, whole).alias("vector")
    )
    rows = rows.where("vec_id is not null and label is not null and vector is not null")
    return rows.withColumn("row", F.monotonically_increasing_id())


def hard_negatives(
    table: DataFrame,
    are_anchors: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    share: tuple[int, int] = (50, 95),
    scale: int = 256,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of the vectors with every component times ``scale`` rounded down. Anchors are
    the rows for which ``are_anchors`` (a condition on vec_id) holds. An anchor's positives are the
    ``positives`` other rows of its label with the highest scores; for each of them the ``negatives`` rows of
    other labels with the highest scores between ``share`` percent of the positive's. Ties go to the
    smaller vec_id.

    Rows without an id, label or vector, with a NULL or a number that is not finite in the vector, or a
    vector whose length is not the commonest one take no part. Repeated rows are rows of their own, as are
    rows that share an id. Vectors so long that scores would pass 2**53 raise an error. An empty table gives
    no rows; other columns are not looked at.
    """
    rows = stored(usable(table, vec_id, vector, label, scale), "negatives-rows")
    candidates = _Candidates(rows, block_rows)
    if not candidates.total:
        return table.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    anchors = candidates.rows.where(are_anchors).select("row", "vec_id", "label", "bucket", "vector")
    anything = [F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")]
    asked = anchors.select(F.col("row").alias("qid"), "row", "label", "bucket", "vector", *anything)
    near = candidates.best(asked, positives, True)
    # Below 0 a window ends before it begins.
    windows = near.where("score >= 0").select(
        F.col("qid").alias("row"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.expr(f"cast(({share[0]} * score + 99) div 100 as double)").alias("low"),
        F.expr(f"cast({share[1]} * score div 100 as double)").alias("high"),
    ).where("low <= high")
    windows = stored(windows.join(anchors, "row").withColumn("qid", F.monotonically_increasing_id()), "negatives-windows")
    far = candidates.best(windows.select("qid", "row", "label", "bucket", "vector", "low", "high"), negatives, False)
    named = windows.select("qid", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score")
    return far.join(named, "qid").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )

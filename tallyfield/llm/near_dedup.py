"""Near-duplicate documents by a chosen-path set similarity join.

Documents with equal shingle sets are one class from the start. Every class has a sketch of minwise
values. A tree starts with all classes in one node; a node branches on chosen coordinates of the
sketch, and a child holds the members that have the same minwise value there. Nodes of up to ``SMALL``
members are compared exhaustively, inside one task and on sketches. A larger node first compares all
members with its hub, the member that agrees most with the node; what is like the hub is one group and
is not compared again, so a group of near copies closes in one linear step. Up to ``FEW`` members unlike
the hub are compared with the whole node, in blocks of bounded size; only if there are more does the node
branch on, always on ``BRANCHES`` coordinates. Independent trees repeat the search.

What the trees find alike forms candidate clusters. The texts of clusters are fetched once, and links
are confirmed on the full sets: within a cluster by its hub first, then for the members that the hub
does not link, by what their sets differ in from the hub's. (Two members that both differ little from
the hub differ in little from each other, so short difference sets stand for the full ones, exactly.)
Members already joined are not compared, and no pair leaves a task but those that join something.

Recall: where no node has more than ``FEW`` members unlike its hub, similar documents (J >= s) are missed
only if none of ``TREES * BRANCHES`` coordinates agrees, (1 - s) ** 12 = 1e-10 at 0.85 and 4e-9 at 0.8.
Through any number of further branchings the share missed is at most ``missed(s)``: 1.5e-7 at 0.85, 7.5e-6
at 0.8. Besides, sketches agree in too few places to be compared further for 1.5e-7 (0.85) or 1.2e-6 (0.8)
of the pairs at just s. These are reckoned, not measured. No false link is made.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import quoted, stored, whole_row
from tallyfield.llm.components import components
from tallyfield.llm.shingles import common, multipliers, shingle_set

SKETCH = 64
TREES, BRANCHES = 6, 2
SMALL = 1_000
# The most members unlike the hub that are compared with their whole node: dearer per row than to branch
# only above it. They and the node are cut into blocks of about ``BLOCK`` members.
FEW = 20_000
BLOCK = 8_000
# The largest cluster that one task confirms, in members and in shingles.
CLUSTER_MEMBERS = 4_000
CLUSTER_SHINGLES = 3_000_000
# Elements of difference sets in one block of a larger cluster.
BLOCK_ELEMENTS = 1_000_000
SAMPLED = 16
# Below the wanted similarity by so much, an estimate on 64 coordinates is not a candidate: over
# five standard deviations.
SLACK = 0.25
MOST_ROUNDS = 40
SPARK_SEED = 42  # fixed value: the seed of Spark's xxhash64

_SIGNATURE = "doc_id long, whole long, n int, hi long, lo long, sketch array<int>"


def missed(s: float) -> float:
    """The share of pairs of similarity s that no tree brings together, over any number of branchings.

    Of a node that holds a pair, each of the two children holds it where the chosen coordinate agrees. In
    k of ``SKETCH`` coordinates agreeing, the pair dies out below a node with the smallest probability q
    that satisfies q = (1 - p + p q) ** 2 with p = k / SKETCH. The first nodes have coordinates of
    their own, the others any.
    """
    starts = TREES * BRANCHES
    chance = lambda n, k: math.comb(n, k) * s**k * (1 - s) ** (n - k)
    dies = [min(1.0, ((SKETCH - k) / k) ** 2) if k else 1.0 for k in range(SKETCH + 1)]
    return sum(
        chance(starts, h) * chance(SKETCH - starts, r) * dies[h + r] ** h
        for h in range(starts + 1) for r in range(SKETCH - starts + 1)
    )


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def sketch_of(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest of each re-hash of the set, as 32-bit integers."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2_048):
        part = np.multiply.outer(factors, shingles[start : start + 2_048])
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signatures(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = multipliers(SKETCH, 1)
    for batch in batches:
        whole, sizes, high, low, sketches = [], [], [], [], []
        for value in batch.column(1).cast(pa.binary()):
            text = value.as_py()
            found = shingle_set(text, width)
            digest = xxhash.xxh3_128_intdigest(found.tobytes())
            whole.append(_signed(xxhash.xxh64_intdigest(text or b"", SPARK_SEED)))
            sizes.append(len(found))
            high.append(_signed(digest >> 64))
            low.append(_signed(digest & (1 << 64) - 1))
            sketches.append(sketch_of(found, factors))
        flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int32)
        at = np.arange(len(sizes) + 1, dtype=np.int32) * SKETCH
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(whole, pa.int64()), pa.array(sizes, pa.int32()),
                pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
            ],
            ["doc_id", "whole", "n", "hi", "lo", "sketch"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), SKETCH)


class _Groups:
    """Union-find over the members of one task's group."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)

    def links(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """One link for each member but the first of its group."""
        for i in range(len(ids)):
            if (j := self.root(i)) != i and ids[i] != ids[j]:
                yield ids[j], ids[i]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with one value in the first column, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        starts = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
        for start, end in zip(starts, starts[1:], strict=False):
            if held and keys[start] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = keys[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _link_batches(links: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(links, 20_000)):
        arrays = [pa.array([x[i] for x in part], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])


def _alike_in(rows: pa.Table, least: int, share: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """Links that join the likely pairs of one node; rows under one label are joined from the start."""
    ids = rows.column("rep").to_pylist()
    sizes = rows.column("n").to_numpy()
    sketches = _matrix(rows.column("sketch").combine_chunks())
    groups, first = _Groups(len(ids)), {}
    for i, label in enumerate(rows.column("label").to_pylist()):
        if label is not None:
            groups.join(i, first.setdefault(label, i))
    for start in range(0, len(ids), 64):
        part = slice(start, start + 64)
        agree = (sketches[part, None, :] == sketches[None, start:, :]).sum(axis=2)
        low, high = np.minimum(sizes[part, None], sizes[None, start:]), np.maximum(sizes[part, None], sizes[None, start:])
        for i, j in zip(*np.nonzero((agree >= least) & (low * share[1] >= high * share[0])), strict=True):
            if i != j:
                groups.join(start + int(i), start + int(j))
    yield from groups.links(ids)


def _alike(least: int, share: tuple[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, rep, n, sketch, label) sorted by node to links."""
    return _link_batches(link for rows in _runs(batches) for link in _alike_in(rows, least, share))


def _alike_across(left: pa.Table, right: pa.Table, least: int, share: tuple[int, int]) -> pa.Table:
    """Links that join the likely pairs of members in ``left`` and in ``right``; rows under one label are
    joined from the start."""
    ids = [*left.column("rep").to_pylist(), *right.column("rep").to_pylist()]
    labels = [*left.column("label").to_pylist(), *right.column("label").to_pylist()]
    numbers: dict = {}
    groups = np.array(
        [numbers.setdefault((label is None, i if label is None else label), len(numbers)) for i, label in zip(ids, labels, strict=True)],
        np.int64,
    )
    pairs = []
    if left.num_rows and right.num_rows:
        sizes, n = right.column("n").to_numpy(), left.column("n").to_numpy()
        ours, theirs = (_matrix(t.column("sketch").combine_chunks()) for t in (left, right))
        # Low bytes agree wherever the values do: what they leave over is looked at in full.
        our_bytes, their_bytes = (np.ascontiguousarray(m.T).astype(np.uint8) for m in (ours, theirs))
        for start in range(0, len(ours), 64):
            agree = np.zeros((len(ours[start : start + 64]), len(theirs)), np.uint8)
            for c in range(SKETCH):
                agree += our_bytes[c, start : start + 64, None] == their_bytes[c]
            hits = agree >= least
            for i in (np.nonzero(hits.any(axis=1))[0] + start).tolist():
                at = np.nonzero(hits[i - start])[0]
                at = at[groups[len(ours) + at] != groups[i]]
                low, high = np.minimum(sizes[at], n[i]), np.maximum(sizes[at], n[i])
                at = at[((theirs[at] == ours[i]).sum(axis=1) >= least) & (low * share[1] >= high * share[0])]
                joined, first = np.unique(groups[len(ours) + at], return_index=True)
                if len(joined):
                    pairs += [(ids[i], ids[len(ours) + j]) for j in at[first].tolist()]
                    groups[np.isin(groups, joined)] = groups[i]
    return pa.table([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _like_hub(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds whether the sketch agrees with the hub's (the last column) in enough places."""
    for batch in batches:
        at = batch.schema.names.index("sketch")
        like = (_matrix(batch.column(at)) == _matrix(batch.column(batch.num_columns - 1))).sum(axis=1) >= least
        names = [*batch.schema.names[:-1], "alike"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(like)], names)


def _linked(n: np.ndarray | int, m: int, differ: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Whether sets of sizes n and m with so many elements in just one of them are similar enough."""
    both = (n + m - differ) // 2
    return share[1] * both >= share[0] * (n + m - both)


class _Differences:
    """Difference sets to one hub, indexed by element."""

    def __init__(self, differences: list[np.ndarray], sizes: np.ndarray, share: tuple[int, int]):
        lengths = np.array([len(d) for d in differences], np.int64)
        elements = np.concatenate(differences) if differences else np.zeros(0, np.uint64)
        owners = np.repeat(np.arange(len(differences)), lengths)
        order = np.argsort(elements, kind="stable")
        self.elements, self.owners = elements[order], owners[order]
        self.lengths, self.sizes, self.share = lengths, sizes, share

    def linked_with(self, difference: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the members whose set is similar to the one with this difference set."""
        low = np.searchsorted(self.elements, difference, "left")
        count = np.searchsorted(self.elements, difference, "right") - low
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(self.owners[at], minlength=len(self.lengths))
        differ = self.lengths + len(difference) - 2 * both
        return np.nonzero(_linked(self.sizes, size, differ, self.share))[0]


def _confirmed_in(rows: pa.Table, width: int, share: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """Links that join the similar texts of one cluster."""
    ids = rows.column("rep").to_pylist()
    texts = rows.column("text").combine_chunks().cast(pa.binary())
    sets = [shingle_set(t.as_py(), width) for t in texts]
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(ids) == 2:
        if _linked(sizes[0], sizes[1], sizes.sum() - 2 * common(*sets), share):
            yield ids[0], ids[1]
        return
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    usual = [counts[np.searchsorted(values, s)].sum() / len(s) for s in sets]
    hub = sets[int(np.argmax(usual))]
    differences = [np.setxor1d(s, hub, assume_unique=True) for s in sets]
    index = _Differences(differences, sizes, share)
    groups = _Groups(len(ids))
    inside = _linked(sizes, len(hub), index.lengths, share)
    joined = np.nonzero(inside)[0].tolist()
    for i in joined:
        groups.join(joined[0], i)
    for i in np.nonzero(~inside)[0].tolist():
        for j in index.linked_with(differences[i], int(sizes[i])).tolist():
            groups.join(i, j)
    yield from groups.links(ids)


def _confirmed(width: int, share: tuple[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, rep, text) sorted by cluster to links."""
    return _link_batches(link for rows in _runs(batches) for link in _confirmed_in(rows, width, share))


def _differing(width: int, share: tuple[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, rep, text, hub, text of the hub) to difference sets and whether the hub links."""
    hub, hub_set = None, np.zeros(0, np.uint64)
    for batch in batches:
        sizes, inside, differences = [], [], []
        for key, text, hub_text in zip(batch.column(3).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(4).cast(pa.binary()), strict=True):
            if key != hub:
                hub, hub_set = key, shingle_set(hub_text.as_py(), width)
            own = shingle_set(text.as_py(), width)
            differ = np.setxor1d(own, hub_set, assume_unique=True)
            sizes.append(len(own))
            inside.append(bool(_linked(len(own), len(hub_set), len(differ), share)))
            differences.append(differ.tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int64()),
                pa.array(inside, pa.bool_()), pa.array(differences, pa.binary()),
            ],
            ["cluster", "rep", "hub", "n", "inside", "differ"],
        )


def _block_links(left: pa.Table, right: pa.Table, share: tuple[int, int]) -> pa.Table:
    """Links between the members in ``left``, none of them linked by the hub, and those in ``right``."""
    arrays = lambda t: [np.frombuffer(d, np.uint64) for d in t.column("differ").to_pylist()]
    ids, inside = right.column("rep").to_pylist(), right.column("inside").to_pylist()
    hub = (left if left.num_rows else right).column("hub").to_pylist()[:1]
    index = _Differences(arrays(right), right.column("n").to_numpy(), share)
    found: set[tuple[int, int]] = set()
    for rep, size, differ in zip(left.column("rep").to_pylist(), left.column("n").to_pylist(), arrays(left), strict=True):
        for j in index.linked_with(differ, size).tolist():
            # All that the hub links are one group: a link with any of them is one with the hub.
            other = hub[0] if inside[j] else ids[j]
            if other != rep:
                found.add((min(rep, other), max(rep, other)))
    pairs = sorted(found)
    return pa.table([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


class _Join:
    """One similarity join: its parameters and the classes."""

    def __init__(self, docs: DataFrame, width: int, share: tuple[int, int]):
        self.width, self.share = width, share
        self.least = int(SKETCH * (share[0] / share[1] - SLACK))
        self.docs = docs
        self.signed = stored(
            docs.mapInArrow(functools.partial(_signatures, width), _SIGNATURE), "near-signatures"
        )
        named = self.signed.where("n > 0 and doc_id is not null")
        narrow = named.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "whole")).alias("r"))
        self.classes = stored(
            narrow.select("hi", "lo", F.col("r.doc_id").alias("rep"), F.col("r.whole").alias("whole")),
            "near-classes",
        )
        met = named.select("doc_id", "n", "sketch", "hi", "lo").join(
            self.classes.select("hi", "lo", F.col("rep").alias("doc_id")), ["hi", "lo", "doc_id"]
        )
        # Repeated rows give the same class several times.
        members = met.select(F.col("doc_id").alias("rep"), "n", "sketch").dropDuplicates(["rep"])
        self.members = stored(members, "near-members")

    def first_nodes(self) -> DataFrame:
        at = [(t, t * BRANCHES + b) for t in range(TREES) for b in range(BRANCHES)]
        keys = [F.xxhash64(F.lit(t), F.lit(c), F.col("sketch")[c]) for t, c in at]
        rows = self.members.select(F.explode(F.array(*keys)).alias("node"), "rep")
        sizes = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        met = rows.join(sizes, "node").join(self.members, "rep")
        return stored(met.select("node", "rep", "n", "sketch", F.lit(None).cast("long").alias("label"), "size"), "near-nodes")

    def exhaustive(self, nodes: DataFrame) -> DataFrame:
        """Links that join the likely pairs within each node, one task a node."""
        rows = nodes.select("node", "rep", "n", "sketch", "label").repartition("node").sortWithinPartitions("node")
        return rows.mapInArrow(functools.partial(_alike, self.least, self.share), "a long, b long")

    def children(self, rows: DataFrame) -> DataFrame:
        """``rows`` (node of the child, rep, n, sketch, label) of nodes that still hold two members
        under different labels, with the node's size."""
        sizes = rows.groupBy("node").agg(
            F.count("*").alias("size"), F.count("label").alias("labelled"),
            F.min("label").alias("first"), F.max("label").alias("last"),
        )
        open_ = sizes.where("size > 1 and not coalesce(labelled = size and first = last, false)")
        return stored(rows.join(open_.select("node", "size"), "node"), "near-nodes")

    def hubs(self, large: DataFrame) -> DataFrame:
        """Per node its hub, the member that agrees most with the commonest values at sampled
        coordinates."""
        at = SKETCH - SAMPLED
        values = large.select("node", F.posexplode(F.slice("sketch", at + 1, SAMPLED)).alias("c", "v"))
        counts = values.groupBy("node", "c", "v").agg(F.count("*").alias("k"))
        modes = counts.groupBy("node", "c").agg(F.max(F.struct("k", "v")).alias("top"))
        commonest = modes.groupBy("node").agg(
            F.sort_array(F.collect_list(F.struct("c", F.col("top.v").alias("v")))).alias("commonest")
        )
        agree = functools.reduce(
            Column.__add__,
            [(F.col("sketch")[at + i] == F.col("commonest")[i]["v"]).cast("int") for i in range(SAMPLED)],
        )
        met = large.join(commonest, "node").select("node", "rep", agree.alias("agree"))
        best = met.groupBy("node").agg(F.max(F.struct("agree", (-F.col("rep")).alias("r"))).alias("best"))
        hub = best.select("node", (-F.col("best.r")).alias("rep"))
        return stored(
            hub.join(large, ["node", "rep"]).select(
                "node", F.col("rep").alias("hub"), F.col("label").alias("hub_label"),
                F.col("sketch").alias("hub_sketch"),
            ),
            "near-hubs",
        )

    def divide(self, large: DataFrame, last: bool = False) -> tuple[list[DataFrame], DataFrame]:
        """One round over large nodes: links with hubs, links of the members that are unlike their hub
        where these are few, and the rows of the children of the other nodes. In the last round any number
        is few: blocks are bounded, whatever the size of the node."""
        met = large.join(self.hubs(large), "node").select(
            "node", "rep", "n", "sketch", "label", "hub", "hub_label", "hub_sketch"
        )
        told = met.mapInArrow(
            functools.partial(_like_hub, self.least),
            "node long, rep long, n int, sketch array<int>, label long, hub long, hub_label long, alike boolean",
        )
        inside = F.col("alike") | F.coalesce(F.col("label") == F.col("hub_label"), F.lit(False))
        group = F.when(inside, F.xxhash64("node", F.lit("hub"))).otherwise(F.col("label"))
        told = stored(told.withColumn("inside", inside).withColumn("label", group), "near-told")
        links = told.where("alike and rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
        counts = told.groupBy("node").agg(F.count("*").alias("size"), F.count_if(~F.col("inside")).alias("unlike"))
        counts = stored(counts.where("unlike > 0"), "near-unlike")
        is_few = F.lit(last) | (F.col("unlike") <= FEW)
        few = counts.where(is_few).select(
            "node", F.ceil(F.col("unlike") / BLOCK).alias("lefts"), F.ceil(F.col("size") / BLOCK).alias("rights")
        )
        rows = told.join(few, "node")
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
        key = ["node", "l", "r"]
        kept = [*key, "rep", "n", "sketch", "label"]
        left = rows.where("not inside").withColumn("l", own("lefts")).withColumn("r", upto("rights")).select(*kept)
        right = rows.withColumn("r", own("rights")).withColumn("l", upto("lefts")).select(*kept)
        least, share = self.least, self.share

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            return _alike_across(left, right, least, share)

        # Stored apart: Spark cannot tell two sides apart that come from one frame.
        left, right = stored(left, "near-few"), stored(right, "near-whole")
        more = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "a long, b long")
        more = stored(more, "near-alike")
        # Distinct coordinates: fewer, in the mean, would let pairs at the threshold die out.
        first = F.pmod(F.xxhash64("node"), F.lit(SKETCH))
        chosen = [F.pmod(first + i * (SKETCH // BRANCHES), F.lit(SKETCH)).cast("int") for i in range(BRANCHES)]
        rows = told.join(counts.where(~is_few).select("node"), "node")
        rows = rows.withColumn("c", F.explode(F.array(*chosen)))
        rows = rows.select(
            F.xxhash64("node", "c", F.element_at("sketch", F.col("c") + 1)).alias("node"), "rep", "n", "sketch", "label"
        )
        return [links, more], self.children(rows.dropDuplicates(["node", "rep"]))

    def clusters(self) -> DataFrame:
        """(rep, cluster) of the classes that have a likely partner: the groups that the trees find."""
        nodes = self.first_nodes()
        found = [stored(self.exhaustive(nodes.where(F.col("size") <= SMALL)), "near-alike")]
        large = nodes.where(F.col("size") > SMALL)
        for _ in range(MOST_ROUNDS):
            if large.limit(1).count() == 0:
                break
            links, nodes = self.divide(large)
            found += links
            found.append(stored(self.exhaustive(nodes.where(F.col("size") <= SMALL)), "near-alike"))
            large = nodes.where(F.col("size") > SMALL)
        else:  # what no coordinate divides is compared in full
            if large.limit(1).count():
                found += self.divide(large, last=True)[0]
        links = functools.reduce(DataFrame.unionByName, found)
        return components(links).select(F.col("id").alias("rep"), F.col("component").alias("cluster"))

    def links(self) -> DataFrame:
        """Confirmed links that join all similar classes."""
        clusters = self.clusters().join(self.members.select("rep", "n"), "rep")
        sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
        fits = (F.col("members") <= CLUSTER_MEMBERS) & (F.col("shingles") <= CLUSTER_SHINGLES)
        wanted = clusters.join(sizes.withColumn("fits", fits), "cluster").join(self.classes, "rep")
        keyed = self.docs.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("whole"), "text")
        texts = keyed.join(wanted.select("rep", "whole", "cluster", "fits", "members"), ["rep", "whole"])
        texts = stored(texts.drop("whole").dropDuplicates(["rep"]), "near-texts")
        small = texts.where("fits").select("cluster", "rep", "text").repartition("cluster").sortWithinPartitions("cluster")
        links = small.mapInArrow(functools.partial(_confirmed, self.width, self.share), "a long, b long")
        large = texts.where("not fits")
        if large.limit(1).count():
            links = links.unionByName(self.large_links(large))
        return stored(links, "near-links")

    def large_links(self, texts: DataFrame) -> DataFrame:
        """Links within clusters too large for one task: by the hub row by row, then for the members
        it does not link against all members, in blocks of bounded size that hold difference sets."""
        rows = texts.select(F.col("cluster").alias("node"), "rep", "members").join(self.members, "rep")
        rows = rows.select("node", "rep", "n", "sketch", F.lit(None).cast("long").alias("label"), F.col("members").alias("size"))
        hubs = self.hubs(stored(rows, "near-large")).select(F.col("node").alias("cluster"), "hub")
        hub_texts = hubs.join(texts.select(F.col("rep").alias("hub"), F.col("text").alias("hub_text")), "hub")
        met = texts.join(hub_texts, "cluster").select("cluster", "rep", "text", "hub", "hub_text")
        differing = stored(
            met.mapInArrow(
                functools.partial(_differing, self.width, self.share),
                "cluster long, rep long, hub long, n long, inside boolean, differ binary",
            ),
            "near-differences",
        )
        direct = differing.where("inside and rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
        weight = F.octet_length("differ") / 8 + 1
        blocks = differing.groupBy("cluster").agg(
            F.ceil(F.sum(weight) / BLOCK_ELEMENTS).alias("rights"),
            F.ceil(F.sum(F.when(~F.col("inside"), weight)) / BLOCK_ELEMENTS).alias("lefts"),
        ).where("lefts is not null")
        rows = differing.join(blocks, "cluster")
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        own = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n))
        key = ["cluster", "left", "right"]
        kept = [*key, "rep", "hub", "n", "inside", "differ"]
        left = rows.where("not inside").withColumn("left", own("left", "lefts")).withColumn("right", upto("rights")).select(*kept)
        right = rows.withColumn("right", own("right", "rights")).withColumn("left", upto("lefts")).select(*kept)
        share = self.share

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            return _block_links(left, right, share)

        left, right = stored(left, "near-left"), stored(right, "near-right")
        more = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "a long, b long")
        return direct.unionByName(more)


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    share: tuple[int, int] = (80, 100),
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of non-blank characters, A-Z lower-cased; a text of fewer than ``width`` words is
    one shingle. Documents are linked if the share of common shingles is at least ``share``. A NULL
    text, or one without words, has no shingles and is linked with nothing; rows of one id are one
    document, linked by any of their texts; a row without an id stands alone, with no component, and
    is kept; a very long text is compared whole; an empty table gives no rows. Other columns of ``docs`` are not looked at.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    join = _Join(plain, width, share)
    signed = join.signed.select("doc_id", "n", "hi", "lo")
    several = signed.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(
        F.min("lo").alias("first"), F.max("lo").alias("last")
    ).where("first <> last").select("doc_id")
    same = signed.where("n > 0").join(several, "doc_id").join(join.classes, ["hi", "lo"])
    same = same.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(join.links().unionByName(same))
    named = join.classes.join(found, F.col("rep") == F.col("id"), "left").select(
        "hi", "lo", F.coalesce("component", "rep").alias("component")
    )
    reached = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component"))
    component = F.coalesce(reached, F.col("doc_id"))
    return signed.join(named, ["hi", "lo"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def without_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters
) -> DataFrame:
    """``docs`` with one row for each group of near duplicates: that of its smallest id. Rows of one id
    are one document, of which the row with the smallest hash of its text stays."""
    found = stored(near_duplicates(docs, doc_id, text, **parameters).select("doc_id", "kept"), "near-kept")
    gone = found.where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    again = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    again = again.where("n > 1").select(F.col("doc_id").alias("again_id"))
    kept = docs.join(gone, docs[doc_id] == gone["gone_id"], "left_anti")
    once = kept.join(again, kept[doc_id] == again["again_id"], "left_anti")
    several = kept.join(again, kept[doc_id] == again["again_id"], "left_semi")
    if again.limit(1).count() == 0:
        return once
    # Told apart by their JSON, as columns without an order cannot be compared.
    whole, name = whole_row(docs), quoted(doc_id)
    place = F.struct(F.xxhash64(quoted(text)), F.xxhash64(F.to_json(whole)))
    chosen = several.groupBy(F.col(name).alias("again_id")).agg(F.min_by(whole, place).alias("m"))
    return once.unionByName(chosen.select("m.*"))

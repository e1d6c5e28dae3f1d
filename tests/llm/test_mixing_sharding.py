"""Mixing and sharding against plain versions and SQL."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyfield.llm import mixing, registered, sharding
from tests.compare import database, difference
from tests.llm import cases


def plain_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, found = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        for s in over or open_:
            found[s] = 3.0 * sizes[s] if over else level * weight[s]
        left -= sum(found[s] for s in over)
        open_ -= set(over or open_)
    return found


def test_mix_near_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 200), rng.choice(["a", "b", "b", "b", "b", "é", "z", None])) for i in range(3_000)]
    rows += [(9_000 + i, "one", "tiny") for i in range(3)]
    df = cases.documents(spark, rows)
    found = mixing.mix(df).collect()
    sizes: dict = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    targets = plain_targets(sizes)
    source_of = {i: s for i, _, s in rows}
    taken: dict = defaultdict(int)
    for r in found:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source]
        assert abs(r.target - targets[source]) < 1e-6 * targets[source]
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    block = mixing.plan_size(sum(sizes.values()))[0]
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 12 * block, source
    assert sorted(found) == sorted(mixing.mix(df).collect())


def test_mix_of_odd_documents(spark):
    found = mixing.mix(cases.odd(spark)).collect()
    assert len(found) == len(cases.ODD_ROWS)
    assert all(r.taken == 0 for r in found if r.size == 0)
    assert mixing.mix(cases.empty(spark)).count() == 0
    nothing = cases.documents(spark, [(1, None), (2, "")])
    assert [(r.size, r.taken) for r in mixing.mix(nothing).collect()] == [(0, 0), (0, 0)]


def test_schedule_prefixes_hold_the_shares(spark):
    sized = spark.createDataFrame([("a", 50_000), ("b", 30_000), ("c", 20_000)], "source string, size long")
    targets = mixing.targets(sized).cache()
    slots = mixing.schedule(targets, 100_000).orderBy("slot").collect()
    share = {r.source_no: r.target / 100_000 for r in targets.collect()}
    for prefix in (100, 1_000, 20_000):
        counts: dict = defaultdict(int)
        for r in slots[:prefix]:
            counts[r.source_no] += 1
        for source, part in share.items():
            assert abs(counts[source] - part * prefix) <= 12
    for source in share:
        blocks = [r.repeat * 10**6 + r.block for r in slots if r.source_no == source]
        assert blocks == sorted(set(blocks))


def test_mixed_documents_keep_their_columns(spark):
    df = cases.odd(spark)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    per_text: dict = defaultdict(int)
    for r in mixed.select("doc_id", F.xxhash64("text").alias("h")).collect():
        per_text[r.doc_id, r.h] += 1
    rows: dict = defaultdict(int)
    for r in df.select("doc_id", F.xxhash64("text").alias("h")).collect():
        rows[r.doc_id, r.h] += 1
    assert all(n <= 3 * rows[key] for key, n in per_text.items())


@pytest.mark.parametrize("limit", [3_000, 20_000, 100_000, 10**9])
def test_shards_as_in_sql(spark, limit):
    sf = "/root/testdata/sf0.001"
    df = sharding.assign(spark.read.parquet(f"{sf}/documents.parquet"), limit)
    columns = ["doc_id", "shard", "depth", "piece", "n_bytes", "shard_bytes"]
    assert difference(df.select(columns), database(sf), registered.op8_sql(limit)) is None


def test_shards_in_several_passes(spark, monkeypatch):
    """With directories of few bits, leftovers of one pass go to the next; the result is the same."""
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(sharding, "PASS_BITS", 3)
    df = sharding.assign(spark.read.parquet(f"{sf}/documents.parquet"), 3_000)
    columns = ["doc_id", "shard", "depth", "piece", "n_bytes", "shard_bytes"]
    assert difference(df.select(columns), database(sf), registered.op8_sql(3_000)) is None


def test_repeated_rows_fill_pieces(spark):
    rows = [(7, "x" * 100)] * 95 + [(None, "y" * 100)] * 20 + [(8, "z" * 5_000)] + [(i, "w" * 50) for i in range(100, 160)]
    df = sharding.assign(cases.documents(spark, rows), 1_000)
    held: dict = defaultdict(list)
    for r in df.collect():
        held[r.shard, r.piece].append(r)
    assert sum(map(len, held.values())) == len(rows)
    for members in held.values():
        total = sum(r.n_bytes for r in members)
        assert total <= 1_000 or len(members) == 1
        assert {r.shard_bytes for r in members} == {total}


def test_pieces_hold_rows_that_differ_elsewhere(spark):
    """Rows of one id and text, but of different sources, share the pieces of their shard."""
    rows = [(7, "x" * 100, f"s{i % 40}") for i in range(400)] + [(None, "y" * 60, f"t{i}") for i in range(90)]
    df = sharding.assign(cases.documents(spark, rows).repartition(6), 1_000)
    held: dict = defaultdict(list)
    for r in df.select("shard", "piece", "n_bytes", "shard_bytes", "source").collect():
        held[r.shard, r.piece].append(r)
    assert sum(map(len, held.values())) == len(rows) and len(held) >= 40 + 6
    for members in held.values():
        total = sum(r.n_bytes for r in members)
        assert total <= 1_000 and {r.shard_bytes for r in members} == {total}


def test_registered_shards_split(spark):
    depths = registered.op8_sharding(spark, "/root/testdata/sf0.01").select("depth").distinct().collect()
    assert max(r.depth for r in depths) >= 1


def test_streams_spread_one_id(spark):
    """A third of the rows with one id, a third with none: no bucket of a stream holds many."""
    rows = [(5, f"w{i} " * 3, "a") for i in range(1_000)] + [(None, f"v{i} x", "a") for i in range(1_000)]
    df = cases.documents(spark, rows + [(i, "one two", "b") for i in range(10, 1_010)])
    sized = df.select(
        "doc_id", "source", F.size(F.split("text", " ")).cast("long").alias("size"),
        mixing._order(F.col("doc_id"), F.col("text")).alias("order"),
    )
    placed = mixing.streams(sized, mixing.targets(sized))
    assert placed.count() == 3_000
    assert placed.groupBy("source_no", "bucket").count().agg(F.max("count")).first()[0] <= 8
    mixed = mixing.mix(df).collect()
    assert len(mixed) == 3_000 and all(0 <= r.taken <= 3 * r["size"] for r in mixed)


def test_sharding_of_odd_documents(spark):
    df = cases.odd(spark)
    placed = sharding.assign(df, 10_000)
    assert placed.count() == len(cases.ODD_ROWS)
    assert set(df.columns) <= set(placed.columns)
    assert sharding.assign(cases.empty(spark)).count() == 0

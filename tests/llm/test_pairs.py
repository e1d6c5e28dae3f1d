"""Near dedup, line dedup and decontamination against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import decontaminate, line_dedup, near_dedup
from tallyfield.llm.components import components
from tests.llm import cases


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def near_copies(n: int, edits: int, seed: int, length: int = 120) -> list[str]:
    """Copies of one text, each with its own changed words."""
    rng = random.Random(seed)
    base = [f"t{seed}w{rng.randrange(10_000)}" for _ in range(length)]
    made = [" ".join(base)]
    for i in range(n):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(length)] = f"x{seed}n{i}r{rng.randrange(99)}"
        made.append(" ".join(copy))
    return made


@pytest.mark.parametrize("width,share", [(3, (85, 100)), (5, (80, 100))])
def test_components_as_by_all_pairs(spark, width, share):
    """Small groups, a group above the node size in which copies link with the original only, a chain,
    and texts that share a passage without being alike."""
    rng = random.Random(3)
    texts = []
    for seed, (n, edits) in enumerate([(2, 1), (5, 2), (10, 3), (80, 3), (60, 5), (40, 1)]):
        texts += near_copies(n, edits, seed)
    chain = [f"c{i}" for i in range(100)]
    for i in range(30):
        texts.append(" ".join(chain))
        chain[i * 3] = f"d{i}"
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for _ in range(60)]
    texts += texts[:40]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    found = result(near_dedup.near_duplicates(cases.documents(spark, rows), width=width, share=share))
    expected = cases.plain_components(rows, width, share)
    assert {i: c for i, (_, c, _) in found.items()} == expected
    assert {i: n for i, (n, _, _) in found.items()} == {i: len(cases.shingles(t, width)) for i, t in rows}


def test_components_through_large_nodes_and_clusters(spark, monkeypatch):
    """The same with limits so small that nodes branch and clusters are confirmed in blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", 12)
    monkeypatch.setattr(near_dedup, "CLUSTER_MEMBERS", 10)
    monkeypatch.setattr(near_dedup, "BLOCK_ELEMENTS", 600)
    texts = []
    for seed, (n, edits) in enumerate([(3, 1), (60, 3), (40, 5)]):
        texts += near_copies(n, edits, seed)
    passage = " ".join(f"p{i}" for i in range(40))
    rng = random.Random(4)
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    found = result(near_dedup.near_duplicates(cases.documents(spark, rows, False), width=3, share=(85, 100)))
    assert {i: c for i, (_, c, _) in found.items()} == cases.plain_components(rows, 3, (85, 100))


def borderline_pairs(n: int, seed: int) -> list[str]:
    """Texts that share half of their words with all others, in pairs of similarity 0.858 by words of 3."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    made = []
    for i in range(n):
        own = [f"q{rng.randrange(10**9)}" for _ in range(60)]
        made.append(" ".join([*passage, *own]))
        made.append(" ".join([*passage, *own[:-9], *(f"r{i}n{k}" for k in range(9))]))
    return made


def test_pairs_through_branching_nodes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 25)
    monkeypatch.setattr(near_dedup, "FEW", 25)
    rows = list(enumerate(borderline_pairs(1_000, 1)))
    found = result(near_dedup.near_duplicates(cases.documents(spark, rows, False), width=3, share=(85, 100)))
    lost = [i for i, _ in rows if found[i][1] != i - i % 2]
    assert not lost, f"{len(lost)} of {len(rows) // 2} pairs"


def large_family(spark, n: int):
    """Rows of one node: sketches that take the commonest value in half of the places, as of slot-filled
    pages, in pairs (2 i, 2 i + 1) that agree in 54 of 64."""
    rng = np.random.default_rng(1)
    one = rng.integers(0, 3, (n, near_dedup.SKETCH)) * (rng.random((n, near_dedup.SKETCH)) < 0.75)
    other = one.copy()
    for row in other:
        row[rng.choice(near_dedup.SKETCH, 10, replace=False)] += 3
    both = np.stack([one, other], axis=1).reshape(2 * n, -1)
    rows = [(7, i, 100, v.tolist(), None, 2 * n) for i, v in enumerate(both)]
    return spark.createDataFrame(rows, "node long, rep long, n int, sketch array<int>, label long, size long")


def bare_join(share):
    join = near_dedup._Join.__new__(near_dedup._Join)
    join.share, join.least = share, int(near_dedup.SKETCH * (share[0] / share[1] - near_dedup.SLACK))
    return join


def assert_pairs_joined(found, n: int):
    root = near_dedup._Groups(2 * n)
    for links in found:
        for r in links.collect():
            root.join(r.a, r.b)
    assert all(root.root(2 * i) == root.root(2 * i + 1) for i in range(n))


def test_a_large_node_is_compared_in_blocks(spark, monkeypatch):
    """Nothing is left to chance in a node with more than SMALL members unlike the hub."""
    monkeypatch.setattr(near_dedup, "BLOCK", 900, raising=False)
    rows = large_family(spark, 1_500)
    found, rest = bare_join((85, 100)).divide(near_dedup.stored(rows, "near-test"))
    assert rest.count() == 0
    assert_pairs_joined(found, 1_500)


def test_the_last_round_compares_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MOST_ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "FEW", 10)
    monkeypatch.setattr(near_dedup, "BLOCK", 900)
    rows = near_dedup.stored(large_family(spark, 1_500), "near-test")
    join, tasks = bare_join((85, 100)), []
    join.first_nodes = lambda: rows
    join.exhaustive = lambda nodes: tasks.append(nodes.count()) or nodes.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    found = join.clusters().collect()
    assert max(tasks) <= near_dedup.SMALL
    group = {r.rep: r.cluster for r in found}
    assert all(2 * i in group and group[2 * i] == group.get(2 * i + 1) for i in range(1_500))


def test_reckoned_recall_meets_its_target():
    assert near_dedup.missed(0.85) <= 3e-7
    assert near_dedup.missed(0.8) <= 1e-5


def test_near_dedup_of_odd_documents(spark):
    rows = near_dedup.near_duplicates(cases.odd(spark), width=3, share=(85, 100)).collect()
    assert len(rows) == len(cases.ODD_ROWS)
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[2].component_id == 1 and not by_id[2].kept
    assert by_id[3].n_shingles == by_id[4].n_shingles == by_id[5].n_shingles == 0
    assert by_id[3].kept and by_id[4].kept and by_id[5].kept
    assert by_id[7].component_id == 6
    assert by_id[9].component_id == 8
    assert by_id[10].component_id == 10
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert near_dedup.near_duplicates(cases.empty(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    df = cases.odd(spark)
    kept = near_dedup.without_near_duplicates(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 3, 4, 5, 6, 8, 10, 11, 12, 13, 14]


def test_rows_of_one_id_link_what_either_links(spark):
    a, b = near_copies(0, 0, 1)[0], near_copies(0, 0, 2)[0]
    rows = [(1, a), (5, a), (5, b), (9, b)]
    found = near_dedup.near_duplicates(cases.documents(spark, rows)).collect()
    assert {r.component_id for r in found} == {1}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100)], "a long, b long")
    found = {r.id: r.component for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_lines_as_by_one_pass(spark, batches):
    rng = random.Random(7)
    pool = [f"Line number {i} " + "x" * (i % 5) for i in range(30)] + ["short", "", "  ", "ÄÖÜäöüßéè"]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t"]) for _ in range(rng.randrange(8)))) for i in range(120)]
    rows += [(500 + i, "a line in very many documents\n" + str(i)) for i in range(60)]
    df = line_dedup.dedup_lines(cases.documents(spark, rows), batches=batches)
    import hashlib

    found = sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect())
    assert found == sorted(cases.plain_lines(rows))


def test_lines_of_odd_documents(spark):
    import hashlib

    key = lambda r: (r[0] is not None, r[0], *r[1:])
    plain = [(i, t) for i, t, _ in cases.ODD_ROWS]
    rows = line_dedup.dedup_lines(cases.odd(spark)).collect()
    found = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in rows]
    assert sorted(found, key=lambda r: str(key(r))) == sorted(cases.plain_lines(plain), key=lambda r: str(key(r)))
    assert line_dedup.dedup_lines(cases.empty(spark)).count() == 0


def test_runs_leave_no_tables(spark):
    line_dedup.dedup_lines(cases.odd(spark), batches=6).count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def contained(rows, items, width=5, share=(80, 100)):
    sets = [(i, cases.shingles(t, width)) for i, t in items]
    found = []
    for doc_id, text in rows:
        whole = cases.shingles(text, width)
        for item_id, s in sets:
            if s and share[1] * len(s & whole) >= share[0] * len(s):
                found.append((doc_id, item_id, len(s & whole), len(s)))
    return sorted(found, key=str)


@pytest.mark.parametrize("block_words", [2_000_000, 300])
def test_items_in_documents_as_by_all_pairs(spark, block_words):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(5_000)}" for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([6, 7, 9, 12, 14, 20, 33, 48, 64, 65, 130, 400] * 3)]
    items += [(90, None), (91, ""), (92, "two words"), (None, items[4][1]), (5, items[5][1])]
    rows = []
    for i, n in enumerate([0, 10, 100, 1_000, 30_000] * 12):
        item = items[rng.randrange(36)][1].split()
        if i % 3 == 0:  # a changed word in longer ones
            item[len(item) // 2] = "changed"
        before = rng.randrange(n + 1)
        rows.append((i, " ".join([text(before), *item, text(n - before)]).upper()))
    rows += [(200, None), (201, ""), (202, "Two Words"), (None, items[7][1]), (7, rows[7][1])]
    docs = cases.documents(spark, rows)
    found = decontaminate.contained_items(docs, cases.documents(spark, [(i, t, "") for i, t in items], False)
                                          .withColumnRenamed("doc_id", "item_id"), block_words=block_words)
    assert sorted(map(tuple, found.collect()), key=str) == contained(rows, items)


def test_decontamination_of_odd_documents(spark):
    df = cases.odd(spark)
    items = spark.createDataFrame([(1, "brown fox jumps over the lazy dog"), (2, None)], "item_id long, text string")
    kept = decontaminate.without_items(df, items)
    assert kept.columns == df.columns
    assert kept.count() == len(cases.ODD_ROWS) - 3
    assert decontaminate.contained_items(cases.empty(spark), items).count() == 0
    assert decontaminate.without_items(df, items.where("false")).count() == len(cases.ODD_ROWS)

"""Token alignment against a plain version, whole and in chunks of any size."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyfield.llm import alignment as al
from tallyfield.llm import registered
from tallyfield.llm.common import table
from tests.llm import cases

PATHS = (str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))
PARTS = [
    "a", "b ", " ", "\n", "  ", "Word", "'s", ",", ".", "1", "é", " ", "　", "\x1f", "😀", "<|endoftext|>", "\t",
    "中文", "▁", "<s>", "the", "ﬁ", "é", "\x00", "thetion", "x" * 17, "\x85",
]


@cache
def libraries():
    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), al._pairing(*PATHS)


def plain_groups(text):
    """Groups of a text as [(ids a, ids b)], none if it has no tokens."""
    first, second, pairing = libraries()
    if not text:
        return []
    data = b" " + text.encode()
    sides = []
    for ids, vocabulary in ((first.encode(" " + text, add_special_tokens=False).ids, pairing.a), (second.encode(text), pairing.b)):
        tokens = [vocabulary.bytes[i].as_py() for i in ids]
        if b"".join(tokens) != data:
            return []
        sides.append(list(zip(ids, itertools.accumulate(map(len, tokens)), strict=True)))
    common = {end for _, end in sides[0]} & {end for _, end in sides[1]}
    groups = []
    for side in sides:
        here, parts = [], []
        for i, end in side:
            here.append(i)
            if end in common:
                parts.append(here)
                here = []
        groups.append(parts)
    return list(zip(*groups, strict=True))


def written(groups):
    return ";".join("|".join(",".join(map(str, ids)) for ids in group) for group in groups)


def plain_alignment(rows):
    """The whole contract, row by row."""
    found = [(i, plain_groups(t)) for i, t in rows]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for _, g in found]
    counts = Counter(pair for doc in links for pair in doc)
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [
        (
            i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(doc.values()),
            sum(n for p, n in doc.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in doc.items()),
            hashlib.sha256(written(g).encode()).hexdigest() if g else "",
        )
        for (i, g), doc in zip(found, links, strict=True)
    ]


def by_row(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def random_texts(n, most=14):
    rng = random.Random(2)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_short_texts_as_by_plain_alignment(spark):
    rows = list(enumerate([*random_texts(1_500), "x" * 5_000, "the " * 3_000]))
    found = al.align(cases.documents(spark, rows)).collect()
    assert by_row(map(tuple, found)) == by_row(plain_alignment(rows))


@pytest.mark.parametrize("chunk_bytes", [7, 40, 300])
def test_chunks_give_what_whole_texts_give(spark, chunk_bytes):
    texts = [*random_texts(120, 60), " ".join(random_texts(300)), "word " * 900, "x" * 2_000, "中文 字" * 200]
    rows = list(enumerate(texts))
    found = al.align(cases.documents(spark, rows), chunk_bytes=chunk_bytes).collect()
    assert by_row(map(tuple, found)) == by_row(plain_alignment(rows))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40), st.integers(1, 30))
def test_chunks_tile_a_text(parts, size):
    text = "".join(parts)
    found = al.chunks(text, size)
    assert sum(high - low for low, high, _ in found) == len(b" " + text.encode())
    assert all(stretch.startswith(b" ") for _, _, stretch in found)
    # Most chunks of a long text are bounded: a stretch reaches to the sure cuts beside its range.
    assert b"".join(s[low:high] for low, high, s in found) == b" " + text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=25), st.lists(st.integers(1, 80), max_size=6), st.randoms())
def test_fragments_compose_in_any_grouping(parts, cuts, rng):
    text = "".join(parts)
    groups = plain_groups(text)
    _, _, pairing = libraries()
    if not groups:
        return
    (a,), (b,) = pairing.tokens([text])
    size = len(b" " + text.encode())
    edges = sorted({0, size, *(c for c in cuts if c < size)})
    closed, ends = {}, []
    for n, (low, high) in enumerate(itertools.pairwise(edges)):
        f = al.fragment(pairing, a, b, low, high)
        sides = [tuple(x.astype("<u4").tobytes() for x in f[s]) for s in ("before", "behind")]
        ends.append({"closed": f["closed"], "at": n, "before": sides[0], "behind": sides[1]})
        if f["inner"] is not None and f["inner"].n_groups:
            closed[(n, 1)] = bytes(f["inner"].written()[0]).decode()
    as_text = lambda group: "|".join(",".join(map(str, np.frombuffer(x, "<u4").tolist())) for x in group)
    while len(ends) > 1:  # any two neighbours first
        i = rng.randrange(len(ends) - 1)
        ends[i : i + 2], seam = [(both := al.compose(ends[i], ends[i + 1]))[0]], both[1]
        if seam:
            closed[(seam["at"], 0)] = as_text(seam["group"])
    assert ends[0]["closed"] and ends[0]["behind"] == (b"", b"")
    closed[(ends[0]["at"], 0)] = as_text(ends[0]["before"])
    assert ";".join(closed[k] for k in sorted(closed)) == written(groups)


def test_odd_documents(spark):
    rows = [(i, t) for i, t, _ in cases.ODD_ROWS]
    expected = by_row(plain_alignment(rows))
    assert by_row(map(tuple, al.align(cases.odd(spark)).collect())) == expected
    assert al.align(cases.empty(spark)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert by_row(map(tuple, registered.op11_alignment(spark, sf).collect())) == by_row(plain_alignment(rows))


def test_frequent_ranges_have_several_cells(spark, monkeypatch):
    monkeypatch.setattr(al, "CELL_ENTRIES", 50)
    monkeypatch.setattr(al, "CELL_PAIRS", 20)
    rows = list(enumerate(["the the cat", "a dog, the cat", "the", None, "the dog"] * 30))
    found = al.align(cases.documents(spark, rows)).collect()
    assert by_row(map(tuple, found)) == by_row(plain_alignment(rows))


@given(st.lists(st.integers(0, 2**62)))
def test_packed_numbers(numbers):
    assert al.unpacked(al.packed(np.array(numbers, np.int64))).tolist() == numbers


def test_counts_come_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(al, "_COUNTED", 10)
    rng = random.Random(3)
    docs = [sorted(rng.sample(range(60), 7)) for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({"pairs": [al.packed(np.diff(d, prepend=0)) for d in docs]})
    total = Counter()
    for part in al._counted(iter([batch])):
        total.update(dict(zip(*(c.to_pylist() for c in part.columns), strict=True)))
    assert total == Counter(p for d in docs for p in d)

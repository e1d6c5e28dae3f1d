"""Aligning the tokens of two tokenizers by an associative monoid of fragments.

The byte offsets where tokens of both tokenizers end cut a text into groups. The tokens that end in one
byte range of a text form a fragment: an open prefix (tokens up to the first common end; their group began
further left), closed groups, and an open suffix (tokens behind the last common end). Fragments compose:
the suffix of the left one and the prefix of the right one close a group at the seam, and a fragment without
any common end only lengthens what is open beside it. Composition is associative, so fragments of a long
document are made in different tasks and composed as a tree; what is closed stays where it was found, and
only open ends travel. A document of up to ``CHUNK_BYTES`` is one fragment, made and closed in one task.

Links join all tokens of both sides within a group. How many documents hold an id pair linked is counted
after a sum per task. Documents meet those counts in cells: a range of first ids with a bounded number of
id pairs, met by a bounded number of documents' pairs; a frequent range has as many cells as it needs.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import stored
from tallyfield.llm.tokens import CUT, ODD_BLANKS, Encoder, PieceIds, byte_signs, encoder

CHUNK_BYTES = 32 * 1024
FAN = 16
# A cell holds at most so many distinct id pairs, and meets about so many pairs of documents.
CELL_PAIRS = 2_000_000
CELL_ENTRIES = 8_000_000
_AT_ONCE = 2_000_000
_COUNTED = 2_000_000
# Pieces of text whose ids a worker holds, for each tokenizer.
_PIECES = 400_000
_EXPANDED = 64

_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_ROW = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_FIRST = f"{_ROW}, chunk long, low long, high long, text binary"
_LEAF = "key long, chunk long, ok boolean, n_a long, n_b long, n_groups long, n_links long, groups binary, pairs binary, times binary"
_OPEN = "key long, place long, closed boolean, at long, before_a binary, before_b binary, behind_a binary, behind_b binary"


class PieceModel:
    """Ids by a sentencepiece model, of texts cut at sure blanks where no piece of the model spans one."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_pieces = not any(re.search("[^▁]▁", p) for p in pieces)
        self.dtype = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        is_byte = [self.model.is_byte(i) for i in range(len(pieces))]
        self.bytes = [
            bytes([int(p[3:-1], 16)]) if byte else p.replace("▁", " ").encode()
            for p, byte in zip(pieces, is_byte, strict=True)
        ]
        self.pieces = PieceIds(lambda pieces: dict(zip(some := list(pieces), self._whole(some), strict=True)), _PIECES)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, self.dtype).tobytes() for ids in self.model.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.by_pieces:
            found = self.pieces.of([CUT.split(t) if ODD_BLANKS.search(t) else t.split(" ") for t in texts])
        else:
            found = self._whole(texts)
        return [np.frombuffer(x, self.dtype) for x in found]


def _byte_level(first: Encoder) -> list[bytes]:
    """The bytes of each token of a byte-level tokenizer."""
    of = {ord(sign): bytes([b]) for b, sign in enumerate(byte_signs())}
    size = first.tokenizer.get_vocab_size(True)
    names = [first.tokenizer.id_to_token(i) or "" for i in range(size)]
    return [b"".join(of.get(ord(c), c.encode()) for c in name) for name in names]


class Pairing:
    """Both tokenizers, the bytes of their tokens, and how ids are written."""

    def __init__(self, first: str, second: str):
        self.first, self.second = encoder(first, True, most_pieces=_PIECES), PieceModel(second)
        self.a, self.b = (_Vocabulary(x) for x in (_byte_level(self.first), self.second.bytes))
        # Bits of a second id, and of an id pair.
        self.shift = len(self.b.size).bit_length()
        self.wide = self.shift + len(self.a.size).bit_length()

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return self.first.encode(texts, blank_before=True), self.second.encode(texts)


class _Vocabulary:
    def __init__(self, tokens: list[bytes]):
        self.bytes = pa.array(tokens, pa.large_binary())
        self.size = np.array([len(t) for t in tokens], np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return bytes(_data(pc.take(self.bytes, pa.array(ids)))[0])


def _data(array: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a fresh binary array one after another, and where each begins and ends."""
    offsets = np.frombuffer(array.buffers()[1], np.int64)[: len(array) + 1] if len(array) else np.zeros(1, np.int64)
    return memoryview(array.buffers()[2] or b"").cast("B")[: offsets[-1]], offsets


@functools.cache
def _pairing(first: str, second: str) -> Pairing:
    return Pairing(first, second)


@functools.cache
def _written(n_a: int, n_b: int) -> pa.Array:
    """Every id as text with what may follow it: a comma, or the end of its side."""
    return pa.array(
        [f"{i}{end}".encode() for n, last in ((n_a, "|"), (n_b, ";")) for end in (",", last) for i in range(n)],
        pa.large_binary(),
    )


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 as the bytes that they need, all lowest bytes first."""
    wide = np.ascontiguousarray(numbers, "<u8")
    width = max(1, (int(wide.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + wide.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.view("<i8").ravel()


def _summed(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their times (1 each, if not given)."""
    if times is None:
        return np.unique(keys, return_counts=True)
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(times, first)


def _products(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The id pairs of one group with their number of links."""
    (a, of_a), (b, of_b) = (np.unique(x.astype(np.int64), return_counts=True) for x in (a, b))
    return ((a << shift)[:, None] | b[None, :]).ravel(), (of_a[:, None] * of_b[None, :]).ravel()


class Groups:
    """The groups of texts laid end to end, from their ids and the ends of tokens. ``docs`` are the numbers
    of tokens of each text on both sides. Every text ends at a common end."""

    def __init__(self, pairing: Pairing, a: np.ndarray, b: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray):
        self.pairing, self.a, self.b = pairing, a.astype(np.int64), b.astype(np.int64)
        end_a, end_b = pairing.a.size[a].cumsum(), pairing.b.size[b].cumsum()
        mark = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, np.uint8)
        mark[end_a] = 1
        mark[end_b] |= 2
        self.last_a, self.last_b = mark[end_a] == 3, mark[end_b] == 3
        self.group_a = self.last_a.cumsum() - self.last_a
        self.group_b = self.last_b.cumsum() - self.last_b
        self.n_groups = int(self.last_a.sum())
        self.na = np.bincount(self.group_a, minlength=self.n_groups)
        self.nb = np.bincount(self.group_b, minlength=self.n_groups)
        self.to_a, self.to_b = np.r_[0, docs_a.cumsum()], np.r_[0, docs_b.cumsum()]
        self.to_group = np.r_[0, self.last_a.cumsum()][self.to_a]

    def links(self) -> np.ndarray:
        return np.diff(np.r_[0, (self.na * self.nb).cumsum()][self.to_group])

    def written(self) -> list[memoryview]:
        """Each text's groups, written out."""
        n_a, n_b = len(self.pairing.a.size), len(self.pairing.b.size)
        upto_b, upto_a = np.r_[0, self.nb.cumsum()], np.r_[0, self.na.cumsum()]
        number = np.empty(len(self.a) + len(self.b), np.int64)
        number[np.arange(len(self.a)) + upto_b[self.group_a]] = self.a + n_a * self.last_a
        number[np.arange(len(self.b)) + upto_a[self.group_b + 1]] = 2 * n_a + self.b + n_b * self.last_b
        data, starts = _data(pc.take(_written(n_a, n_b), pa.array(number)))
        places = starts[self.to_a + self.to_b].tolist()
        return [data[low : max(low, high - 1)] for low, high in itertools.pairwise(places)]

    def pairs(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's distinct id pairs in order, with their numbers of links."""
        shift, wide = self.pairing.shift, self.pairing.wide
        doc = np.repeat(np.arange(len(self.to_a) - 1), np.diff(self.to_a))
        # Side by side where groups are small; a large group by its distinct ids on either side.
        small = (self.na * self.nb <= _EXPANDED)[self.group_a]
        times = self.nb[self.group_a[small]]
        begin_b = np.r_[0, self.nb.cumsum()][self.group_a[small]]
        offset = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
        keys = np.repeat((doc[small] << wide) | (self.a[small] << shift), times) | self.b[np.repeat(begin_b, times) + offset]
        keys, found = _summed(keys)
        large = np.flatnonzero(self.na * self.nb > _EXPANDED)
        if len(large):
            begin_a, begin_b = np.r_[0, self.na.cumsum()], np.r_[0, self.nb.cumsum()]
            parts = [(keys, found)]
            for g in large.tolist():
                a, b = self.a[begin_a[g] : begin_a[g + 1]], self.b[begin_b[g] : begin_b[g + 1]]
                more, often = _products(a, b, shift)
                parts.append((more | (int(doc[begin_a[g]]) << wide), often))
            keys, found = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        cuts = np.searchsorted(keys, np.arange(len(self.to_a)) << wide)
        keys = keys & ((1 << wide) - 1)
        return [(keys[low:high], found[low:high]) for low, high in itertools.pairwise(cuts.tolist())]


def _pair_bytes(pairs: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, bytes]:
    return packed(np.diff(pairs[0], prepend=0)), packed(pairs[1])


def _pairs_of(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    return unpacked(pairs).cumsum(), unpacked(times)


_NOTHING = (*[0] * len(_COUNTS), "", *_pair_bytes((np.zeros(0, np.int64),) * 2))


def _whole_rows(pairing: Pairing, texts: list[str]) -> list[tuple]:
    """The columns of short texts, from n_a on."""
    rows = [_NOTHING] * len(texts)
    a, b = pairing.tokens(texts)
    fit = []
    for i, text in enumerate(texts):
        data = b" " + text.encode()
        if text and pairing.a.joined(a[i]) == data and pairing.b.joined(b[i]) == data:
            fit.append(i)
    if not fit:
        return rows
    a, b = [a[i] for i in fit], [b[i] for i in fit]
    n_a, n_b = (np.array([len(x) for x in ids]) for ids in (a, b))
    groups = Groups(pairing, np.concatenate(a), np.concatenate(b), n_a, n_b)
    columns = zip(
        fit, n_a.tolist(), n_b.tolist(), np.diff(groups.to_group).tolist(), groups.links().tolist(), groups.written(),
        groups.pairs(), strict=True,
    )
    for i, *counts, written, pairs in columns:
        rows[i] = (*counts, hashlib.sha256(written).hexdigest(), *_pair_bytes(pairs))
    return rows


def _is_cut(data: bytes, at: int) -> bool:
    """Whether a blank at ``at`` stands between two characters that are no white space."""
    if at <= 0 or at + 1 >= len(data) or data[at] != 0x20:
        return False
    near = data[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:] + " " + data[at + 1 : at + 5].decode("utf-8", "ignore")[:1]
    return CUT.search(near) is not None


def _cut_near(data: bytes, at: int, reach: int) -> tuple[int, int] | None:
    """The sure cuts at or before and at or behind a place, if no more than ``reach`` bytes apart."""
    low = at
    while low >= 0 and low >= at - reach and not _is_cut(data, low):
        low = data.rfind(b" ", max(0, at - reach), low)
    high = at
    while 0 <= high <= at + reach and not _is_cut(data, high):
        high = data.find(b" ", high + 1, at + reach)
    if low < max(0, at - reach) or high < 0 or high - low > reach:
        return None
    return low, high


def chunks(text: str, chunk_bytes: int) -> list[tuple[int, int, bytes]]:
    """Byte ranges of blank and text as (low, high, stretch): the tokens that end behind byte ``low`` of the
    stretch and no further than ``high`` belong to the chunk, and the stretch is from sure cut to sure cut.

    Ranges end at every ``chunk_bytes`` bytes, whatever stands there; where no sure cut is near, the next
    range takes both.
    """
    data = b" " + text.encode()
    bounds = [(0, 0, 0)]
    for at in range(chunk_bytes, len(data), chunk_bytes):
        near = _cut_near(data, at, chunk_bytes)
        if near:
            bounds.append((at, *near))
    bounds.append((len(data),) * 3)
    return [
        (low - begin, high - begin, data[begin:end]) for (low, begin, _), (high, _, end) in itertools.pairwise(bounds)
    ]


def _first_pass(paths: tuple[str, str], chunk_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to finished rows, or to chunks where they are long."""
    pairing = _pairing(*paths)
    key = TaskContext.get().partitionId() << 33
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        start = 0
        while start < len(texts):
            end, held, short, rows = start, 0, [], []
            while end < len(texts) and held < _AT_ONCE:
                size = len(texts[end])
                if size < chunk_bytes and (4 * size < chunk_bytes or len(texts[end].encode()) < chunk_bytes):
                    short.append(end)
                held += size
                end += 1
            for i, columns in zip(short, _whole_rows(pairing, [texts[i] for i in short]), strict=True):
                rows.append((key + i, ids[i], *columns, None, None, None, None))
            for i in sorted(set(range(start, end)).difference(short)):
                for n, (low, high, stretch) in enumerate(chunks(texts[i], chunk_bytes)):
                    rows.append((key + i, ids[i], *[None] * 7, n, low, high, stretch))
            yield _batch(_FIRST, rows)
            start = end
        key += len(texts)


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(",")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields]
    )


def fragment(pairing: Pairing, a: np.ndarray, b: np.ndarray, low: int, high: int) -> dict:
    """The fragment of the tokens that end in bytes (low, high] of a stretch encoded as ``a`` and ``b``."""
    end_a, end_b = pairing.a.size[a].cumsum(), pairing.b.size[b].cumsum()
    in_a, in_b = ((x > low) & (x <= high) for x in (end_a, end_b))
    a, b, end_a, end_b = a[in_a], b[in_b], end_a[in_a], end_b[in_b]
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    if not len(common):
        return {"closed": False, "before": (a, b), "inner": None, "behind": (a[:0], b[:0])}
    first_a, last_a = np.searchsorted(end_a, [common[0], common[-1]]) + 1
    first_b, last_b = np.searchsorted(end_b, [common[0], common[-1]]) + 1
    inner_a, inner_b = a[first_a:last_a], b[first_b:last_b]
    inner = Groups(pairing, inner_a, inner_b, np.array([len(inner_a)]), np.array([len(inner_b)]))
    return {"closed": True, "before": (a[:first_a], b[:first_b]), "inner": inner, "behind": (a[last_a:], b[last_b:])}


def _leaves(paths: tuple[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks to their fragments: what is closed, and the open ends."""
    pairing = _pairing(*paths)
    for batch in itertools.chain.from_iterable(map(_sliced, batches)):
        rows, chunked = [], batch.to_pylist()
        for r, a, b in zip(chunked, *pairing.tokens([r["text"][1:].decode() for r in chunked]), strict=True):
            ok = pairing.a.joined(a) == r["text"] and pairing.b.joined(b) == r["text"]
            f = fragment(pairing, a, b, r["low"], r["high"]) if ok else fragment(pairing, a[:0], b[:0], 0, 0)
            sides = [x.astype("<u4").tobytes() for side in (f["before"], f["behind"]) for x in side]
            counts, written, pairs = [0, 0, 0, 0], b"", _NOTHING[-2:]
            if f["inner"] is not None:
                g = f["inner"]
                counts = [len(g.a), len(g.b), g.n_groups, int(g.links()[0])]
                written, pairs = bytes(g.written()[0]), _pair_bytes(g.pairs()[0])
            rows.append((r["key"], r["chunk"], ok, *counts, written, *pairs, r["chunk"], f["closed"], r["chunk"], *sides))
        yield _batch(f"{_LEAF}, {_OPEN.removeprefix('key long, ')}", rows)


def compose(left: dict, right: dict) -> tuple[dict, dict | None]:
    """Two neighbouring fragments as one, and the group that closes at their seam, if any.

    A fragment here is its open ends: ``closed`` (whether it holds a common end), ``at`` (where its first
    one stands), ``before`` and ``behind`` as pairs of bytes.
    """
    join = lambda x, y: (x[0] + y[0], x[1] + y[1])
    if not left["closed"]:
        return right | {"before": join(left["before"], right["before"])}, None
    if not right["closed"]:
        return left | {"behind": join(left["behind"], right["before"])}, None
    seam = {"at": right["at"], "group": join(left["behind"], right["before"])}
    return left | {"behind": right["behind"]}, seam


def _composed(table: pa.Table) -> pa.Table:
    """Neighbouring fragments of one document to one, with the groups closed between them (no place)."""
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    found, out = None, []
    for r in rows:
        right = {
            "closed": r["closed"], "at": r["at"], "before": (r["before_a"], r["before_b"]),
            "behind": (r["behind_a"], r["behind_b"]),
        }
        found, seam = compose(found, right) if found else (right, None)
        if seam:
            out.append((r["key"], None, True, seam["at"], *seam["group"], b"", b""))
    first = rows[0]
    out.append((first["key"], first["place"] // FAN, found["closed"], found["at"], *found["before"], *found["behind"]))
    return pa.Table.from_batches([_batch(_OPEN, out)])


def _finished(paths: tuple[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Closed parts in order of document and place to one row per document."""
    pairing = _pairing(*paths)
    rows = (r for batch in batches for some in _sliced(batch) for r in some.to_pylist())
    for key, parts in itertools.groupby(rows, key=lambda r: r["key"]):
        ok, counts, digest, between = True, np.zeros(4, np.int64), hashlib.sha256(), b""
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in parts:
            if r["groups"] is None:  # a group closed at a seam
                a, b = (np.frombuffer(r[c], "<u4") for c in ("before_a", "before_b"))
                found = [len(a), len(b), 1, len(a) * len(b)]
                written = b"%s|%s" % tuple(",".join(map(str, x.tolist())).encode() for x in (a, b))
                more = _products(a, b, pairing.shift)
            else:
                ok &= r["ok"]
                found, written, more = [r[c] for c in _COUNTS], r["groups"], _pairs_of(r["pairs"], r["times"])
            counts += found
            if written:
                digest.update(between + written)
                between = b";"
            keys, times = _summed(np.r_[keys, more[0]], np.r_[times, more[1]])
        columns = (*counts.tolist(), digest.hexdigest(), *_pair_bytes((keys, times))) if ok else _NOTHING
        yield _batch(_ROW, [(key, None, *columns)])


def _sliced(batch: pa.RecordBatch, rows: int = 50) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _long_documents(chunked: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Chunks of long documents to rows like those of short ones, by a tree of compositions."""
    most = chunked.agg(F.max("chunk")).first()[0]
    schema = f"{_LEAF}, {_OPEN.removeprefix('key long, ')}"
    dealt = chunked.select("key", "chunk", "low", "high", "text").repartition("key", "chunk")
    leaves = stored(dealt.mapInArrow(functools.partial(_leaves, paths), schema), "alignment-leaves")
    names = [f.split()[0] for f in _OPEN.split(", ")]
    open_, seams = leaves.select(*names), []
    while True:
        level = open_.groupBy("key", F.floor(F.col("place") / FAN).alias("node")).applyInArrow(_composed, _OPEN)
        level = stored(level, "alignment-level")
        seams.append(level.where("place is null"))
        open_, most = level.where("place is not null"), most // FAN
        if not most:
            break
    # The beginning of a text is a common end, so the open prefix of the whole is its first group.
    seams.append(open_.where("closed"))
    closed = functools.reduce(DataFrame.unionByName, seams).select("key", "at", "before_a", "before_b", F.lit(0).alias("rank"))
    inner = leaves.select(*[f.split()[0] for f in _LEAF.split(", ")], F.col("chunk").alias("at"), F.lit(1).alias("rank"))
    parts = inner.unionByName(closed, allowMissingColumns=True).repartition("key")
    parts = parts.sortWithinPartitions("key", "at", "rank")
    finished = stored(parts.mapInArrow(functools.partial(_finished, paths), _ROW), "alignment-long")
    ids = chunked.where("chunk = 0").select("key", "doc_id")
    return finished.drop("doc_id").join(ids, "key").select(finished.columns)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a task hold each pair, in parts of bounded size."""
    schema = "pair long, n long"
    keys, times, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        more = _summed(np.concatenate(waiting)) if waiting else (keys[:0], times[:0])
        return _summed(np.r_[keys, more[0]], np.r_[times, more[1]])

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], [f.split()[0] for f in schema.split(", ")])

    for batch in batches:
        for pairs in batch.column(0).to_pylist():
            waiting.append(unpacked(pairs).cumsum())
            held += len(waiting[-1])
            if held >= _COUNTED:
                (keys, times), waiting, held = merged(), [], 0
                if len(keys) >= _COUNTED:
                    yield out()
                    keys, times = keys[:0], times[:0]
    keys, times = merged()
    yield out()


def _plan(entries: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each first id the number of its range, and for each range its number of cells."""
    range_of, sums, held = np.zeros(len(entries), np.int64), [0], 0
    for i, (e, d) in enumerate(zip(entries.tolist(), distinct.tolist(), strict=True)):
        if held and (held + d > CELL_PAIRS or sums[-1] + e > CELL_ENTRIES):
            sums.append(0)
            held = 0
        sums[-1] += e
        held += d
        range_of[i] = len(sums) - 1
    return range_of, np.maximum(1, -(-np.array(sums) // CELL_ENTRIES))


_CELL = "range long, cell long, bundle long, keys binary, sizes binary, pairs binary, times binary"


def _cells(shift: int, range_of: np.ndarray, cells: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' pairs by range of first ids, a bundle of many documents a row."""
    part = turn = TaskContext.get().partitionId()
    bundle = part << 32

    def out(docs: list[tuple]) -> pa.RecordBatch:
        sizes = [len(pairs) for _, pairs, _ in docs]
        doc = np.repeat(np.arange(len(docs)), sizes)
        pairs, times = (np.concatenate([d[i] for d in docs]) for i in (1, 2))
        ranges = range_of[pairs >> shift]
        order = np.argsort(ranges, kind="stable")
        doc, pairs, times, ranges = doc[order], pairs[order], times[order], ranges[order]
        keys = np.array([d[0] for d in docs], np.int64)
        rows = []
        edges = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1], True])
        for low, high in itertools.pairwise(edges.tolist()):
            here, n = doc[low:high], int(ranges[low])
            first = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            steps = np.diff(pairs[low:high], prepend=0)
            steps[first] = pairs[low:high][first]
            rows.append((
                n, (turn + n) % int(cells[n]), bundle, packed(keys[here[first]]), packed(np.diff(np.r_[first, high - low])),
                packed(steps), packed(times[low:high]),
            ))
        return _batch(_CELL, rows)

    docs, held = [], 0
    for batch in batches:
        for key, pairs, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            docs.append((key, *_pairs_of(pairs, times)))
            held += len(docs[-1][1])
            if held >= _COUNTED:
                yield out(docs)
                docs, held, turn, bundle = [], 0, turn + 1, bundle + 1
    if held:
        yield out(docs)


_SUMS = "bundle long, keys binary, n_best binary, count_sum binary"


def _met(shift: int, documents: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents' pairs of one cell with the counts of its range: partial sums, still a bundle a row."""
    pairs, n = (counts.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.r_[True, (pairs >> shift)[1:] != (pairs >> shift)[:-1]])
    highest = np.repeat(np.maximum.reduceat(n, first), np.diff(np.r_[first, len(pairs)])) == n
    rows = []
    for r in documents.select(["bundle", "keys", "sizes", "pairs", "times"]).to_batches(max_chunksize=16):
        for bundle, keys, sizes, steps, times in zip(*(c.to_pylist() for c in r.columns), strict=True):
            sizes, steps, times = unpacked(sizes), unpacked(steps), unpacked(times)
            starts = sizes.cumsum() - sizes
            sums = steps.cumsum()
            found = np.searchsorted(pairs, sums - np.repeat(sums[starts] - steps[starts], sizes))
            best, total = (np.add.reduceat(x, starts) for x in (times * highest[found], times * n[found]))
            rows.append((bundle, keys, packed(best), packed(total)))
    return pa.Table.from_batches([_batch(_SUMS, rows)])


def _added(table: pa.Table) -> pa.Table:
    """The sums of one bundle's documents over all its cells."""
    keys, best, total = (np.concatenate([unpacked(x) for x in table.column(c).to_pylist()]) for c in ("keys", "n_best", "count_sum"))
    order = np.argsort(keys, kind="stable")
    keys, best, total = keys[order], best[order], total[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sums = [np.add.reduceat(x, first) for x in (best, total)]
    return pa.table([keys[first], *sums], names=["key", "n_best", "count_sum"])


def align(
    docs: DataFrame,
    first: str | None = None,
    second: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a and n_b (tokens), n_groups, n_links (pairs of tokens that
    share a group), n_best (links whose pair is in as many documents as any of its first id), count_sum (over
    links, the number of documents that hold the pair linked) and groups_sha256 (of the groups written as
    ``a1,a2|b1;a3|b2,b3``).

    ``first`` is a byte-level file of the tokenizers library and encodes a blank and the text, ``second`` a
    sentencepiece model, which adds that blank. Strings of special tokens in a text are plain text. A text
    that is NULL or empty, or whose tokens of either side do not spell it, has zeros and an empty digest.
    Every row is a document of its own in the counts, also if rows are repeated, share an id or have none.
    A very long text is aligned in byte ranges by different tasks; only a stretch without any sure cut
    (a blank between visible characters) is encoded by one. An empty table gives no rows; other columns of
    ``docs`` are not looked at.
    """
    paths = (
        first or str(public_tokenizers.path("byte_bpe_50k.json")),
        second or str(public_tokenizers.path("piece_bpe_32k.model")),
    )
    pairing = _pairing(*paths)
    shift, n_first = pairing.shift, len(pairing.a.size)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = stored(plain.mapInArrow(functools.partial(_first_pass, paths, chunk_bytes), _FIRST), "alignment")
    chunked = found.where("chunk is not null")
    rows = found.where("chunk is null").select([f.split()[0] for f in _ROW.split(", ")])
    if chunked.limit(1).count():
        rows = rows.unionByName(_long_documents(chunked, paths))
    held = rows.where("n_links > 0")
    counts = held.select("pairs").mapInArrow(_counted, "pair long, n long")
    counts = stored(counts.groupBy("pair").agg(F.sum("n").alias("n")), "alignment-counts")
    # One row per first id: bounded by the vocabulary.
    per_first = counts.groupBy(F.shiftright("pair", shift).alias("a")).agg(F.sum("n").alias("e"), F.count("*").alias("d")).collect()
    entries, distinct = np.zeros((2, n_first), np.int64)
    for r in per_first:
        entries[r["a"]], distinct[r["a"]] = r["e"], r["d"]
    range_of, cells = _plan(entries, distinct)
    met = pa.table({"a": range(n_first), "range": range_of, "cells": cells[range_of]})
    plan = docs.sparkSession.createDataFrame(met)
    ranged = counts.withColumn("a", F.shiftright("pair", shift)).join(F.broadcast(plan), "a")
    ranged = ranged.select("pair", "n", "range", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"))
    dealt = held.select("key", "pairs", "times").mapInArrow(functools.partial(_cells, shift, range_of, cells), _CELL)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return _met(shift, left, right) if left.num_rows else pa.Table.from_batches([_batch(_SUMS, [])])

    sums = (
        dealt.groupBy("range", "cell")
        .cogroup(ranged.groupBy("range", "cell"))
        .applyInArrow(meet, _SUMS)
        .groupBy("bundle")
        .applyInArrow(_added, "key long, n_best long, count_sum long")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    joined = rows.join(sums, "key", "left")
    return joined.select("doc_id", *_COUNTS, zero("n_best"), zero("count_sum"), "groups_sha256")

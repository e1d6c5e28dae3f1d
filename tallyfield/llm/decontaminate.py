"""Benchmark decontamination by a size-partitioned MinHash containment search.

Test items are short and documents long, so the Jaccard similarity of the two says little. Items are
partitioned by size, and for each partition a document is seen as windows whose length fits it: blocks
of B shingles (B: the power of two that holds the partition's items), each window two neighbouring
blocks, so that any run of B shingles lies in one window. A window has at most 4 times as many shingles
as an item, which bounds the similarity of an item contained to 0.8 from below at 0.19; of ``HASHES``
independent minima one agrees with probability 0.99996 (0.999999 for a verbatim copy). A document and an
item that share a minimum are a candidate; the item's exact share of shingles in the whole document
decides.

Items are looked up inside the tasks that read the documents: no document is shuffled. They travel in
blocks of a bounded number of words; more items mean more blocks, each of which reads the documents once.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import n_words, stored
from tallyfield.llm.shingles import multipliers, shingle_hashes, word_hashes, words_of

HASHES = 48
WIDTH = 5
SHARE = (80, 100)
BLOCK_WORDS = 2_000_000
# Shingles whose minima are taken at a time: bounds the memory of a long document.
_AT_ONCE = 1 << 15
_FILTER_BITS = 20


class ItemBlock:
    """The items of one block: shingle sets, and their minima by size partition."""

    def __init__(self, items: list[tuple[int | None, bytes]], width: int):
        self.width = width
        self.factors = multipliers(HASHES, 7)
        self.ids = [item for item, _ in items]
        self.sets = [np.unique(shingle_hashes(word_hashes(words_of(t)), width)) for _, t in items]
        self.minima: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for number, found in enumerate(self.sets):
            if len(found):
                size = 1 << (len(found) - 1).bit_length()
                for value in np.multiply.outer(self.factors, found).min(axis=1).tolist():
                    self.minima[size][value].append(number)
        self.minima = {size: dict(values) for size, values in self.minima.items()}
        self.filters = {}
        for size, values in self.minima.items():
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[np.fromiter(values, np.uint64) & np.uint64((1 << _FILTER_BITS) - 1)] = True
            self.filters[size] = seen

    def candidates(self, shingles: np.ndarray) -> set[int]:
        """Items that share a minimum with a window of the document."""
        found: set[int] = set()
        if not self.minima or not len(shingles):
            return found
        least = min(self.minima)
        step = max(_AT_ONCE // least, 1) * least
        parts = []
        for start in range(0, len(shingles), step):
            part = shingles[start : start + step]
            hashed = np.multiply.outer(self.factors, part)
            parts.append(np.minimum.reduceat(hashed, np.arange(0, len(part), least), axis=1))
        blocks = np.concatenate(parts, axis=1) if len(parts) > 1 else parts[0]
        size, most = least, max(self.minima)
        while True:
            if size in self.minima:
                windows = np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks
                hit = windows[self.filters[size][windows & np.uint64((1 << _FILTER_BITS) - 1)]]
                for value in np.unique(hit).tolist():
                    found.update(self.minima[size].get(value, ()))
            if size >= most:
                return found
            if blocks.shape[1] > 1:
                blocks = np.minimum.reduceat(blocks, np.arange(0, blocks.shape[1], 2), axis=1)
            size *= 2

    def search(self, text: bytes | None, share: tuple[int, int]) -> Iterator[tuple[int, int]]:
        """(number of the item, shingles of it that the text holds) for every item contained."""
        shingles = shingle_hashes(word_hashes(words_of(text)), self.width)
        candidates = self.candidates(shingles)
        if candidates:
            whole = np.unique(shingles)
            for number in sorted(candidates):
                item = self.sets[number]
                held = int(np.isin(item, whole, assume_unique=True).sum())
                if held * share[1] >= len(item) * share[0]:
                    yield number, held


def _search(items, width: int, share: tuple[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = ItemBlock(items.value, width)
    for batch in batches:
        columns: tuple[list, ...] = ([], [], [], [])
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            for number, held in block.search(text.as_py(), share):
                for column, value in zip(columns, (doc_id, block.ids[number], held, len(block.sets[number])), strict=True):
                    column.append(value)
        arrays = [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "n_shared", "n_shingles"])


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    share: tuple[int, int] = SHARE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Rows (doc_id, item_id, n_shared, n_shingles) for each item of whose distinct shingles a document
    holds at least ``share``.

    Words are runs of non-blank characters, A-Z lower-cased. An item of fewer than ``width`` words is
    one shingle and found in documents of just these words; an item without words, or a NULL text on
    either side, is never found. Repeated rows on either side give repeated results; NULL ids are
    returned as they are; very long texts are searched whole; an empty table on either side gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    short = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    short = short.where(n_words(F.col("text")) > 0)
    # Equal texts are one item until the end, so that repeated items do not fill a block.
    short = short.withColumn("text_hash", F.xxhash64("text"))
    texts = stored(short.select("text", "text_hash").distinct(), "item-texts")
    words = texts.agg(F.sum(n_words(F.col("text")))).first()[0] or 0
    blocks = max(1, math.ceil(words / block_words))
    schema = "doc_id long, text_hash long, n_shared long, n_shingles long"
    found = []
    for number in range(blocks):
        # One block at a time: its words are bounded, so is what the driver and the tasks hold.
        block = texts.where(F.pmod("text_hash", F.lit(blocks)) == number)
        rows = [(r["text_hash"], r["text"].encode()) for r in block.collect()]
        sent = spark.sparkContext.broadcast(rows)
        found.append(plain.mapInArrow(functools.partial(_search, sent, width, share), schema))
    every = functools.reduce(DataFrame.unionByName, found)
    named = every.join(short.select("item_id", "text_hash"), "text_hash")
    return named.select("doc_id", "item_id", "n_shared", "n_shingles")


def without_items(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """``docs`` without those that contain a test item. Rows of one id go together; rows without an
    id cannot be named in a result and stay."""
    name = parameters.get("doc_id", "doc_id")
    leaks = contained_items(docs, items, **parameters).select(F.col("doc_id").alias("leak_id")).distinct()
    return docs.join(leaks, docs[name] == leaks["leak_id"], "left_anti")

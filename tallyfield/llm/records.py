"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A record file is a sequence of frames:

    length of the payload   8 bytes, little-endian
    masked checksum of those 8 bytes   4 bytes
    payload
    masked checksum of the payload   4 bytes
    end mark, one line feed   1 byte

The payload is one document: a flag byte (1: it has an id), the id (8 bytes), the bytes of one token
id (2 or 4, by the size of the vocabulary) and the token ids, all little-endian. Checksums are CRC-32,
masked by a rotation and an addition, so that a checksum stored in checked data does no harm.

Files are written by Spark's own text writer from raw bytes (which ends each row with the end mark),
hence through the same commit protocol and to the same file systems as any table. Shards are in
ascending order of document ids, and each holds about ``SHARD_BYTES``. The index, a Parquet table, is
built from the written files: shard, record, offset, length, id, number of tokens, and the number of
tokens before.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import stored
from tallyfield.llm.tokens import encoder

SHARD_BYTES = 8 * 1024 * 1024
END_ID = 2
# Rows encoded together: at most so many, of about so many bytes of text.
_AT_ONCE = 2_000
_BYTES_AT_ONCE = 4_000_000
MARK = b"\n"
_LENGTH = struct.Struct("<Q")
_SUM = struct.Struct("<I")
_HEAD = struct.Struct("<BqB")
FRAME_BYTES = _LENGTH.size + 2 * _SUM.size + len(MARK)
_MASK_DELTA = 0xA282EAD8  # fixed value of the masking rule


def masked_sum(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A frame without its end mark, which the writer adds."""
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _SUM.pack(masked_sum(length)), payload, _SUM.pack(masked_sum(payload))))


def unframe(data: memoryview, offset: int) -> tuple[memoryview, int]:
    """The payload of the frame at ``offset`` and where the next frame begins; raises if damaged."""
    length = data[offset : offset + _LENGTH.size]
    start = offset + _LENGTH.size + _SUM.size
    if len(length) < _LENGTH.size or _SUM.unpack(data[start - _SUM.size : start])[0] != masked_sum(length):
        raise ValueError(f"damaged length at {offset}")
    end = start + _LENGTH.unpack(length)[0]
    payload = data[start:end]
    if bytes(data[end + _SUM.size : end + _SUM.size + len(MARK)]) != MARK:
        raise ValueError(f"cut-off record at {offset}")
    if _SUM.unpack(data[end : end + _SUM.size])[0] != masked_sum(payload):
        raise ValueError(f"damaged record at {offset}")
    return payload, end + _SUM.size + len(MARK)


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    head = _HEAD.pack(doc_id is not None, doc_id or 0, ids.dtype.itemsize)
    return head + ids.astype(ids.dtype.newbyteorder("<")).tobytes()


def ids_of(payload: memoryview) -> tuple[int | None, np.ndarray]:
    has, doc_id, width = _HEAD.unpack(payload[: _HEAD.size])
    return (doc_id if has else None), np.frombuffer(payload[_HEAD.size :], f"<u{width}").astype("<u4")


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts are encoded together; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and (row - start == _AT_ONCE or held + size > _BYTES_AT_ONCE):
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def _frames(
    path: str, end_id: int, shard_bytes: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    ids_by = encoder(path)
    part = TaskContext.get().partitionId()
    shard, held, row = 0, 0, 0
    for batch in batches:
        for some in _cut(batch):
            shards, rows, frames = [], [], []
            for doc_id, ids in zip(some.column(0).to_pylist(), ids_by.encode_column(some.column(1)), strict=True):
                ids = np.append(ids, np.array([end_id], ids.dtype))
                framed = frame(payload_of(doc_id, ids))
                if held and held + len(framed) > shard_bytes:
                    shard, held = shard + 1, 0
                held += len(framed) + len(MARK)
                shards.append((part << 32) + shard)
                rows.append(row)
                frames.append(framed)
                row += 1
            yield _frame_batch(shards, rows, frames)


def _frame_batch(shards: list[int], rows: list[int], frames: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(shards, pa.int64()), pa.array(rows, pa.int64()), pa.array(frames, pa.binary())],
        ["shard", "row", "frame"],
    )


def write_records(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    shard_bytes: int = SHARD_BYTES,
    partitions: int | None = None,
) -> None:
    """Encodes every text with the tokenizer file, appends ``end_id``, and writes record files under
    ``path``, one folder a shard, in ascending order of ids.

    Ids are those of the library's plain ``encode(text, add_special_tokens=False)``, whatever the
    tokenizer: the text of a special token becomes that token.

    Rows without an id come first; a NULL or empty text is the end id alone; repeated rows are
    records of their own, in no order among themselves that matters; a very long
    text is one record, in a shard of its own if it exceeds one; an empty table writes no shard.
    Ranges are cut by id, then by text, then at random, so that one id in many rows is spread too.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or str(public_tokenizers.path("byte_bpe_50k.json"))
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text"), F.rand(1)]
    ordered = plain.repartitionByRange(partitions, *order).sortWithinPartitions("doc_id", F.xxhash64("text"))
    framed = ordered.mapInArrow(
        functools.partial(_frames, tokenizer, end_id, shard_bytes), "shard long, row long, frame binary"
    )
    # Already in this order; saying so keeps the writer from sorting by shard alone.
    framed = framed.sortWithinPartitions("shard", "row").select("shard", F.col("frame").cast("string").alias("value"))
    framed.write.partitionBy("shard").option("lineSep", MARK.decode()).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    shard = F.regexp_extract("path", r"shard=(\d+)", 1).cast("long")
    return found.where(F.col("path").contains("shard=")).select(shard.alias("shard"), "content")


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = memoryview(content.as_buffer())
            columns: tuple[list, ...] = ([], [], [], [], [])
            offset, record = 0, 0
            while offset < len(data):
                payload, after = unframe(data, offset)
                doc_id, ids = ids_of(payload)
                for column, value in zip(columns, (record, offset, after - offset, doc_id, len(ids)), strict=True):
                    column.append(value)
                offset, record = after, record + 1
            arrays = [pa.array([shard] * record, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, ["shard", "record", "offset", "length", "doc_id", "n_tokens"])


def write_index(spark: SparkSession, path: str, index_path: str) -> None:
    """Reads and checks the record files under ``path`` and writes their offset index.

    Tokens before a record: running sums within each shard, on top of the sums of the shards before
    (one row per shard of ``SHARD_BYTES`` stands in that window).
    """
    schema = "shard long, record long, offset long, length long, doc_id long, n_tokens long"
    rows = stored(_files(spark, path).mapInArrow(_indexed, schema), "record-places")
    per_shard = rows.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_shard.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("shard_start"))
    here = Window.partitionBy("shard").orderBy("record").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("within", F.sum("n_tokens").over(here) - F.col("n_tokens"))
    index = within.join(starts, "shard").withColumn("start", F.col("shard_start") + F.col("within"))
    index.drop("within", "shard_start").write.parquet(index_path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content, entries in reading order) to records."""
    for batch in batches:
        for content, entries in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            data = memoryview(content.as_buffer())
            for start in range(0, len(entries), 1_000):
                part = entries[start : start + 1_000]
                docs, ids = [], []
                for entry in part:
                    doc_id, found = ids_of(unframe(data, entry["offset"])[0])
                    docs.append(doc_id)
                    ids.append(found.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([e["shard"] for e in part], pa.int64()),
                        pa.array([e["record"] for e in part], pa.int64()),
                        pa.array(docs, pa.int64()),
                        pa.array([e["start"] for e in part], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["shard", "record", "doc_id", "start", "ids"],
                )


def read_records(spark: SparkSession, path: str, index_path: str, shuffle_seed: int | None = None) -> DataFrame:
    """Records under ``path`` found through their index: shard, record, doc_id, start, ids (32-bit
    little-endian). With a seed, the records of every shard come in an order drawn from it."""
    index = spark.read.parquet(index_path)
    place = F.col("record") if shuffle_seed is None else F.xxhash64(F.lit(shuffle_seed), "shard", "record")
    entry = F.struct(place.alias("place"), "shard", "record", "offset", "start")
    entries = index.groupBy("shard").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    met = _files(spark, path).join(entries, "shard").select("content", "entries")
    return met.mapInArrow(_read, "shard long, record long, doc_id long, start long, ids binary")


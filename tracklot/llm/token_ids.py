"""Token-id files: Simple-8b word-aligned coding (Anh and Moffat 2010), decoded a block at a time with numpy.

A 64-bit word holds a 4-bit selector and 60 bits of equally wide values; the selector names how many. Ids are coded
in blocks of ``BLOCK_IDS``; a row keeps each block's first word, so any block decodes alone. Values of 60 bits and
more leave a zero in the words and stand in the row's escape lists.

The file is a Parquet table written by Spark (one row per run of whole documents), so a retried task replaces its
own output and any store that Spark reaches will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklot.llm.common import list_array, scratch_path, shuffle_width, table, text_slices
from tracklot.llm.tokens import BYTE_BPE, encoder

#: (values in a word, bits of each) for selectors 0 to 15, as published.
PACKINGS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([c for c, _ in PACKINGS], np.int64)
BLOCK_IDS = 16_384
ROW_IDS = 65_536
ROWS = "shard int, start long, doc_ids array<long>, sizes array<int>, words binary, block_words array<int>, escape_at array<int>, escape_values array<long>"
DOCS = "doc_id long, shard int, start long, n_tokens long, ids_crc32 long"


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value: 0 for 0."""
    high = (values >> np.uint64(30)).astype(np.float64)  # both halves are exact as floats
    low = np.frexp((values & np.uint64((1 << 30) - 1)).astype(np.float64))[1]
    return np.where(high > 0, np.frexp(high)[1] + 30, low).astype(np.int8)


def pack(values: np.ndarray) -> np.ndarray:
    """Simple-8b words (uint64) of values under 2**60: each word takes the longest run that fits."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    width = _widths(values)
    choice = np.full(n, 15, np.int8)
    for k in range(14, -1, -1):
        count, bits = PACKINGS[k]
        fits = np.flatnonzero(width <= bits)
        if len(fits) >= count:
            first = fits[: len(fits) - count + 1]
            choice[first[fits[count - 1 :] - first == count - 1]] = k
    # words begin at 0 and wherever the word before them ends: the path from 0, doubled in each round
    jump = np.append(np.minimum(np.arange(n) + COUNTS[choice], n), n)
    starts = np.zeros(1, np.int64)
    while starts[-1] < n:
        starts, jump = np.concatenate([starts, jump[starts]]), jump[jump]
    starts = starts[: np.searchsorted(starts, n)]
    chosen = choice[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for k in np.unique(chosen):
        count, bits = PACKINGS[k]
        if bits:
            rows = np.flatnonzero(chosen == k)
            shifts = (np.arange(count) * bits).astype(np.uint64)
            words[rows] |= np.bitwise_or.reduce(values[starts[rows][:, None] + np.arange(count)] << shifts, axis=1)
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for k in np.unique(chosen):
        count, bits = PACKINGS[k]
        if bits:
            rows = np.flatnonzero(chosen == k)
            shifts = (np.arange(count) * bits).astype(np.uint64)
            out[(ends[rows] - count)[:, None] + np.arange(count)] = (words[rows][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return out


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, each block's first word, and the escapes' places and values (int64 bits)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    at = np.flatnonzero(ids >> np.uint64(60))
    escapes = ids[at]
    if len(at):
        ids = ids.copy()
        ids[at] = 0
    blocks = [pack(ids[i : i + BLOCK_IDS]) for i in range(0, len(ids), BLOCK_IDS)]
    first = np.cumsum([0, *(len(b) for b in blocks)])[:-1] if blocks else np.zeros(0, np.int64)
    return (np.concatenate(blocks) if blocks else np.zeros(0, np.uint64)), first.astype(np.int32), at.astype(np.int32), escapes.view(np.int64)


def decode_ids(words: np.ndarray, block_words: np.ndarray, escape_at: np.ndarray, escape_values: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
    """Ids ``low`` to ``high`` of a row; only the blocks that hold them are decoded."""
    a = low // BLOCK_IDS
    b = len(block_words) if high is None else -(-high // BLOCK_IDS)
    bounds = np.append(block_words, len(words))
    ids = unpack(words[bounds[a] : bounds[b]]) if b > a else np.zeros(0, np.uint64)
    if len(escape_at):
        here = (escape_at >= a * BLOCK_IDS) & (escape_at < b * BLOCK_IDS)
        ids[escape_at[here] - a * BLOCK_IDS] = escape_values[here].view(np.uint64)
    return ids[low - a * BLOCK_IDS : None if high is None else high - a * BLOCK_IDS]


def _encode(batches: Iterator[pa.RecordBatch], file: str, folder: str | None, end_id: int) -> Iterator[pa.RecordBatch]:
    shard, start = TaskContext.get().partitionId(), 0
    enc = encoder(file, folder)
    schema = pa.schema([("shard", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("block_words", pa.list_(pa.int32())), ("escape_at", pa.list_(pa.int32())), ("escape_values", pa.list_(pa.int64()))])
    end = np.array([end_id], "<u4").tobytes()
    held: list[tuple[int | None, bytes]] = []
    size = 0

    def row() -> pa.RecordBatch:
        nonlocal held, size, start
        words, first, at, values = encode_ids(np.frombuffer(b"".join([x for _, x in held]), "<u4"))
        out = pa.RecordBatch.from_pylist([{"shard": shard, "start": start, "doc_ids": [d for d, _ in held], "sizes": [len(x) // 4 for _, x in held], "words": words.astype("<u8").tobytes(), "block_words": first, "escape_at": at, "escape_values": values}], schema=schema)
        start, held, size = start + size, [], 0
        return out

    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        for low, high, texts in text_slices(batch):
            for d, ids in zip(doc_ids[low:high], enc.encode(texts), strict=True):
                held.append((d, ids + end))
                size += len(held[-1][1]) // 4
                if size >= ROW_IDS:
                    yield row()
    if held:
        yield row()


def write_token_ids(docs: DataFrame, path: str, file: str = BYTE_BPE, end_id: int = 2, folder: str | None = None) -> None:
    """Encode ``docs`` (doc_id, text; other columns are ignored) and write the ids in ascending doc_id order.

    A null text is empty and yields the end id alone; a null doc_id sorts first; rows with equal ids keep the order
    of their texts; an empty table writes an empty file. Shards are consecutive doc_id ranges of even row counts, so
    one source or group of copies cannot make a large shard.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange(shuffle_width(rows), "doc_id").sortWithinPartitions("doc_id", "text")
    coded = ranged.mapInArrow(lambda batches: _encode(batches, file, folder, end_id), ROWS)
    coded.write.option("compression", "zstd").parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            words = np.frombuffer(r["words"], "<u8")
            ids = decode_ids(words, np.array(r["block_words"], np.int64), np.array(r["escape_at"], np.int64), np.array(r["escape_values"], np.int64)).astype("<u4")
            sizes = np.array(r["sizes"], np.int64)
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.record_batch({"doc_id": pa.array(r["doc_ids"], pa.int64()), "shard": pa.array(np.full(len(sizes), r["shard"], np.int32)), "start": pa.array(r["start"] + ends - sizes), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64())})


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = decode_ids(np.frombuffer(r["words"], "<u8"), np.array(r["block_words"], np.int64), np.array(r["escape_at"], np.int64), np.array(r["escape_values"], np.int64))
            yield pa.record_batch({"doc_id": pa.array(r["doc_ids"], pa.int64()), "ids": list_array(np.split(ids.astype(np.int64), np.cumsum(r["sizes"])[:-1]), pa.int64())})


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Each document's ids (doc_id, ids array)."""
    return spark.read.schema(ROWS).parquet(path).mapInArrow(_ids, "doc_id long, ids array<long>")


def describe_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only one total per shard meets in a single task; a shard's offset is the sum of the totals before it.
    """
    rows = spark.read.schema(ROWS).parquet(path)
    totals = rows.groupBy("shard").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    docs = rows.mapInArrow(_decode, DOCS)
    # one row per shard, that is per partition of the writing job: bounded by that number
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), path)
    return describe_token_ids(spark, path)

"""Packing tokenised documents into sequences of at most ``capacity`` tokens by exact-complement hashing.

Only lengths matter to the plan, and there are at most ``capacity`` of them, so Spark counts pieces by length and the
plan is made on those counts. An index holds the sums of one, two and three available lengths. From the longest piece
down, combinations that fill a piece's gap exactly are consumed as often as the counts allow; what is left goes by best
fit, and each gap that this opens is looked up in the index first. Every step of the plan moves a run of equal pieces at
once, so the plan's size depends on the number of different lengths and not on the number of pieces. Pieces then take
their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklot.llm.common import materialize, table, text_slices
from tracklot.llm.tokens import WORD_BPE, encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, place long"


class SumIndex:
    """Which totals one, two or three of the available lengths add up to, and the lengths that do.

    Pair and triple sums are bit sets, bit ``s`` for sum ``s``. Counts only fall, so a set may hold sums that are used up
    by now, never lack one; a search that such a sum sends off in vain builds the sets again.
    """

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
        self._build()

    def _build(self) -> None:
        self.alive = [n for n, c in self.left.items() if c]
        self.most = max(self.alive, default=0)
        ones = sum(1 << n for n in self.alive)
        self.pairs = self.triples = 0
        for n in self.alive:
            self.pairs |= ones << n
        for n in self.alive:
            self.triples |= self.pairs << n

    def allows(self, lengths: tuple[int, ...]) -> int:
        """How often the lengths can be taken together."""
        return min(self.left.get(n, 0) // lengths.count(n) for n in set(lengths))

    def _pair(self, total: int, limit: int, beside: tuple[int, ...]) -> tuple[int, ...] | None:
        for a in self.alive:
            if 2 * a < total:
                return None
            if a <= limit and a < total and self.left[a] and self.left.get(total - a) and self.allows((*beside, a, total - a)):
                return a, total - a
        return None

    def exact(self, total: int, beside: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """One, two or three lengths, longest first, that fill a gap of ``total`` and can be taken together with ``beside``."""
        if self.left.get(total) and self.allows((*beside, total)):
            return (total,)
        for _ in range(2):
            stale = False
            if self.pairs >> total & 1:
                if found := self._pair(total, total, beside):
                    return found
                stale = True
            if self.triples >> total & 1:
                for a in self.alive:
                    if 3 * a < total:
                        break
                    if a < total and self.left[a] and self.pairs >> (total - a) & 1 and (rest := self._pair(total - a, a, (*beside, a))):
                        return a, *rest
                stale = True
            if not stale or all(self.left[n] for n in self.alive):
                return None
            self._build()
        return None


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, number, first sequence, offset): piece ``first rank + i`` goes to sequence ``first sequence + i``."""
    index = SumIndex(counts)
    left, used = index.left, dict.fromkeys(index.left, 0)
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def take(n: int, k: int, sequence: int, offset: int) -> None:
        plan.append((n, used[n], k, sequence, offset))
        used[n] += k
        left[n] -= k

    def fill(lengths: tuple[int, ...], k: int, sequence: int, offset: int) -> None:
        for n in lengths:
            take(n, k, sequence, offset)
            offset += n

    if left.get(capacity):
        k = left[capacity]
        fill((capacity,), k, opened, 0)
        opened += k
    for n in list(left):  # whole sequences: a piece and what fills its gap exactly
        while left[n] and (others := index.exact(capacity - n, (n,))):
            k = index.allows((n, *others))
            fill((n, *others), k, opened, 0)
            opened += k

    gaps: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, number)
    rooms: list[int] = []

    def keep(room: int, first: int, k: int) -> None:
        """Fill the gaps of a run of sequences exactly as far as lengths allow; the rest waits for a best fit."""
        while room and k and (lengths := index.exact(room)):
            number = min(k, index.allows(lengths))
            fill(lengths, number, first, capacity - room)
            first, k = first + number, k - number
        if room and k:
            if room not in gaps:
                insort(rooms, room)
            gaps.setdefault(room, []).append((first, k))

    for n in list(left):
        while left[n]:
            i = bisect_left(rooms, n)
            if i < len(rooms):
                room = rooms[i]
                first, number = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room], rooms[i]
                k = min(number, left[n])
                take(n, k, first, capacity - room)
                if number > k:
                    gaps.setdefault(room, []).append((first + k, number - k))
                    if len(gaps[room]) == 1:
                        insort(rooms, room)
                keep(room - n, first, k)
            else:
                each = capacity // n
                k = -(-left[n] // each)
                first, opened = opened, opened + k
                waiting, layers = [], 0
                for j in range(each):
                    full = min(k, left[n])
                    if not full:
                        break
                    take(n, full, first, j * n)
                    layers = j + 1
                    if full < k:  # the last layer ends inside the run
                        waiting.append((capacity - j * n, first + full, k - full))
                        k = full
                for gap in [*waiting, (capacity - layers * n, first, k)]:
                    keep(*gap)
    return plan


def _pieces(batches: Iterator[pa.RecordBatch], file: str, folder: str | None, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    part, enc = TaskContext.get().partitionId(), encoder(file, folder)
    seen, end = np.zeros(capacity + 1, np.int64), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        for low, high, texts in text_slices(batch):
            rows: list[tuple] = []
            for d, ids in zip(doc_ids[low:high], enc.encode(texts), strict=True):
                own = ids + end
                for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                    cut = own[at : at + 4 * capacity]
                    n = len(cut) // 4
                    rows.append((d, piece, at // 4, n, zlib.crc32(cut), part, int(seen[n])))
                    seen[n] += 1
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "place")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _placed(batches: Iterator[pa.RecordBatch], plan: dict[int, tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            firsts, sequences, offsets = plan[int(n)]
            at = np.searchsorted(firsts, rank[rows], "right") - 1
            sequence[rows] = sequences[at] + rank[rows] - firsts[at]
            offset[rows] = offsets[at]
        kept = [batch.column(c) for c in ("doc_id", "piece", "start")]
        yield pa.record_batch([*kept, pa.array(length.astype(np.int64)), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, capacity: int = 4096, file: str = WORD_BPE, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Sequence and offset of every piece of every document (doc_id, text; other columns are ignored).

    A null text is empty: a piece of the end id alone. Repeated rows are packed as often as they occur; an empty table
    gives no rows. Tokens are made once and the piece table is written to the shared folder, so ranks cannot change
    when a task is run again. The driver holds one count and a few plan rows per length, at most ``capacity`` lengths.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(rows.mapInArrow(lambda b: _pieces(b, file, folder, end_id, capacity), PIECES), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table_of: dict[int, list[tuple[int, int, int]]] = {}
    for n, first, _, sequence, offset in plan_packing(counts, capacity):
        table_of.setdefault(n, []).append((first, sequence, offset))
    plan = {n: tuple(np.array(c, np.int64) for c in zip(*sorted(v), strict=True)) for n, v in table_of.items()}
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    order = Window.partitionBy("length").orderBy("part")
    before = by_part.select("length", "part", (F.sum("n").over(order) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    return ranked.mapInArrow(lambda b: _placed(b, shared.value), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

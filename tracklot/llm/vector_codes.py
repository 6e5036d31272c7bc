"""Vector codes by four codebooks of integer parts, nearest entries found with fixed pivots (LAESA).

A vector's parts are measured once against a few fixed pivots, and these distances are kept beside it. In each round only
the codebooks' entries are measured against the pivots: the difference of two distances to one pivot is a lower bound of
the distance between part and entry. Entries are tried in the order of their bounds, and those whose bound is beyond the
best squared distance so far are never evaluated. Bounds are floating with slack; every evaluation is exact in integers,
so codes and errors do not depend on pivots.

Spark holds the vectors; the driver holds the codebooks (256 entries of a vector's length) and gets one summed row per
part and entry each round, which partitions have added up before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklot.llm.common import discard, join_hot, list_array, materialize, table

PARTS, ENTRIES, ROUNDS, PIVOTS = 4, 256, 4, 8
#: Rows at a time, and ends of the groups of entries tried together, in the order of their bounds.
SLICE, STEPS = 500, (1, 4, 16, 64, ENTRIES)
#: Relative slack of a bound: distances to pivots are kept as 32-bit floats.
SLACK = 1e-6


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows: 64-bit where that holds them, with room for an entry's number, else Python integers."""
    top = max(abs(int(x)) for x in (a.min(), a.max(), b.min(), b.max())) if a.size and b.size else 0
    if a.shape[-1] * (2 * top) ** 2 * ENTRIES >= 2**63:
        a, b = a.astype(object), b.astype(object)
    return ((a - b) ** 2).sum(-1)


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row the nearest entry (ties to the lower one), its squared distance, and how many evaluations it took."""
    n, k = len(x), len(entries)
    low = np.zeros((n, k))
    for p in range(to_pivots.shape[1]):
        np.maximum(low, np.abs(to_pivots[:, p, None] - entry_pivots[None, :, p]), out=low)
    low -= SLACK * (1 + to_pivots.max(initial=0) + entry_pivots.max(initial=0))
    low = np.maximum(low, 0) ** 2
    order = np.argsort(low, axis=1, kind="stable")
    low = np.take_along_axis(low, order, 1)
    best, done, a = None, 0, 0  # best: squared distance * k + entry, so the lower entry wins a tie
    for b in STEPS:
        part = low[:, a:b]
        rows, cols = np.nonzero(np.ones(part.shape, bool) if best is None else part <= (best // k)[:, None])
        if len(rows):
            at = order[rows, a + cols]
            keys = squared(x[rows], entries[at]) * k + at
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            found = np.minimum.reduceat(keys, starts)
            if best is None:
                best = found
            else:
                best = best.astype(object) if found.dtype == object else best
                best[rows[starts]] = np.minimum(best[rows[starts]], found)
            done += len(rows)
        a = b
    return (best % k).astype(np.int64), best // k, done


class PartCodes:
    """Codebooks with their pivots: ``entries`` and ``pivots`` hold an array per part."""

    def __init__(self, first: np.ndarray):
        self.width = first.shape[1] // PARTS
        self.entries = [first[:, p * self.width : (p + 1) * self.width].copy() for p in range(PARTS)]
        self.pivots = [self._far_apart(e) for e in self.entries]
        self.measure()

    @staticmethod
    def _far_apart(e: np.ndarray) -> np.ndarray:
        """Entries with the largest sums of distances to those chosen before."""
        chosen, total = [0], np.zeros(len(e))
        while len(chosen) < min(PIVOTS, len(e)):
            total += np.sqrt(squared(e, e[chosen[-1]][None]).astype(float))
            total[chosen] = -1
            chosen.append(int(total.argmax()))
        return e[chosen]

    @staticmethod
    def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(squared(x, q[None]).astype(float)) for q in pivots], 1)

    def measure(self) -> None:
        self.to_pivots = [self.distances(e, q) for e, q in zip(self.entries, self.pivots, strict=True)]

    def part(self, x: np.ndarray, p: int) -> np.ndarray:
        return x[:, p * self.width : (p + 1) * self.width]

    def codes(self, x: np.ndarray, kept: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Part, code and error of every vector, from its kept distances to the pivots."""
        n = len(self.pivots[0])
        for p in range(PARTS):
            code, error, _ = nearest(self.part(x, p), kept[:, p * n : (p + 1) * n], self.entries[p], self.to_pivots[p])
            yield p, code, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()


def integer_vectors(df: DataFrame, vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """Rows whose vector is all finite numbers, with ``ints``: floor(scale * x) of each component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(F.col(vector).isNotNull() & good).withColumn("ints", F.transform(vector, lambda x: F.floor(x.cast("double") * scale))).drop(vector)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, vectors, distances to pivots), some rows at a time."""
    for low in range(0, batch.num_rows, SLICE):
        part = batch.slice(low, SLICE)
        shaped = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)  # noqa: B023, E731
        yield low, low + part.num_rows, shaped("ints"), shaped("to_pivots").astype(float) if "to_pivots" in batch.schema.names else None


def _with_pivots(vectors: DataFrame, books: PartCodes) -> DataFrame:
    names = [c for c in vectors.columns if c not in ("ints", "to_pivots")]

    def run(batches):
        for batch in batches:
            for low, high, x, _ in _slices(batch):
                far = np.concatenate([books.distances(books.part(x, p), books.pivots[p]) for p in range(PARTS)], 1)
                columns = [batch.column(i).slice(low, high - low) for i in range(len(names) + 1)]
                yield pa.RecordBatch.from_arrays([*columns, list_array(far.astype(np.float32), pa.float32())], names=[*names, "ints", "to_pivots"])

    out = vectors.select(*names, "ints")
    return out.mapInArrow(run, out.withColumn("to_pivots", F.array().cast("array<float>")).schema)


def _sums(measured: DataFrame, books: PartCodes) -> DataFrame:
    """Per part and entry: its parts' number ``n`` and their component sums ``s0``, ``s1``, ...; a row per partition before the shuffle."""
    def run(batches):
        n, s = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, books.width), object)
        for batch in batches:
            for _, _, x, kept in _slices(batch):
                for p, code, _ in books.codes(x, kept):
                    order = np.argsort(code, kind="stable")
                    found, starts, count = np.unique(code[order], return_index=True, return_counts=True)
                    n[p, found] += count
                    s[p, found] += np.add.reduceat(books.part(x, p)[order].astype(np.int64), starts, axis=0)
        p, e = np.nonzero(n)
        if len(p):
            yield pa.record_batch({"part": pa.array(p.astype(np.int32)), "entry": pa.array(e.astype(np.int32)), "n": pa.array(n[p, e]), "s": pa.array(s[p, e].tolist(), pa.list_(pa.int64()))})

    part = measured.select("ints", "to_pivots").mapInArrow(run, "part int, entry int, n long, s array<bigint>")
    return part.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(books.width)])


def fit_part_codes(vectors: DataFrame, order: str = "vec_id", rounds: int = ROUNDS) -> tuple[DataFrame, PartCodes | None]:
    """Vectors with their distances to the pivots (a table in the shared folder), and codebooks after ``rounds`` rounds.

    ``vectors`` has ``ints``. The codebooks start as the parts of the 256 rows smallest by ``order`` (null last, ties by
    vector) whose length is that of the first one that is not empty; only vectors of that length are in the table. An
    entry that nothing is nearest to stays as it was. No vector: no codebooks.
    """
    filled = vectors.where(F.size("ints") > 0)
    first = lambda df: [r.ints for r in df.orderBy(F.asc_nulls_last(order), "ints").limit(ENTRIES).select("ints").collect()]
    head = first(filled)
    if not head:
        return filled, None
    width = len(head[0])
    if width % PARTS:
        raise ValueError(f"vectors of {width} components cannot be cut into {PARTS} equal parts")
    even = filled.where(F.size("ints") == width)
    if any(len(v) != width for v in head):
        head = first(even)
    books = PartCodes(np.array(head, np.int64))
    measured = materialize(_with_pivots(even, books), "measured")
    for _ in range(rounds):
        for r in _sums(measured, books).collect():  # a row per part and entry at most
            books.entries[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(books.width)]
        books.measure()
    return measured, books


def encode_parts(measured: DataFrame, books: PartCodes) -> DataFrame:
    """Replace ``ints`` and ``to_pivots`` by ``code`` (two hex digits a part) and ``error`` (squared distances of all parts)."""
    names = [c for c in measured.columns if c not in ("ints", "to_pivots", "code", "error")]

    def run(batches):
        for batch in batches:
            for low, high, x, kept in _slices(batch):
                text, total = np.full(len(x), "", object), np.zeros(len(x), object)
                for _, code, error in books.codes(x, kept):
                    text, total = text + np.array([f"{c:02x}" for c in range(ENTRIES)], object)[code], total + error
                columns = [batch.column(i).slice(low, high - low) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(text, pa.string()), pa.array(total.tolist(), pa.int64())], names=[*names, "code", "error"])

    out = measured.select(*names)
    return measured.select(*names, "ints", "to_pivots").mapInArrow(run, out.withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every kept vector, the errors summed by label, and a digest of the codebooks.

    Vectors that are empty or of another length than the first get a null code and error and take no part; repeated rows
    and ids stay, null ids come last in the order. An empty table gives no rows.
    """
    vectors = integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    measured, books = fit_part_codes(vectors)
    odd = vectors.where(F.size("ints") != (len(books.entries[0][0]) * PARTS if books else 0)) if books else vectors
    coded = odd.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if books:
        coded = encode_parts(measured, books).select("vec_id", "label", "code", "error").unionByName(coded)
    coded = materialize(coded, "codes")
    if books:
        discard(measured)
    labels = materialize(coded.groupBy("label").agg(F.coalesce(F.sum("error"), F.lit(0)).alias("label_error"), F.count("*").alias("rows")), "labels")
    both = join_hot(coded, labels, "label", "rows")
    return both.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))

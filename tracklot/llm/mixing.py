"""Mixing sources to target weights.

Every source's words, documents in doc_id order, form one stream that is cut into blocks of ``block`` words. A source
gets as many block slots as its target asks for. Every output shard of ``SHARD_SLOTS`` slots draws its source counts: they
are multinomial given what the sources have in all, so targets are met whatever is drawn. A shard finds its draw, and how
much of each source the shards before it took, by halving the run of shards with a keyed draw until it is alone; no shard
waits for another. A source's j-th slot takes the block at place ``j mod blocks`` of a keyed permutation (one key per pass
over the source), so no block is taken again before every other one of its source. Slots meet documents by (source, block
index), a key as even as the blocks themselves, whatever the sources' sizes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklot.llm.common import discard, materialize, order_bounds, shuffle_width, table, text_slices, with_order_bucket

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
SEED = 20_240_601
#: Documents of a source whose sizes one task sums up.
BUCKET_ROWS = 2_000
#: Slots from which counts are drawn one for one; from more, each source's count is drawn by its mean and variance.
DRAWN_SLOTS = 100_000_000
#: More sources than this are joined by a shuffle, not broadcast. The driver holds a few numbers per source.
BROADCAST_SOURCES = 50_000
WORDS = "[^\\x20\\x09-\\x0D]+"
_WORD = re.compile("[^\x20\x09-\x0d]+")


def targets(sizes: list[int], weights: list[float], most: int = MAX_PASSES) -> list[float]:
    """Shares of the total by weight; a source stops at ``most`` times its size and the excess is shared again."""
    out, total = [0.0] * len(sizes), float(sum(sizes))
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        share = (total - sum(out)) / sum(weights[i] for i in open_)
        over = [i for i in open_ if share * weights[i] >= most * sizes[i]]
        for i in over or open_:
            out[i] = float(most * sizes[i]) if over else share * weights[i]
        open_ = [i for i in open_ if i not in set(over)] if over else []
    return out


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """splitmix64 of each value under a key."""
    z = x.astype(np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def permuted(places: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of places 0..n-1 under a keyed permutation of them: a four-round Feistel network, walked until it lands inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = places.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            left, right = right, left ^ (_mixed(right, key * 4 + r) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _halved(slots: np.ndarray, take: int, key: tuple[int, ...]) -> np.ndarray:
    """How many of ``take`` slots are of each source, drawn without replacement from ``slots`` of them.

    Source by source, given the draws before: from more than ``DRAWN_SLOTS`` slots by a normal step of the hypergeometric
    mean and variance, which at that size is the same to a ten-thousandth of its spread, and exactly from there on.
    """
    rng, out = np.random.default_rng(key), np.zeros(len(slots), np.int64)
    total = int(slots.sum())
    for i, n in enumerate(map(int, slots)):
        if total <= DRAWN_SLOTS:
            out[i:] = rng.multivariate_hypergeometric(slots[i:], take, method="marginals")
            break
        share = n / total
        spread = max(0.0, take * share * (1 - share) * ((total - take) / (total - 1))) ** 0.5
        mean, odd = divmod(take * n, total)  # in integers: a product may pass 53 bits
        drawn = mean + round(odd / total + spread * float(rng.standard_normal()))
        out[i] = min(max(drawn, 0, take - (total - n)), n, take)
        total, take = total - n, take - int(out[i])
    return out


def shard_counts(slots: np.ndarray, shard: int, size: int = SHARD_SLOTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(first, counts): a shard's slots of each source, and those of all shards before it."""
    left, first = np.array(slots, np.int64), np.zeros(len(slots), np.int64)
    low, high = 0, -(-int(left.sum()) // size)
    while high - low > 1:
        middle = (low + high) // 2
        own = _halved(left, (middle - low) * size, (seed, low, high))
        if shard < middle:
            left, high = own, middle
        else:
            first, left, low = first + own, left - own, middle
    return first, left


def _taken_blocks(batches: Iterator[pa.RecordBatch], slots: np.ndarray, blocks: np.ndarray, size: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The slots of each shard in the order in which they stand there."""
    for batch in batches:
        for shard in batch.column("id").to_pylist():
            first, counts = shard_counts(slots, shard, size, seed)
            source, block, turns = [], [], []
            for s in np.flatnonzero(counts).tolist():
                turn, place = np.divmod(first[s] + np.arange(counts[s]), blocks[s])
                own = np.empty(len(place), np.int64)
                for p in np.unique(turn):
                    own[turn == p] = permuted(place[turn == p], int(blocks[s]), seed * 1_000_003 + s * 64 + int(p))
                source.append(np.full(len(place), s, np.int32))
                block.append(own)
                turns.append(turn.astype(np.int32))
            order = np.argsort(permuted(np.arange(counts.sum()), int(counts.sum()), seed + shard))
            yield pa.record_batch({"shard": np.full(len(order), shard, np.int64), "slot": np.arange(len(order)), "source_id": np.concatenate(source)[order], "block": np.concatenate(block)[order], "turn": np.concatenate(turns)[order]})


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


class Mixture:
    """The parts of a mix: ``docs`` (key columns, size, source_id, start in the source's stream) and ``slots``."""

    def __init__(self, docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS):
        spark, self.block = docs.sparkSession, block
        sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), n_words(F.col("text")).alias("size"))
        sized = materialize(sized, "mix-sizes")
        found = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()  # one row per source
        found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
        sizes = [r["n"] for r in found]
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
        blocks = [-(-n // block) for n in sizes]
        slots = [int(g // n) * b + min(b, round(g % n / block)) if n else 0 for g, b, n in zip(goal, blocks, sizes, strict=True)]
        schema = T.StructType.fromDDL("source string, source_id int, source_size long, target double, blocks long, slots long")
        sources = spark.createDataFrame([(r["source"], i, sizes[i], goal[i], blocks[i], slots[i]) for i, r in enumerate(found)], schema)
        self.sources = sources = F.broadcast(sources) if len(found) <= BROADCAST_SOURCES else sources
        bounds = order_bounds(sized, ["doc_id", "text_hash"], BUCKET_ROWS)
        placed = with_order_bucket(sized, ["doc_id", "text_hash"], bounds).drop("opens").join(sources.select(F.col("source").alias("its"), "source_id", "source_size", "target"), F.col("source").eqNullSafe(F.col("its"))).drop("its")
        sums = placed.groupBy("source_id", "bucket").agg(F.sum("size").alias("n"))
        before = sums.select("source_id", "bucket", (F.sum("n").over(Window.partitionBy("source_id").orderBy("bucket")) - F.col("n")).alias("before"))
        here = Window.partitionBy("source_id", "bucket").orderBy("doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, 0)
        within = placed.withColumn("within", F.sum("size").over(here) - F.col("size"))
        started = within.hint("merge").join(before.hint("merge"), ["source_id", "bucket"]).select("doc_id", "text_hash", "source_id", "size", "source_size", "target", (F.col("before") + F.col("within")).alias("start"))
        self.docs = materialize(started.withColumn("row", F.monotonically_increasing_id()), "mix-docs")
        discard(sized)
        shards = -(-sum(slots) // SHARD_SLOTS)
        shared = spark.sparkContext.broadcast((np.array(slots, np.int64), np.array(blocks, np.int64)))
        #: One row per place of the output: shard, place in it, source, block and pass.
        self.slots = spark.range(0, shards, 1, max(1, min(shards, shuffle_width(docs)))).mapInArrow(lambda b: _taken_blocks(b, *shared.value, SHARD_SLOTS, seed), "shard long, slot long, source_id int, block long, turn int")

    def overlaps(self) -> DataFrame:
        """Document rows by block: ``low`` and ``words`` of the document that the block holds, ``times`` it is taken."""
        b = self.block
        taken = self.slots.groupBy("source_id", "block").agg(F.count("*").alias("times"))
        full = self.docs.where("size > 0")
        each = full.select("*", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("block"))
        low = F.greatest(F.col("start"), F.col("block") * b)
        high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        each = each.select("row", "doc_id", "text_hash", "source_id", "block", (low - F.col("start")).alias("low"), (high - low).alias("words"))
        return each.hint("merge").join(taken.hint("merge"), ["source_id", "block"])  # both grow with the documents

    def taken(self) -> DataFrame:
        """Per document row: doc_id, size, source_size, target, taken (its words in the mix, repeats counted)."""
        sums = self.overlaps().groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        return self.docs.hint("merge").join(sums.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _passes(words: int, spans: list[dict]) -> Iterator[list[list[int]]]:
    """The runs of words that each pass over a document's rows takes, in order."""
    by_row: dict[int, list[dict]] = {}
    for s in spans:
        by_row.setdefault(s["row"], []).append(s)
    for own in by_row.values():
        own.sort(key=lambda s: s["low"])
        for turn in range(1, max(s["times"] for s in own) + 1):
            runs: list[list[int]] = []
            for s in own:
                if s["times"] >= turn:
                    if runs and runs[-1][1] == s["low"]:
                        runs[-1][1] = s["low"] + s["words"]
                    else:
                        runs.append([s["low"], s["low"] + s["words"]])
            yield runs


def _cut(batches: Iterator[pa.RecordBatch], schema: list[str]) -> Iterator[pa.RecordBatch]:
    """Each copy of a document as the words that its pass over the source takes, in order."""
    at_text, at_size = schema.index("text"), schema.index("n_chars") if "n_chars" in schema else None
    for batch in batches:
        given = batch.select(range(len(schema)))
        batch = pa.RecordBatch.from_arrays([*given.columns, batch.column(len(schema))], names=[*(f"c{i}" for i in range(len(schema))), "mix_ranges"])
        for low, high, texts in text_slices(batch, f"c{at_text}"):
            ranges = batch.column("mix_ranges").slice(low, high - low).to_pylist()
            take: list[int] = []
            cut: list[str] = []
            for k, (text, spans) in enumerate(zip(texts, ranges, strict=True)):
                words = [m.span() for m in _WORD.finditer(text)]
                for runs in _passes(len(words), spans):
                    take.append(k)
                    cut.append(text if runs == [[0, len(words)]] else "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs))
            rows = given.slice(low, high - low).take(pa.array(take, pa.int64()))
            columns = rows.columns
            columns[at_text] = pa.array(cut, rows.schema.field(at_text).type)
            if at_size is not None:
                columns[at_size] = pa.array([len(c) for c in cut]).cast(rows.schema.field(at_size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)


def mix_documents(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row per document and pass, its text the words taken in that pass.

    A document that is taken whole keeps its text as it is; ``n_chars``, where present, follows the text. Null and empty
    texts, of which nothing can be taken, are not in the mix. Of rows equal in id and text, each is taken for itself, with
    the other columns of one of them. A null source is one like any other, weighed last; an empty table gives no rows.
    """
    mix = Mixture(docs, block, seed, weights)
    key = ["doc_id", "text_hash"]
    spans = mix.overlaps().groupBy(*key).agg(F.collect_list(F.struct("row", "low", "words", "times")).alias("mix_ranges")).toDF("mix_doc", "mix_hash", "mix_ranges")
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("its_doc"), F.xxhash64("text").alias("its_hash"))
    joined = whole.join(spans, F.col("its_doc").eqNullSafe(F.col("mix_doc")) & (F.col("its_hash") == F.col("mix_hash")))
    # rows that are equal in id and text come back from the ranges of all of them, so one of them is kept
    if not docs.groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.count("*").alias("n")).where("n > 1 OR k IS NULL").isEmpty():
        joined = joined.dropDuplicates(["its_doc", "its_hash"])
    names = docs.columns
    return joined.select("row.*", "mix_ranges").mapInArrow(lambda b: _cut(b, names), docs.schema)


def mix_taken(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of every document row (doc_id, source, text; other columns are ignored).

    Null or empty texts have size 0 and nothing taken; null is a source of its own, weighed last; equal rows are
    separate documents; an empty table gives no rows.
    """
    return Mixture(docs, **options).taken()


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_taken(table(spark, sf_dir, "documents"))

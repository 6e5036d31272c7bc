"""Near duplicates by a multi-index Hamming join over b-bit minwise signatures.

A document is the set of its 5-word shingles. Its signature has ``SLOTS`` slots of 16 bits, each from the minimum of
one hash function over the set (Li and Koenig 2010); two documents' signature distance is the number of slots that
differ. ``CHUNKS`` chunks of ``CHUNK`` slots hold at most one differing slot in at least one chunk whenever the distance
is under ``2 * CHUNKS`` (pigeonhole), so a key for every chunk and every slot left out of it finds **all** pairs within
distance ``MAX_DISTANCE``. At a similarity of 0.75 a quarter of the slots differ on average; more than the threshold do
with a chance of about 1e-5, at 0.8 of 1e-6.

Buckets are not expanded into pairs. Documents with equal sets are one class. Every class is first held against the
smallest class of the bucket it shares most keys with, on full sets; components of these links settle nearly all
buckets. Where a bucket still holds several components, small buckets give the pairs between them, and in a large one
the classes outside its largest component are a query set that is held against that component (and each other) in
blocks, on full sets again. Both ways are exact for what the index finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklot.llm.common import discard, materialize, table, text_slices
from tracklot.llm.components import connected_components

SHINGLE, PERCENT = 5, 75
SLOTS, CHUNK = 64, 4
CHUNKS = SLOTS // CHUNK
MAX_DISTANCE = 2 * CHUNKS - 1
#: Buckets up to this size give pairs; larger ones are searched in blocks.
SMALL_BUCKET = 24
BLOCK, QUERIES = 256, 2048

_rng = np.random.default_rng(20_220_319)
_WORD_KEYS = _rng.integers(1, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_SLOT_MUL = _rng.integers(1, 2**63, SLOTS, np.uint64) * np.uint64(2) + np.uint64(1)
_SLOT_ADD = _rng.integers(1, 2**63, SLOTS, np.uint64)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; A-Z count as a-z, words are separated by ASCII white space."""
    words = text.encode().lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * _WORD_KEYS[i]
    return np.unique(_mix(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each slot's hash function."""
    least = np.full(SLOTS, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[None, i : i + 2048] * _SLOT_MUL[:, None] + _SLOT_ADD[:, None]).min(axis=1), out=least)
    return (_mix(least) >> np.uint64(48)).astype(np.uint16)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys (rows, chunks * slots of a chunk): a chunk's number, the slot left out, and the others' 48 bits."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), CHUNKS, CHUNK)
    keys = np.empty((len(signatures), CHUNKS, CHUNK), np.uint64)
    for out in range(CHUNK):
        kept = [i for i in range(CHUNK) if i != out]
        value = np.zeros(parts.shape[:2], np.uint64)
        for i in kept:
            value = (value << np.uint64(16)) | parts[:, :, i]
        keys[:, :, out] = value | (np.arange(CHUNKS, dtype=np.uint64) << np.uint64(50))[None, :] | np.uint64(out << 48)
    return keys.reshape(len(signatures), -1)


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    return tuple(int(_mix(x).sum(dtype=np.uint64).astype(np.int64)) for x in (s ^ np.uint64(0x5851F42D4C957F2D), s + np.uint64(0x14057B7EF767814F)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, texts in text_slices(batch):
            n, keys, sigs = [], [], []
            for t in texts:
                s = shingle_set(t)
                n.append(len(s))
                keys.append(_set_key(s))
                sigs.append(signature(s).tobytes() if len(s) else None)
            own = [batch.column(c).slice(low, high - low) for c in ("doc_id", "text_hash")]
            yield pa.record_batch([*own, pa.array(n, pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array(sigs, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "lo", "hi", "sig"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            part = batch.slice(low, 4096)
            sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
            keys = index_keys(sigs)
            yield pa.record_batch({"key": keys.reshape(-1).view(np.int64), "rep": np.repeat(part.column("rep").to_numpy(), keys.shape[1])})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, texts in text_slices(batch):
            rep, lo, hi = (batch.column(c).slice(low, high - low).to_pylist() for c in ("rep", "lo", "hi"))
            sets = [shingle_set(t) for t in texts]
            own = [i for i, s in enumerate(sets) if _set_key(s) == (lo[i], hi[i])]
            yield pa.record_batch([pa.array([rep[i] for i in own], pa.int64()), pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["rep", "shingles"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            a, b, one, two = (batch.column(c).slice(low, 256).to_pylist() for c in ("a", "b", "set_a", "set_b"))
            hit = [i for i in range(len(a)) if linked(np.frombuffer(one[i], np.uint64), np.frombuffer(two[i], np.uint64))]
            yield pa.record_batch([pa.array([x[i] for i in hit], pa.int64()) for x in (a, b)], names=["a", "b"])


def _search_block(group: pd.DataFrame) -> pd.DataFrame:
    """Links between a block's queries and its members of other components, one per query and component."""
    base, queries = group[~group["asks"]], group[group["asks"]]
    sets = [np.frombuffer(s, np.uint64) for s in base["shingles"]]
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(sets)), sizes)[order]
    reps, comps = base["rep"].to_numpy(), base["comp"].to_numpy()
    out: list[tuple[int, int]] = []
    for rep, comp, shingles in zip(queries["rep"], queries["comp"], queries["shingles"], strict=True):
        q = np.frombuffer(shingles, np.uint64)
        low, high = np.searchsorted(values, q, "left"), np.searchsorted(values, q, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        hit = np.flatnonzero((100 * both >= PERCENT * (len(q) + sizes - both)) & (comps != comp))
        _, first = np.unique(comps[hit], return_index=True)
        out += [(int(rep), int(r)) for r in reps[hit[first]]]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, confirmed on full sets."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(_verify, "a long, b long")


def _groups(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with each row's ``text_hash``, and whether its id and text are the least of its component (``chosen``)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", F.xxhash64("text"))
    signed = materialize(rows.mapInArrow(_sign, "doc_id long, text_hash long, n_shingles long, lo long, hi long, sig binary"), "signed")
    key = ["lo", "hi", "n_shingles"]
    # a class is one set; its number means nothing but stays as it is, being written
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = signed.where("n_shingles > 0").groupBy(*key).agg(head.alias("head"), F.first("sig").alias("sig"))
    classes = materialize(classes.select(*key, F.col("head.doc_id").alias("head_id"), F.col("head.text_hash").alias("head_hash"), "sig", F.monotonically_increasing_id().alias("rep")), "classes")
    keys = classes.select("rep", "sig").mapInArrow(_keys, "key long, rep long")
    heads = keys.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1")
    buckets = materialize(keys.join(heads, "key"), "buckets")

    nearest = buckets.where("rep <> head").groupBy("rep", "head").agg(F.count("*").alias("shared")).groupBy("rep").agg(F.max(F.struct("shared", (-F.col("head")).alias("head"))).alias("best"))
    tried = materialize(nearest.select(F.col("rep").alias("a"), (-F.col("best.head")).alias("b")), "tried")
    found = classes.join(buckets.select("rep").distinct(), "rep").select("rep", "lo", "hi", "head_id", "head_hash")
    texts = rows.join(found, F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("text_hash") == F.col("head_hash"))).select("rep", "lo", "hi", "text").mapInArrow(_sets, "rep long, shingles binary")
    sets = materialize(texts.dropDuplicates(["rep"]), "sets")  # equal rows give their set more than once
    links = materialize(_links(tried, sets), "links")
    labels = connected_components(links)

    # buckets that hold more than one component so far
    sizes = classes.select("rep", F.col("n_shingles").alias("size"))
    placed = buckets.join(labels.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    per = placed.groupBy("key", "comp").agg(F.count("*").alias("members"))
    largest = per.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("members", (-F.col("comp")).alias("comp"))).alias("most"))
    open_ = largest.where("comps > 1").select("key", (-F.col("most.comp")).alias("base"))
    mixed = materialize(placed.join(open_, "key"), "mixed")
    small = mixed.where(F.col("n") <= SMALL_BUCKET).join(sizes, "rep").select("key", "rep", "comp", "size")
    other = small.select("key", *[F.col(c).alias(f"{c}_b") for c in ("rep", "comp", "size")])
    fits = (F.col("size") * 100 >= F.col("size_b") * PERCENT) & (F.col("size_b") * 100 >= F.col("size") * PERCENT)
    pairs = small.join(other, "key").where((F.col("rep") > F.col("rep_b")) & (F.col("comp") != F.col("comp_b")) & fits)
    pairs = pairs.select(F.col("rep").alias("a"), F.col("rep_b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    late = materialize(_links(pairs, sets), "late")

    queries = mixed.where((F.col("n") > SMALL_BUCKET) & (F.col("comp") != F.col("base"))).select("base", "rep", "comp").distinct()
    queries = materialize(queries, "queries")
    members = placed.select("rep", "comp").distinct().join(queries.select(F.col("base").alias("comp")).distinct(), "comp").select(F.col("comp").alias("base"), "rep", "comp")
    stock = materialize(members.union(queries), "stock")
    counts = stock.groupBy("base").agg(F.count("*").alias("stock")).join(queries.groupBy("base").agg(F.count("*").alias("asking")), "base")
    counts = counts.select("base", F.ceil(F.col("stock") / BLOCK).alias("blocks"), F.ceil(F.col("asking") / QUERIES).alias("turns"))
    spot = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n))
    ask = queries.join(counts, "base").select("base", "rep", "comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), spot("turns", 1).alias("turn"), F.lit(True).alias("asks"))
    give = stock.join(counts, "base").select("base", "rep", "comp", spot("blocks", 2).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("asks"))
    searched = ask.union(give).join(sets, "rep").groupBy("base", "block", "turn").applyInPandas(_search_block, "a long, b long")

    final = connected_components(links.union(late).union(searched)).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    discard(buckets, tried, sets, links, labels, mixed, late, queries, stock)
    named = classes.join(final, "rep", "left").select(*key, "head_id", "head_hash", F.coalesce("comp", "rep").alias("comp"))
    firsts = named.groupBy("comp").agg(F.min(F.struct(F.col("head_id").isNull().alias("none"), "head_id", "head_hash")).alias("first"))
    named = named.join(firsts, "comp").select(*key, "first")
    out = signed.drop("sig").join(named, key, "left")
    chosen = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.head_id")) & (F.col("text_hash") == F.col("first.head_hash")))
    component = F.coalesce("first.head_id", "doc_id")
    kept = F.when(F.col("first.head_id").isNotNull(), F.col("doc_id").eqNullSafe(F.col("first.head_id"))).otherwise(chosen)
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), kept.alias("kept"), chosen.alias("chosen"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text, or one without words, has no shingles, is linked with nothing and kept. Texts of equal sets are
    one class; a doc_id that repeats with two texts stands in two classes, which are linked only if their texts are. A null
    doc_id is linked like any other but is never a component's id; in a component without any other, the id is null and
    the rows of one text are kept. An empty table gives no rows.
    """
    return _groups(docs).drop("text_hash", "chosen")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, with its columns as they were: that of the smallest doc_id, with every row equal to it in id and text.

    Of two linked texts under that id, the one of the lesser hash stays. What ``near_duplicates`` says of odd rows holds here.
    """
    gone = _groups(docs).where("NOT chosen").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    left = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("its_id"), F.xxhash64("text").alias("its_hash"))
    return left.join(gone, F.col("its_id").eqNullSafe(F.col("gone_id")) & (F.col("its_hash") == F.col("gone_hash")), "left_anti").select("row.*")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

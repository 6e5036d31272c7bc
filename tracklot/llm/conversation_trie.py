"""The prefix trie of conversations, with subtree totals by parallel tree contraction.

A turn is a digest of its role and text, made where it is read once its place is known; a prefix's key is the exclusive-or of two
64-bit hashes of (place, digest) over its turns, so prefixes of conversations of any length come from running aggregates
and need no list of turns. Two different prefixes share a key with a chance of 2**-128.

Subtree totals (Miller and Reif 1985): rounds take off all leaves and add them to their parents (rake), then take nodes
with one child out of chains where a coin says so (compress), so chains of any length shrink by a quarter of their nodes a
round. The nodes taken out of chains are put back in the opposite order: each one's total is its own, its
child's and what the edge between them carries.
Every step groups or joins by node, where a hub's many children have been counted before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklot.llm.common import discard, join_hot, materialize, order_bounds, table, with_order_bucket

#: Rows of a bucket in which turns are numbered; a longer conversation is numbered in several.
BUCKET_ROWS = 100_000
#: Conversations whose ids are joined to one text before they meet at the node where they end.
BLOCK = 8192
#: The first turns that a rebuilt conversation may take from another.
SHARED_TURNS = 8
NODE, UP = ("a", "b"), ("pa", "pb")


def numbered(rows: DataFrame, seq: str, ties: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Add ``bucket`` and ``place``, the row's number (from 1) in its conv_id by ``seq`` (null first) and ``ties``.

    Buckets are consecutive ranges of (conv_id, seq); what a conversation has in earlier buckets is added from a table of
    those that lie in several, which has two rows a bucket at most. Also returns that table (conv_id, bucket, before).
    """
    held = with_order_bucket(rows, ["conv_id", seq], order_bounds(rows, ["conv_id", seq], BUCKET_ROWS)).drop("opens")
    parts = held.groupBy("conv_id", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = parts.withColumn("buckets", F.count("*").over(Window.partitionBy("conv_id"))).where("buckets > 1")
    spans = materialize(spans.select("conv_id", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "spans")
    inside = Window.partitionBy("bucket", "conv_id").orderBy(F.asc_nulls_first(seq), *ties)
    out = held.withColumn("place", F.row_number().over(inside)).join(F.broadcast(spans), ["conv_id", "bucket"], "left")
    return out.withColumn("place", F.col("place") + F.coalesce("before", F.lit(0))).drop("before"), spans


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place, the turn's digest (da, db) and the text's UTF-8 bytes; rows without conv_id belong to no conversation.

    Rows are ordered by turn (null first), role and text (null is empty); repeated rows are turns of their own.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    placed, spans = numbered(rows, "turn", ("role", "text"))
    digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), F.concat("role", "text")).cast("binary"), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    out = materialize(placed.select("conv_id", "place", part(1).alias("da"), part(16).alias("db"), F.octet_length("text").cast("long").alias("bytes")), "turns")
    discard(spans)
    return out


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % 5, h = crc32(c) % 9; ``seq`` orders the turns."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED_TURNS + 1)
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(5))
    taken = turns.groupBy("conv_id").agg(F.lit(1)).select(F.col("conv_id").alias("taker"), base.alias("conv_id"), h.alias("h"))
    shared = turns.where((F.col("place") <= SHARED_TURNS) & (F.col("conv_id") == base)).join(taken, "conv_id").where("place <= h")
    own = turns.where(F.col("place") > h).withColumn("place", F.col("place") + SHARED_TURNS)
    return shared.drop("conv_id", "h").withColumnRenamed("taker", "conv_id").unionByName(own).withColumnRenamed("place", "seq")


def prefixes(turns: DataFrame, seq: str = "place") -> DataFrame:
    """A row per conversation and prefix of one turn or more: depth, the prefix's key (a, b), its parent's (pa, pb), the last text's bytes."""
    placed, spans = numbered(turns, seq)
    own = lambda k: F.xxhash64(F.lit(k), "place", "da", "db")
    marked = placed.select("conv_id", "bucket", F.col("place").alias("depth"), own(1).alias("ha"), own(2).alias("hb"), "bytes")
    # what the earlier buckets of a conversation come to, for the few that lie in several
    few = placed.join(F.broadcast(spans.select("conv_id", "bucket")), ["conv_id", "bucket"], "left_semi")
    sums = few.select("conv_id", "bucket", own(1).alias("ha"), own(2).alias("hb")).groupBy("conv_id", "bucket").agg(F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"))
    earlier = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("conv_id", "bucket", F.bit_xor("xa").over(earlier).alias("xa"), F.bit_xor("xb").over(earlier).alias("xb"))
    inside = Window.partitionBy("bucket", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = marked.withColumns({"a": F.bit_xor("ha").over(inside), "b": F.bit_xor("hb").over(inside)}).join(F.broadcast(carry), ["conv_id", "bucket"], "left")
    whole = lambda c, x: F.col(c).bitwiseXOR(F.coalesce(x, F.lit(0)))
    run = run.withColumns({"a": whole("a", "xa"), "b": whole("b", "xb")})
    return run.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("ha")).alias("pa"), F.col("b").bitwiseXOR(F.col("hb")).alias("pb"), "bytes")


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's blocks of ids, which come in order; the digest, not the ids, is held."""
    key, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.record_batch({"a": pa.array([key[0]], pa.int64()), "b": pa.array([key[1]], pa.int64()), "ends_sha256": pa.array([digest.hexdigest()])})

    for batch in batches:
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
            if key == (a, b):
                digest.update(b",")
            else:
                if key:
                    yield row()
                key, digest = (a, b), hashlib.sha256()
            digest.update(ids.encode())
    if key:
        yield row()


def ends_of(rows: DataFrame) -> DataFrame:
    """Per node (a, b): the digest of the ids of the conversations that end there, ascending, comma-joined.

    Ids are joined to texts in blocks of consecutive ids first. A node's blocks go through one digest, as SHA-256 reads its
    input in order; a task holds one block of them at a time.
    """
    last = rows.groupBy("conv_id").agg(F.max_by("a", "depth").alias("a"), F.max_by("b", "depth").alias("b"))
    blocks = last.groupBy(*NODE, F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids").mapInArrow(_hash_blocks, "a long, b long, ends_sha256 string")


def _add(a: str, b: str) -> Column:
    return (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """Per node (a, b) of a forest (parent (pa, pb), null at a root): each value summed over the node and all below it.

    ``_v`` is what an edge carries upwards for the nodes taken out of it. Rounds grow with the logarithm of the nodes; each
    one's tables are written to the shared folder.
    """
    carried, given, edge = ([f"{mark}{v}" for v in values] for mark in ("_", "+", "-"))
    active = materialize(tree.select(*NODE, *UP, *values, *[F.lit(0).cast("long").alias(c) for c in carried]), "active")
    raked, spliced, number = [], [], 0
    child = F.col("pa").isNotNull()
    while True:
        kids = active.where(child).groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.lit(True).alias("has_kids"))
        marked = materialize(active.join(kids, list(NODE), "left"), "marked")
        discard(active)
        leaves = marked.where("has_kids IS NULL").drop("has_kids")
        up = leaves.where(child).groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(*[F.sum(F.col(v) + F.col(c)).alias(g) for v, c, g in zip(values, carried, given, strict=True)])
        rest = materialize(marked.where("has_kids").join(up, list(NODE), "left").select(*NODE, *UP, *[_add(v, g) for v, g in zip(values, given, strict=True)], *carried), "rest")
        raked.append(leaves)
        if rest.isEmpty():
            break
        coin = lambda a, b, n=number: F.xxhash64(F.lit(n), a, b) % 2 == 0
        only = rest.where(child).groupBy(*UP).agg(F.count("*").alias("n"), F.min("a").alias("ca"), F.min("b").alias("cb"), *[F.min(c).alias(e) for c, e in zip(carried, edge, strict=True)]).where("n = 1")
        out = only.where(coin("pa", "pb") & ~coin("ca", "cb")).select(F.col("pa").alias("a"), F.col("pb").alias("b"), "ca", "cb", *edge)
        out = materialize(rest.where(child).join(out, list(NODE)), "spliced")
        moved = out.select(F.col("ca").alias("a"), F.col("cb").alias("b"), F.col("pa").alias("na"), F.col("pb").alias("nb"), *[(F.col(v) + F.col(c)).alias(g) for v, c, g in zip(values, carried, given, strict=True)], F.lit(False).alias("gone"))
        gone = out.select(*NODE, *[F.lit(None).cast("long").alias(c) for c in ("na", "nb", *given)], F.lit(True).alias("gone"))
        met = rest.join(moved.unionByName(gone), list(NODE), "left").where("gone IS NULL OR NOT gone")
        active = materialize(met.select(*NODE, *[F.when(F.col("gone").isNotNull(), F.col(n)).otherwise(F.col(p)).alias(p) for n, p in zip(("na", "nb"), UP, strict=True)], *values, *[_add(c, g) for c, g in zip(carried, given, strict=True)]), "active")
        discard(rest)
        spliced.append(out)
        number += 1
    discard(rest)
    done = raked[-1].select(*NODE, *values)
    for taken, leaves in zip(reversed(spliced), reversed(raked[:-1]), strict=True):
        below = done.select(F.col("a").alias("ca"), F.col("b").alias("cb"), *[F.col(v).alias(g) for v, g in zip(values, given, strict=True)])
        whole = [(F.col(v) + F.col(e) + F.col(g)).alias(v) for v, e, g in zip(values, edge, given, strict=True)]
        back = materialize(taken.join(below, ["ca", "cb"]).select(*NODE, *whole), "back")
        done = done.unionByName(back).unionByName(leaves.select(*NODE, *values))
    return done


def conversation_trie(conversations: DataFrame, rebuild: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A row per node of the trie of conversations' turns (conv_id, turn, role, text), as op13 describes its columns.

    ``rebuild`` may change the turns (conv_id, place, da, db, bytes) first and name their order ``seq``. A conversation that
    is left without turns is a member of the root. No conversation: no node, the root included.
    """
    turns = turns_of(conversations)
    convs = turns.groupBy("conv_id").agg(F.lit(0).cast("long").alias("depth"))
    steps = materialize(rebuild(turns), "steps") if rebuild else turns
    rows = prefixes(steps, "seq" if rebuild else "place")
    root = convs.select("conv_id", "depth", *[F.lit(0).cast("long").alias(c) for c in NODE], *[F.lit(None).cast("long").alias(c) for c in UP], F.lit(0).cast("long").alias("bytes"))
    rows = materialize(rows.withColumn("depth", F.col("depth").cast("long")).unionByName(root), "prefixes")
    nodes = rows.groupBy(*NODE, "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in UP], F.max("bytes").alias("bytes"))
    nodes = materialize(nodes, "nodes")
    kids = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    whole = nodes.join(kids, list(NODE), "left").na.fill(0, ["n_children"]).join(ends_of(rows), list(NODE), "left")
    whole = materialize(whole.na.fill(hashlib.sha256(b"").hexdigest(), ["ends_sha256"]), "nodes")
    own = whole.select(*NODE, *UP, (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    out = materialize(whole.join(subtree_totals(own, ["n_leaves", "saved_tokens"]), list(NODE)).withColumn("up", F.struct(*UP)), "trie")
    parents = out.select(F.struct(F.col("a").alias("pa"), F.col("b").alias("pb")).alias("up"), F.col("conv_id").alias("parent_conv_id"), "n_children").where("n_children > 0")
    discard(turns, rows, nodes, whole, *([steps] if rebuild else []))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return join_hot(out, parents, "up", "n_children").select(*columns)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), rebuilt)


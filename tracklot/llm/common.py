"""Helpers shared by the corpus operators: shared storage, table access, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a job go when it ends (Spark's own setting); its result is a table by then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver share. Only a local session, as in tests, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot from a thousandth of all rows on, so there are this many hot keys at most.
HOT_KEYS = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join on a key (null meets null) of which ``right`` has one row, with ``weight``, the rows that ``left`` has of it.

    The rows of ``right`` with a thousandth of all rows or more, a thousand at most, are broadcast; all others are merged,
    so no task gets a hot key's rows. ``left`` and ``right`` are read twice: give tables. ``weight`` is left out.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    rest = [c for c in right.columns if c not in (key, weight)]
    hot = F.col(weight) * HOT_KEYS >= total
    few = right.where(hot).select(F.col(key).alias("_key"), *rest, F.lit(True).alias("_hot"))
    met = left.join(F.broadcast(few), F.col(key).eqNullSafe(F.col("_key")), "left")
    many = right.where(~hot).select(F.col(key).alias("_key"), *rest)
    cold = left.join(F.broadcast(few.select("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti").join(many, F.col(key).eqNullSafe(F.col("_key")), "left")
    return met.where("_hot").drop("_key", "_hot").unionByName(cold.drop("_key"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(df: DataFrame) -> int:
    """Partitions for an explicit repartition: the session's shuffle width, or the scan's where that is wider."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


#: Buckets at most; a bucket grows beyond its wanted rows only where this many do not hold them all.
MAX_BUCKETS = 65_536


def order_bounds(df: DataFrame, keys: list[str], rows: int) -> list[tuple]:
    """The first keys (two long columns, null first) of consecutive buckets of about ``rows`` rows, however the keys are spread.

    A sort of the keys alone; the driver gets one key per bucket.
    """
    every = max(rows, -(-df.count() // MAX_BUCKETS))
    ordered = df.select(*keys).orderBy(*keys).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    found = ordered.where(F.col("_at") % every == 0).drop("_at").collect()
    return sorted({tuple(r) for r in found}, key=lambda r: tuple((x is not None, x or 0) for x in r))


def with_order_bucket(df: DataFrame, keys: list[str], bounds: list[tuple]) -> DataFrame:
    """Add ``bucket``, the number of the last bound that is not after the row's keys, and ``opens``: the row has that bound's keys.

    Bounds are looked up in two steps, so a row costs twice the root of their number. Equal keys share a bucket.
    """
    if not bounds:
        return df.withColumns({"bucket": F.lit(0).cast("long"), "opens": F.lit(False)})
    step = max(1, int(len(bounds) ** 0.5))

    def listed(rows: list[tuple]) -> Column:  # made from text, which the optimiser folds into one literal; nulls are empty
        one, two = (f"try_cast(split('{','.join('' if r[i] is None else str(r[i]) for r in rows)}', ',') AS array<bigint>)" for i in (0, 1))
        return F.expr(f"cast(arrays_zip({one}, {two}) AS array<struct<a: bigint, b: bigint>>)")

    whole, tops = listed(bounds), listed(bounds[::step])
    key = F.struct(F.col(keys[0]).cast("long").alias("a"), F.col(keys[1]).cast("long").alias("b"))
    out = df.withColumn("_key", key).withColumn("_top", F.size(F.filter(tops, lambda x: x <= F.col("_key"))))
    part = F.slice(whole, (F.col("_top") - 1) * step + 1, step)
    out = out.withColumn("bucket", ((F.col("_top") - 1) * step + F.size(F.filter(part, lambda x: x <= F.col("_key"))) - 1).cast("long"))
    return out.withColumn("opens", F.get(whole, F.col("bucket").cast("int")).eqNullSafe(F.col("_key"))).drop("_key", "_top")


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 2_000_000) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end, texts) of a batch, about ``most`` bytes at a time, null as empty: a batch is never all Python strings at once."""
    texts = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, most + (ends[low - 1] if low else 0), "right")))
        yield low, high, strings(texts.slice(low, high - low))
        low = high


_KEPT: dict[str, object] = {}


def kept(owner: str, make: Callable[[], object]):
    """What this process keeps between tasks for an owner. Other owners' memory goes first: a worker holds one at a time."""
    for other in [k for k in _KEPT if k != owner]:
        del _KEPT[other]
    if owner not in _KEPT:
        _KEPT[owner] = make()
    return _KEPT[owner]


def strings(column: pa.Array) -> list[str]:
    """Python strings of a text column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def list_array(parts: Iterable[np.ndarray], kind: pa.DataType) -> pa.Array:
    parts = list(parts)
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind, safe=False))

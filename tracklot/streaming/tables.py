"""Tables that streams write: parts by batch, folded together now and then, and a query runner with RocksDB state."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklot.sources.scratch import delete, is_whole

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Upserts:
    """A table of the newest row per key under ``path``: each batch writes a part, and every ``fold_after`` parts one base is made of all.

    Parts and bases are folders named by their last batch; a batch that runs again replaces its part. Readers take the newest
    base that is whole and the parts after it; folders that a base covers are deleted once a newer one stands beside it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], fold_after: int = 8):
        self.spark, self.path, self.keys, self.fold_after = spark, path.rstrip("/"), keys, fold_after

    def _folders(self, kind: str) -> list[int]:
        """Numbers of whole folders of a kind; the driver lists names, never rows."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(root):
            return []
        found = [(s.getPath(), re.search(r"batch=(\d+)$", s.getPath().toString())) for s in store.listStatus(root)]
        return sorted(int(m[1]) for p, m in found if m and is_whole(self.spark, p.toString()))

    def parts(self) -> tuple[list[int], list[int]]:
        """The base in use (none or one) and the parts after it."""
        bases = self._folders("base")[-1:]
        return bases, [n for n in self._folders("part") if not bases or n > bases[0]]

    def _rows(self, upto: int | None = None) -> DataFrame:
        """All rows of the base and the parts, each with its ``_batch``."""
        bases, parts = self.parts()
        paths = [f"{self.path}/base/batch={n}" for n in bases] + [f"{self.path}/part/batch={n}" for n in parts if upto is None or n <= upto]
        rows = [self.spark.read.parquet(p).withColumn("_batch", F.lit(int(p.rpartition("=")[2])).cast("long")) for p in paths]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def read(self, upto: int | None = None) -> DataFrame:
        out = self._rows(upto)
        rest = [c for c in out.columns if c not in (*self.keys, "_batch")]
        return out.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_x")).select(*self.keys, "_x.*")

    def write(self, batch: DataFrame, number: int) -> None:
        """The batch's rows, one per key."""
        bases, _ = self.parts()
        if bases and bases[0] >= number:
            return  # a batch that runs again after the fold that has it
        batch.write.mode("overwrite").parquet(f"{self.path}/part/batch={number}")
        bases, parts = self.parts()
        if len(parts) >= self.fold_after:
            self.read(number).write.mode("overwrite").parquet(f"{self.path}/base/batch={number}")
            for n in parts:
                delete(self.spark, f"{self.path}/part/batch={n}")
            for n in bases:
                delete(self.spark, f"{self.path}/base/batch={n}")


class Merged(Upserts):
    """A table whose parts say what their batch adds, so a batch reads no older rows; ``merge`` makes one row per key of those of several parts."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], fold_after: int = 8):
        super().__init__(spark, path, keys, fold_after)
        self.merge = merge

    def read(self, upto: int | None = None) -> DataFrame:
        return self.merge(self._rows(upto).drop("_batch"))


class Appends(Upserts):
    """A table of all rows that batches wrote; ``read`` adds nothing and folds nothing."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, [], 1 << 30)

    def read(self, upto: int | None = None) -> DataFrame:
        return self.some([n for n in self.numbers() if upto is None or n <= upto])

    def numbers(self) -> list[int]:
        """The batches that have a part."""
        return self._folders("part")

    def some(self, numbers: list[int]) -> DataFrame:
        """The rows of these batches."""
        return self.spark.read.parquet(*[f"{self.path}/part/batch={n}" for n in numbers])

    def keep(self, numbers: list[int]) -> None:
        """Delete the parts of all other batches."""
        for n in self._folders("part"):
            if n not in numbers:
                delete(self.spark, f"{self.path}/part/batch={n}")


class Versions(Appends):
    """A small table that every batch writes whole; the version before the newest stays, for a batch that runs again."""

    def before(self, number: int) -> DataFrame | None:
        found = [n for n in self._folders("part") if n < number]
        return self.some(found[-1:]) if found else None

    def write(self, batch: DataFrame, number: int) -> None:
        super().write(batch.coalesce(1), number)
        self.keep([number, number - 1])


class Clock:
    """How far a stream's batches have come in event time, and the watermark, ``delay`` behind the newest event of all batches so far."""

    def __init__(self, spark: SparkSession, path: str, ts: str, delay: str):
        self.spark, self.ts, self.delay, self.table = spark, ts, delay, Versions(spark, path)

    def before(self, number: int) -> tuple[dict[int, int], int | None]:
        """Newest event time of each batch before this one that the watermark had not passed whole, and the watermark after them; in microseconds."""
        found = self.table.before(number)
        rows = found.collect() if found is not None else []  # a row per batch within the delay
        return {r.batch: r.top for r in rows if r.batch is not None}, next((r.top for r in rows if r.batch is None), None)

    def tick(self, batch: DataFrame, number: int) -> tuple[dict[int, int], int | None]:
        """Enter a batch; returns the batches that still have events after the watermark before this one, and the watermark now."""
        tops, past = self.before(number)
        of = F.max(self.ts)
        top, mark = batch.agg(F.unix_micros(of), F.unix_micros(of - F.expr(f"INTERVAL '{self.delay}'"))).first()
        tops = {n: t for n, t in tops.items() if t > past} | ({} if top is None else {number: top})
        now = max((x for x in (past, mark) if x is not None), default=None)
        self.table.write(self.spark.createDataFrame([*tops.items(), (None, now)], "batch long, top long"), number)
        return tops, now

    def after(self, us: int | None) -> Column:
        """Rows that the watermark had not passed."""
        return F.col(self.ts).isNotNull() if us is None else F.col(self.ts) > F.timestamp_micros(F.lit(us))


def run_on_rocksdb(df: DataFrame, table: Upserts | Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", name: str | None = None):
    """Run a stateful query over all that is available now, its state in RocksDB; returns the ended query."""
    spark, key = df.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        writer = df.writeStream.outputMode(mode).foreachBatch(table.write if isinstance(table, Upserts) else table).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        q = (writer.queryName(name) if name else writer).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return q

"""Arrivals: a chunk is one micro-batch, whatever its size, and its files grow in number with its rows."""

from pyspark.sql import functions as F

from tracklot.sources import standin as D
from tracklot.sources.scratch import folder
from tracklot.streaming import streams


def test_a_large_arrival_has_more_files_and_is_one_batch(spark, monkeypatch):
    monkeypatch.setattr(D, "ARRIVAL_ROWS", 100, raising=False)
    root = folder(spark, "arrivals")
    rows = spark.range(1001).select("id", F.when(F.col("id") < 1000, F.col("id") % 3).otherwise(F.lit(3)).alias("c"))
    stream = D.arrivals(rows, F.col("c"), f"{root}/in", 4)
    files = spark.read.parquet(f"{root}/in").groupBy("c").agg(F.count_distinct(F.col("_metadata.file_path")).alias("n"))
    assert {r.c: r.n for r in files.collect()} == {0: 4, 1: 4, 2: 4, 3: 1}
    got = streams.take_in(stream, f"{root}/out")
    assert sorted(map(tuple, got.groupBy("batch", "c").count().collect())) == [(0, 0, 334), (1, 1, 333), (2, 2, 333), (3, 3, 1)]

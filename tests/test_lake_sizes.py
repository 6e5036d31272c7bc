"""Steps over the lake whose tasks hold bounded shares: chunks of one large batch, the index of large files, files from parts."""

from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tracklot.sources import evidence as EV
from tracklot.sources import lake as L
from tracklot.sources import standin as D
from tracklot.sources.scratch import folder


def test_a_batch_that_fills_many_ranges_is_numbered_through(spark, monkeypatch):
    monkeypatch.setattr(L, "TASK_ROWS", 50)
    rows = [(k, g, (k * 7919) % 1000) for k in range(1000) for g in ("one" if k % 50 else None,)]
    df = spark.createDataFrame(rows, "k long, g string, at long")
    out = L.assign_chunks(df, ["g"], [F.col("at"), F.col("k")], 64)
    assert len(out.inputFiles()) >= 20  # no task held the batch
    want = {}
    for name in ("one", None):
        own = sorted((at, k) for k, g, at in rows if g == name)
        want |= {k: (i // 64, -(-len(own) // 64), i % 64) for i, (_, k) in enumerate(own)}
    assert {r.k: (r.chunk_index, r.chunk_count, r.row_index) for r in out.collect()} == want
    assert L.assign_chunks(df.limit(0), ["g"], [F.col("at")], 64).count() == 0


def test_the_index_is_built_by_file_and_misses_no_row(spark, monkeypatch):
    monkeypatch.setattr(L, "TASK_ROWS", 500)
    root = folder(spark, "index")
    rows = spark.range(6000).select(F.when(F.col("id") % 9 != 0, F.col("id")).alias("k"), F.lit("all").alias("m"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("at"))
    L.write_lake(rows.repartitionByRange(3, "at"), root, "sightings", "at")
    EV.index_lake(spark, root, "sightings", ["k", "m"], "at")
    filters = spark.read.parquet(f"{root}/_index/sightings/filters")
    assert dict(filters.dtypes)["words"] == "map<int,bigint>" and filters.where("id = 'k'").agg(F.max("pages")).first()[0] <= 2
    held = {r.k: r.file for r in L.read_lake(spark, root, "sightings").select("k", F.col("_metadata.file_path").alias("file")).where("k % 500 = 1").collect()}
    assert len(set(held.values())) >= 2
    for k, file in held.items():
        assert file in {r.file for r in EV.candidate_files(spark, root, "sightings", k=k, m="all").collect()}
    assert EV.candidate_files(spark, root, "sightings", m="other").count() == 0


def test_salvage_sends_no_task_whole_ids(spark, sf, monkeypatch):
    seen, real = [], L.salvage_tables
    monkeypatch.setattr(L, "salvage_tables", lambda spark, paths, target: seen.append(paths["sightings"]) or real(spark, paths, target))
    assert {(r.name, r.action): r.files for r in entry_module.queries()["src_salvage"](spark, sf).collect()}[("sightings", "copied")] == 4
    parts = spark.read.parquet(seen[0].removesuffix("in/sightings") + "parts")
    assert [c for c in parts.columns if dict(parts.dtypes)[c] == "string"] == [] and parts.select("file").distinct().count() == 4
    there = spark.read.option("ignoreCorruptFiles", "true").parquet(seen[0])
    want = D.sightings(spark, sf).select("event_id", "listing_id")
    assert there.exceptAll(want).count() == want.exceptAll(there).count() == 0

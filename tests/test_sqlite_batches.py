"""SQLite tables go in and out in Arrow batches."""

import sqlite3
from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from tracklot.sources import sqlite as SQ


def test_batches_keep_every_value(spark, tmp_path):
    SQ.register(spark)
    path = str(tmp_path / "t")
    rows = [(1, datetime(2001, 5, 4, 3, 2, 1)), (2, datetime(2001, 5, 4, 3, 2, 1, 250)), (3, None), (None, datetime(1969, 1, 1))]
    df = spark.createDataFrame(rows, "k long, at timestamp").repartition(1)
    df.write.format("sqlite").option("path", path).option("table", "t").mode("append").save()
    with sqlite3.connect(SQ.files(path)[0]) as db:
        assert [r[0] for r in db.execute("SELECT at FROM t WHERE k < 3 ORDER BY k")] == ["2001-05-04 03:02:01", "2001-05-04 03:02:01.000250"]
    read = spark.read.format("sqlite").option("path", path).option("table", "t").load()
    assert read.exceptAll(df).count() == 0 and df.exceptAll(read).count() == 0
    reader = SQ.Reader(df.schema, {"table": "t", "path": path})
    assert all(isinstance(b, pa.RecordBatch) for p in reader.partitions() for b in reader.read(p))


def test_values_of_other_types_and_times_with_offsets(spark, tmp_path):
    SQ.register(spark)
    with sqlite3.connect(tmp_path / "one.db") as db:
        db.execute("CREATE TABLE t (x BLOB, at TIMESTAMP)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(5, "2001-05-04T03:02:01Z"), ("a", "2001-05-04"), (None, None)])
    read = spark.read.format("sqlite").option("path", str(tmp_path / "one.db")).option("table", "t").load()
    assert sorted((r.x or "", r.at or "") for r in read.select("x", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at")).collect()) == [("", ""), ("5", "2001-05-04 03:02:01"), ("a", "2001-05-04 00:00:00")]

"""The lake is written by more tasks than there are months in a year."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tracklot.sources import lake as L


class _Asked(Exception):
    pass


def test_lake_is_written_by_days(spark, sf, monkeypatch):
    def write(df, *_):
        raise _Asked(df)

    monkeypatch.setattr(L, "write_lake", write)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with pytest.raises(_Asked) as asked:
            entry_module.queries()["src_lake_round_trip"](spark, sf)
        assert asked.value.args[0].select(F.spark_partition_id().alias("p")).distinct().count() > 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

"""Lots of a backfill meet only the rows of their own batches."""

from tracklot.sources import lake as L


def test_a_lot_that_comes_again_meets_its_own_batches(spark):
    rows = spark.createDataFrame([(f"{run}-{i}", run) for run in "abcd" for i in range(3)], "event_id string, run_id string")
    lot = rows.where("run_id IN ('b', 'c')")
    there = rows.where("run_id < 'c' OR event_id = 'c-1'")
    met = L.of_batches(there, lot, ["run_id"])
    assert sorted(r.event_id for r in met.collect()) == ["b-0", "b-1", "b-2", "c-1"]
    assert sorted(r.event_id for r in L.append_missing(lot, met).collect()) == ["c-0", "c-2"]
    assert "BroadcastHashJoin" in met._jdf.queryExecution().executedPlan().toString()

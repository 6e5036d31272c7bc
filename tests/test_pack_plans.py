"""Packs of all listings move no cards: the snapshot they join is no table and has only the columns that are asked for."""

import __spark_entry__ as entry_module


def test_packs_move_no_cards(spark, sf):
    physical = entry_module.queries()["mart_evidence_packs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in physical.splitlines() if "REPARTITION_BY_NUM" in x or "Window [" in x]
    assert lines and "image_url" not in physical and "title" not in "".join(lines).replace("root_title", "")
    assert "snapshot" not in physical and "histories" not in physical

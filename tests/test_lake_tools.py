"""Evidence index, archive and prune, salvage, stored card evidence, the rank index and the SQLite source."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tracklot.operators import score as SC
from tracklot.plans import listings
from tracklot.sources import cards as CA
from tracklot.sources import evidence as EV
from tracklot.sources import lake as L
from tracklot.sources import retention as RE
from tracklot.sources import sqlite as SQ
from tracklot.sources.scratch import folder, is_whole


def test_a_lookup_opens_the_files_that_may_hold_the_row(spark):
    root = folder(spark, "evidence")
    rows = spark.range(20_000).select(F.col("id").alias("listing_id"), F.concat(F.lit("m"), F.floor(F.col("id") / 500)).alias("manifest_id"), (F.col("id") % 500).alias("row_index"), F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 5000) * 86_400).alias("at"))
    L.write_lake(rows.repartitionByRange(10, "listing_id"), root, "sightings", "at")
    EV.index_lake(spark, root, "sightings", ["manifest_id", "listing_id"], "at")
    every = spark.read.parquet(f"{root}/_index/sightings/files")
    assert every.count() >= 10 and every.agg(F.sum("rows")).first()[0] == 20_000
    found = EV.lookup_evidence(spark, root, "sightings", {"manifest_id": "m7"}, {"row_index": 3})
    assert found.first().listing_id == 3503 and len(found.inputFiles()) <= 2
    assert EV.lookup_evidence(spark, root, "sightings", {"listing_id": 12_345}, start="2023-11-16", end="2023-11-17").first().manifest_id == "m24"
    hits = sum(EV.candidate_files(spark, root, "sightings", listing_id=x).count() for x in range(100_000, 100_020))
    assert hits <= 4  # false alarms are rare
    for by, where, message in (({"manifest_id": "none"}, {}, "no row"), ({"manifest_id": "m7"}, {}, "several rows"), ({"listing_id": 5}, {"row_index": 6}, "no row")):
        with pytest.raises(LookupError, match=message):
            EV.lookup_evidence(spark, root, "sightings", by, where)


def prune(spark, root, run="r"):
    return RE.apply_retention(spark, f"{root}/table", f"{root}/archive", "at", "2024-01-03", spark.createDataFrame([(4,), (None,)], "k long"), "k", "day", run).first()


def filled(spark, root):
    rows = spark.range(40).select(F.col("id").alias("k"), (F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(hours=F.col("id") * 2)).alias("at"))
    rows = rows.withColumn("day", F.to_date("at")).unionByName(spark.createDataFrame([(99, None, None)], "k long, at timestamp, day date"))
    rows.write.partitionBy("day").parquet(f"{root}/table")


def keys(spark, path):
    return sorted(r.k for r in spark.read.parquet(path).select("k").collect())


def test_archive_and_prune(spark):
    root = folder(spark, "prune")
    filled(spark, root)
    report = prune(spark, root)
    assert (report.matched, report.archived, report.protected, report.deleted) == (24, 23, 1, 23)
    assert keys(spark, f"{root}/table") == [4, *range(24, 40), 99]
    assert keys(spark, f"{root}/archive/rows/run=r") == [k for k in range(24) if k != 4]
    assert prune(spark, root) == report  # done
    again = prune(spark, root, "s")
    assert (again.matched, again.archived, again.protected) == (1, 0, 1)
    assert keys(spark, f"{root}/table") == [4, *range(24, 40), 99]


@pytest.mark.parametrize("step", ["plan", "rows", "kept", "report"])
def test_a_cut_off_run_goes_on(spark, monkeypatch, step):
    """The job that writes a step's folder fails once; what the next call leaves is the same."""
    root = folder(spark, "cut")
    filled(spark, root)
    kind = type(spark.range(1).write)
    whole, failed = kind.parquet, []

    def parquet(self, path, *a, **b):
        if f"/{step}" in path and not failed:
            failed.append(path)
            raise OSError("lost")
        return whole(self, path, *a, **b)

    monkeypatch.setattr(kind, "parquet", parquet)
    with pytest.raises(OSError, match="lost"):
        prune(spark, root)
    assert prune(spark, root).archived == 23 and failed
    assert keys(spark, f"{root}/table") == [4, *range(24, 40), 99] and keys(spark, f"{root}/archive/rows/run=r") == [k for k in range(24) if k != 4]
    assert not is_whole(spark, f"{root}/archive/_runs/r/kept")


def test_a_changed_archive_stops_the_run(spark):
    root = folder(spark, "changed")
    filled(spark, root)
    spark.createDataFrame([(1, None, None)], "k long, at timestamp, day date").write.parquet(f"{root}/archive/rows/run=r")
    with pytest.raises(ValueError, match="not what was planned"):
        prune(spark, root)
    assert len(keys(spark, f"{root}/table")) == 41


def test_a_backfill_goes_on_where_it_was_cut_off(spark):
    root, rows, lots = folder(spark, "backfill"), spark.range(30).select("id", (F.col("id") % 10).alias("k")), []

    def deliver(lot):
        if len(lots) == 2:
            lots.append(None)
            raise OSError("lost")
        lots.append({r.k for r in lot.collect()})

    with pytest.raises(OSError, match="lost"):
        L.run_backfill(spark, rows, ["k"], f"{root}/ledger", deliver, 3)
    assert L.run_backfill(spark, rows, ["k"], f"{root}/ledger", deliver, 3) == 2
    assert lots == [{0, 1, 2}, {3, 4, 5}, None, {6, 7, 8}, {9}]
    assert L.run_backfill(spark, rows, ["k"], f"{root}/ledger", deliver, 3) == 0


def test_salvage_names_the_broken_file(spark):
    root = folder(spark, "salvage")
    spark.range(100).repartition(4).write.parquet(f"{root}/in/t")
    with open(f"{root}/in/t/part-x.parquet".removeprefix("file://"), "wb") as f:
        f.write(b"PAR1 this is none")
    report = L.salvage_tables(spark, {"t": f"{root}/in/t"}, f"{root}/out").collect()
    assert [r.file.rpartition("/")[2] for r in report if r.action == "skipped"] == ["part-x.parquet"] and sum(r.rows for r in report) == 100
    assert spark.read.parquet(f"{root}/out/t").agg(F.sum("id")).first()[0] == 4950


EVIDENCE = [
    ({"schema_version": 1, "evidence_source": "api", "fragments": {"title": " A  b ", "brand_title": None, "brand": {"title": "Z"}, "status": "", "status_id": "3", "price": {"amount": "1 234,5", "currency_code": "EUR"}}}, ("api", "A b", "Z", None, "Très bon état", 123450, "€")),
    ({"schema_version": 1, "evidence_source": "other", "fragments": {"overlay_title": "Robe, Marque: Zara , taille: M, État: Bon", "price_text": "12,50 €"}}, ("html", "Robe", "Zara", "M", "Bon", 1250, "€")),
    ({"schema_version": 2, "fragments": {"title": "no"}, "title": "flat", "size_title": 7, "price": 5}, ("api", "flat", None, None, None, None, None)),
    ({"description_title": "Brand", "description_subtitle": "L · Neuf", "image_alt": "Alt title, x"}, ("html", "Alt title", "Brand", "L", "Neuf", None, None)),
    ({}, ("html", "blue dress", None, None, None, None, None)),
    ({"title": 5, "price": {"amount": 3.5, "currency_code": "PLN"}}, ("api", None, None, None, None, 350, "PLN")),
    ([1], (None,) * 7), ("text", (None,) * 7), (None, (None,) * 7),
]


def test_evidence_in_every_shape(spark):
    df = spark.createDataFrame([(i, json.dumps(e) if e is not None else None, "https://s.example/items/12-blue-dress?x=1") for i, (e, _) in enumerate(EVIDENCE)], "i int, raw_card_json string, source_url string")
    rows = CA.normalize_cards(df).orderBy("i").select("evidence_kind", "title", "brand", "size_label", "condition_label", "price_amount_cents", "price_currency").collect()
    assert [tuple(r) for r in rows] == [want for _, want in EVIDENCE]


def test_an_envelope_keeps_what_explains_the_card(spark):
    item = {"title": "t", "brand": {"title": "b"}, "user": {"id": 1}, "price": {"amount": " ", "currency_code": None}, "total_item_price": {"amount": 5}}
    df = spark.createDataFrame([(json.dumps(item), "x", None)], "item string, alt string, sub string")
    r = df.select(CA.api_evidence(F.col("item")), CA.html_evidence(image_alt=F.col("alt"), description_subtitle=F.col("sub"))).first()
    assert json.loads(r[0]) == {"schema_version": 1, "evidence_source": "api", "fragments": {"title": "t", "brand_title": "b", "total_item_price": {"amount": "5"}}}
    assert json.loads(r[1]) == {"schema_version": 1, "evidence_source": "html", "fragments": {"image_alt": "x"}}
    with pytest.raises(ValueError, match="no fragments"):
        CA.html_evidence(body=F.col("alt"))


def test_a_score_reads_the_buckets_of_its_contexts(spark, sf):
    snap = listings.snapshot(spark, sf)
    SC.write_rank_index(snap, "rank_index_test", folder(spark, "rank"), 32)
    rows = SC.rank_rows(spark, "rank_index_test", ["root|[\"first\"]"], 150_000)
    plan = rows._jdf.queryExecution().toString()
    assert "SelectedBucketsCount: 1 out of 32" in plan and "PushedFilters: [In" in plan or "EqualTo(context" in plan
    every = {r.listing_id: (r.premium_score, r.context_name, r.price_percentile) for r in SC.score_listings(snap).collect()}
    for i in sorted(every)[::97]:
        one = SC.score_detail(snap, i, "rank_index_test").first()
        assert (one.premium_score, one.context_name, one.price_percentile) == every[i]
    assert SC.score_detail(snap, -5, "rank_index_test").count() == 0


def test_sqlite_reads_stretches_and_takes_filters(spark, tmp_path):
    SQ.register(spark)
    rows = [(i, f"n{i % 5}" if i % 4 else None, i / 4, i % 2 == 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, name string, v double, even boolean").withColumn("at", F.timestamp_seconds(F.col("k") * 1000))
    path = str(tmp_path / "t")
    for mode in ("append", "overwrite"):
        df.repartition(3).write.format("sqlite").option("path", path).option("table", "t").mode(mode).save()
    read = spark.read.format("sqlite").option("path", path).option("table", "t").option("rowsPerSplit", 100).load()
    assert read.schema == df.schema and read.rdd.getNumPartitions() >= 10
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    some = read.where("k > 900 AND name IN ('n1', 'n2') AND even")
    assert {r.k for r in some.collect()} == {r[0] for r in rows if r[0] > 900 and r[1] in ("n1", "n2") and r[3]}
    reader = SQ.Reader(df.schema, {"table": "t", "path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, StringContains

    left = list(reader.pushFilters([GreaterThan(("k",), 5), In(("name",), ("a",)), IsNull(("name",)), EqualTo(("even",), True), StringContains(("name",), "x")]))
    assert [type(f) for f in left] == [EqualTo, StringContains] and len(reader.tests) == 3


def test_sqlite_files_of_others(spark, tmp_path):
    SQ.register(spark)
    with sqlite3.connect(tmp_path / "one.db") as db:
        db.execute("CREATE TABLE other (id INTEGER PRIMARY KEY, note VARCHAR(9))")
        db.execute("CREATE TABLE empty (id INTEGER)")
        db.executemany("INSERT INTO other VALUES (?, ?)", [(5, "a"), (900_000, None)])
    load = lambda t: spark.read.format("sqlite").option("path", str(tmp_path / "one.db")).option("table", t).load()
    assert sorted(map(tuple, load("other").collect())) == [(5, "a"), (900_000, None)] and load("empty").count() == 0
    with pytest.raises(Exception, match="no table"):
        load("none").count()

"""Queries over sources, parsing, quality, collection analytics and streams; each beside its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklot import constants as C
from tracklot.functions import columns as X
from tracklot.functions import identity as I
from tracklot.operators import changes as CH
from tracklot.operators import explore as E
from tracklot.operators import marts as M
from tracklot.operators import observe as O
from tracklot.operators import ops as OP
from tracklot.operators import quality as Q
from tracklot.operators import rollups as R
from tracklot.operators import score as SC
from tracklot.operators import state as S
from tracklot.plans import prelude as P
from tracklot.plans.listings import _BAND, _LENSES, STATE, pack_base, packs_of_all, price_changes, query, scores, snapshot, transitions
from tracklot.sources import cards as CA
from tracklot.sources import evidence as EV
from tracklot.sources import lake as L
from tracklot.sources import parse as PR
from tracklot.sources import retention as RE
from tracklot.sources import sqlite as SQ
from tracklot.sources import standin as D
from tracklot.sources.scratch import delete, folder, is_whole, materialize
from tracklot.streaming import change_state as CG
from tracklot.streaming import listing_state as LS
from tracklot.streaming import streams as ST

DEGRADED = "(coalesce(error_message, '') <> '' OR coalesce(response_status IN (403, 429) OR response_status >= 500, false) OR coalesce(reason IN ('anti_bot_challenge', 'probe_exception') OR starts_with(reason, 'unexpected_http_') OR starts_with(reason, 'http_'), false))"


@query("src_lake_round_trip", sql="SELECT event_id, listing_id, day AS occurred_on FROM sightings")
def _(spark, d):
    root = folder(spark, "lake")
    s = D.sightings(spark, d).select("event_id", "listing_id", "observed_at", F.struct("title", "brand").alias("card"))
    L.write_lake(s.repartition(F.to_date("observed_at")), root, "sightings", "observed_at")
    return L.read_lake(spark, root, "sightings").select("event_id", "listing_id", "occurred_on")


@query("src_export_sightings", P.CARDS, sql="SELECT s.event_id, coalesce(s.title, c.title) AS title, coalesce(s.brand, c.brand) AS brand, coalesce(s.price_amount_cents, c.price_amount_cents) AS price_amount_cents, sc.fetched_at, sc.success FROM sightings s LEFT JOIN cards c USING (listing_id) LEFT JOIN scans sc ON sc.catalog_id = s.catalog_id AND sc.run_id = s.run_id")
def _(spark, d):
    s = D.sightings(spark, d)
    return L.export_sightings(s, O.latest_cards(s), D.catalogs(spark, d), D.scans(spark, d)).select("event_id", "title", "brand", "price_amount_cents", "fetched_at", "success")


@query("src_export_observations", P.OBS, P.CARDS, sql="SELECT o.run_id, o.listing_id, o.observed_at, o.sighting_count, c.title, c.catalog_path FROM obs o LEFT JOIN cards c USING (listing_id)")
def _(spark, d):
    s = D.sightings(spark, d)
    return L.export_observations(O.fold_observations(s), O.latest_cards(s)).select("run_id", "listing_id", "observed_at", "sighting_count", "title", "catalog_path")


@query("src_export_probes", P.CARDS, sql="SELECT p.probe_id, p.listing_id, CAST(p.probed_at AS DATE) AS probed_on, c.title FROM probes p LEFT JOIN cards c USING (listing_id)")
def _(spark, d):
    return L.export_probes(D.probes(spark, d), O.latest_cards(D.sightings(spark, d))).select("probe_id", "listing_id", "probed_on", "title")


@query("src_assign_chunks", sql="SELECT event_id, (row_number() OVER w - 1) // 100 AS chunk_index, (count(*) OVER (PARTITION BY run_id, catalog_id) + 99) // 100 AS chunk_count, (row_number() OVER w - 1) % 100 AS row_index FROM sightings WINDOW w AS (PARTITION BY run_id, catalog_id ORDER BY observed_at, event_id)")
def _(spark, d):
    return L.assign_chunks(D.sightings(spark, d).select("event_id", "run_id", "catalog_id", "observed_at"), ["run_id", "catalog_id"], [F.col("observed_at"), F.col("event_id")], 100).select("event_id", "chunk_index", "chunk_count", "row_index")


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (CAST('0x' || substr(h, 17, 1) AS INTEGER) & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query("src_manifests", sql=f"""SELECT *, {_UUID.replace("h,", "sha1(unhex('" + I.NAMESPACE.hex + "') || encode('manifest:{" + '"catalog_id":"' + "' || catalog_id || '" + '","run_id":"' + "' || run_id || '" + '"}' + "')),")} AS manifest_id FROM (SELECT run_id, catalog_id, min(observed_at) AS first_at, max(observed_at) AS last_at, count(*) AS row_count, sum(CAST('0x' || substr(sha256(event_id), 1, 15) AS BIGINT)) || '-' || sum(CAST('0x' || substr(sha256(event_id), 16, 15) AS BIGINT)) AS checksum FROM sightings GROUP BY 1, 2)""")
def _(spark, d):
    return L.build_manifests(D.sightings(spark, d), ["run_id", "catalog_id"], "observed_at", "event_id")


@query("src_append_missing", sql="SELECT event_id FROM sightings WHERE run_id >= '2001-01'")
def _(spark, d):
    s = D.sightings(spark, d)
    return L.append_missing(s, s.where("run_id < '2001-01'")).select("event_id")


@query("set_existing_events", sql="SELECT event_id FROM sightings WHERE run_id < '1997-01'")
def _(spark, d):
    s = D.sightings(spark, d)
    return L.existing(s, s.where("run_id < '1997-01'"))


@query("src_backfill", sql="SELECT run_id, catalog_id, (SELECT count(*) FROM scans WHERE run_id >= '2000-01') AS to_deliver, (SELECT count(*) FROM scans WHERE run_id < '2000-01') AS to_skip FROM scans WHERE run_id >= '2000-01'")
def _(spark, d):
    s = D.scans(spark, d).select("run_id", "catalog_id")
    todo, counts = L.backfill(s, s.where("run_id < '2000-01'"), ["run_id", "catalog_id"])
    return todo.crossJoin(F.broadcast(counts))  # one row


@query("src_run_backfill", sql="SELECT event_id, run_id, CAST(1 AS BIGINT) AS copies FROM sightings")
def _(spark, d):
    """Sightings delivered by run, twelve runs a lot: first those before 2000, then all; nothing comes twice."""
    root, s = folder(spark, "backfill"), materialize(D.sightings(spark, d).select("event_id", "run_id"), "sightings")

    def deliver(lot):
        there = spark.read.parquet(f"{root}/rows") if is_whole(spark, f"{root}/rows") else None
        new = lot if there is None else L.append_missing(lot, L.of_batches(there, lot, ["run_id"]))
        new.write.mode("append").parquet(f"{root}/rows")

    for part in (s.where("run_id < '2000-01'"), s):
        L.run_backfill(spark, part, ["run_id"], f"{root}/ledger", deliver, 12)
    return spark.read.parquet(f"{root}/rows").groupBy("event_id", "run_id").agg(F.count("*").alias("copies"))


@query("src_plan_retention", P.OBS, sql="SELECT count(*) AS matched, count(*) FILTER (WHERE listing_id % 5 <> 0) AS archived, count(*) FILTER (WHERE listing_id % 5 = 0) AS protected FROM sightings WHERE observed_at < TIMESTAMP '1998-01-01'")
def _(spark, d):
    s = D.sightings(spark, d)
    return L.retention_report(L.plan_retention(s, "observed_at", "1998-01-01", s.where("listing_id % 5 = 0"), "listing_id"))


@query("src_evidence_lookup", sql="SELECT event_id, listing_id, price_amount_cents, catalog_id, row_index FROM (SELECT *, row_number() OVER (PARTITION BY run_id, catalog_id ORDER BY observed_at, event_id) - 1 AS row_index, max(run_id) OVER (PARTITION BY catalog_id) AS last_run FROM sightings) WHERE run_id = last_run AND row_index = 0")
def _(spark, d):
    """The first row of each catalog's latest batch, found in the lake by its manifest through the index."""
    root = folder(spark, "lake")
    s = L.assign_chunks(D.sightings(spark, d).select("event_id", "listing_id", "catalog_id", "run_id", "price_amount_cents", "observed_at"), ["run_id", "catalog_id"], [F.col("observed_at"), F.col("event_id")], 1 << 30)
    batch = I.deterministic_uuid("manifest", run_id=F.col("run_id"), catalog_id=F.col("catalog_id").cast("string"))
    s = s.select("event_id", "listing_id", "catalog_id", "run_id", "price_amount_cents", "observed_at", "row_index", batch.alias("manifest_id"), F.trunc("observed_at", "month").alias("month"))
    L.write_lake(s.repartition(L.tasks_for(s, s.count()), "run_id", F.floor(F.col("row_index") / (L.TASK_ROWS // 5))), root, "sightings", "month")
    EV.index_lake(spark, root, "sightings", ["manifest_id", "listing_id"], "observed_at")
    wanted, out = s.groupBy("catalog_id").agg(F.max("run_id").alias("run_id")).select(batch.alias("m")).collect(), None  # a row per catalog
    for r in wanted:
        row = EV.lookup_evidence(spark, root, "sightings", {"manifest_id": r.m}, {"row_index": 0}).select("event_id", "listing_id", "price_amount_cents", "catalog_id", "row_index")
        out = row if out is None else out.unionByName(row)
    return out


@query("src_retention_apply", sql="SELECT event_id, run_id, CASE WHEN observed_at < TIMESTAMP '1998-01-01' AND listing_id % 5 <> 0 THEN 'archived' ELSE 'kept' END AS place FROM sightings")
def _(spark, d):
    """What the table and the archive hold after two runs, the second of which finds nothing more to do."""
    root, s = folder(spark, "retention"), D.sightings(spark, d)
    s.select("event_id", "listing_id", "observed_at", "run_id").repartition("run_id").write.partitionBy("run_id").parquet(f"{root}/table")
    for run in ("first", "second"):
        RE.apply_retention(spark, f"{root}/table", f"{root}/archive", "observed_at", "1998-01-01", s.where("listing_id % 5 = 0"), "listing_id", "run_id", run)
    kept = spark.read.parquet(f"{root}/table").select("event_id", F.col("run_id").cast("string").alias("run_id"), F.lit("kept").alias("place"))
    return kept.unionByName(spark.read.parquet(f"{root}/archive/rows/run=first").select("event_id", F.col("run_id").cast("string").alias("run_id"), F.lit("archived").alias("place")))


@query("src_salvage", sql="SELECT 'sightings' AS name, 'copied' AS action, 4 AS files, count(*) AS rows FROM sightings UNION ALL SELECT 'sightings', 'skipped', 1, 0 UNION ALL SELECT 'scans', 'copied', 1, count(*) FROM scans UNION ALL SELECT 'lost', 'skipped', 1, 0")
def _(spark, d):
    """Two tables and a lost one; a file that is no Parquet lies among the first one's.

    Its four files are put together from the parts of the ids, which are set aside by file: the task of a file reads these,
    and no task is sent a quarter of all ids.
    """
    root = folder(spark, "salvage")
    D.id_parts(spark, d).withColumn("file", F.pmod(F.xxhash64("order", "line"), F.lit(4))).write.option("compression", "zstd").partitionBy("file").parquet(f"{root}/parts")
    parts = spark.read.parquet(f"{root}/parts")
    files = reduce(DataFrame.unionByName, [parts.where(F.col("file") == i) for i in range(4)]).coalesce(4)  # scan by scan, so that there are four
    D.with_ids(files).select("event_id", "listing_id").write.parquet(f"{root}/in/sightings")
    D.scans(spark, d).coalesce(1).write.parquet(f"{root}/in/scans")
    for name in ("sightings", "lost"):
        D.read(spark, d, "region").select(F.col("r_name").alias("value")).coalesce(1).write.option("compression", "none").mode("append").text(f"{root}/bad/{name}")
        _rename(spark, f"{root}/bad/{name}", f"{root}/in/{name}/part-broken.parquet")
    report = L.salvage_tables(spark, {n: f"{root}/in/{n}" for n in ("sightings", "scans", "lost")}, f"{root}/out")
    return report.groupBy("name", "action").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))


def _rename(spark, source, target):
    """The only file that a job wrote to a folder, under another name."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path(target).getParent())
    store.rename(next(f.getPath() for f in store.listStatus(path(source)) if f.getPath().getName().startswith("part-")), path(target))


@query("src_sqlite", sql="SELECT event_id, listing_id, brand, price_amount_cents, observed_at, coalesce(price_amount_cents > 200000, false) AS is_dear FROM sightings WHERE price_amount_cents >= 150000 AND brand IS NOT NULL")
def _(spark, d):
    """Sightings written to SQLite files, as many as their size asks for, and read back in stretches with the filters left to SQLite."""
    SQ.register(spark)
    path = folder(spark, "sqlite")
    s = D.sightings(spark, d).select("event_id", "listing_id", "brand", "price_amount_cents", "observed_at", F.coalesce(F.col("price_amount_cents") > 200_000, F.lit(False)).alias("is_dear"))
    s.hint("rebalance").write.format("sqlite").option("path", path).option("table", "sightings").mode("append").save()
    back = spark.read.format("sqlite").option("path", path).option("table", "sightings").load()
    return back.where("price_amount_cents >= 150000 AND brand IS NOT NULL")


@query("prs_card_evidence", sql="""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'api' WHEN 2 THEN 'api' WHEN 4 THEN NULL ELSE 'html' END AS evidence_kind, CASE WHEN p_partkey % 5 <> 4 THEN p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN 'own' WHEN p_partkey % 5 <> 4 THEN p_brand END AS brand,
  CASE WHEN p_partkey % 5 <> 4 THEN 'S' || p_size END AS size_label, CASE WHEN p_partkey % 5 <> 4 THEN 'Bon état' END AS condition_label, CASE WHEN p_partkey % 5 <> 4 THEN p_size * 100 + 50 END AS price_amount_cents, CASE WHEN p_partkey % 5 <> 4 THEN '€' END AS price_currency FROM part""")
def _(spark, d):
    """Evidence in every shape: envelopes of both sources, both flat shapes, and texts that are none; brands that are known stay."""
    p = D.read(spark, d, "part").withColumn("cents", F.format_string("%s,50", F.col("p_size").cast("string")))
    item = F.to_json(F.struct(F.concat(F.lit(" "), "p_name", F.lit("  ")).alias("title"), F.struct(F.col("p_brand").alias("title")).alias("brand"), F.concat(F.lit("S"), "p_size").alias("size_title"), F.lit(4).alias("status_id"), F.struct(F.col("cents").alias("amount"), F.lit("EUR").alias("currency_code")).alias("price"), F.struct(F.lit("x").alias("login")).alias("user")))
    alt = F.concat("p_name", F.lit(", marque: "), "p_brand", F.lit(", taille: S"), "p_size", F.lit(", État: Bon état"))
    texts = {"overlay_title": alt, "price_text": F.concat("cents", F.lit("\u00a0€"))}
    kind = F.col("p_partkey") % 5
    raw = F.when(kind == 0, CA.api_evidence(item)).when(kind == 1, CA.html_evidence(**texts)).when(kind == 2, item).when(kind == 3, F.to_json(F.struct(*[c.alias(n) for n, c in texts.items()]))).otherwise(F.lit("not json"))
    stored = p.select("p_partkey", raw.alias("raw_card_json"), F.lit("https://shop.example/items/1-x").alias("source_url"), F.when(F.col("p_partkey") % 3 == 0, "own").alias("brand"))
    return CA.normalize_cards(stored).select("p_partkey", "evidence_kind", "title", "brand", "size_label", "condition_label", "price_amount_cents", "price_currency")


@query("score_detail", *STATE, P.SCORES, sql="SELECT listing_id, demand_score, context_name, context_size, price_percentile, premium_score, context_name IS NOT NULL AS explained FROM scores WHERE listing_id IN (SELECT min(listing_id) FROM scores GROUP BY catalog_id UNION SELECT max(listing_id) FROM scores GROUP BY brand)")
def _(spark, d):
    """Some listings' scores, one by one, from the stored rank index; the SQL scores all listings."""
    snap, name = snapshot(spark, d), f"rank_index_{uuid.uuid4().hex}"
    SC.write_rank_index(snap, name, folder(spark, "rank-index"))
    ids = snap.groupBy("catalog_id").agg(F.min("listing_id").alias("id")).select("id").union(snap.groupBy("brand").agg(F.max("listing_id").alias("id")).select("id")).distinct()
    wanted, out = [r.id for r in ids.collect()], None  # a row per catalog and brand
    snap = materialize(snap.where(F.col("listing_id").isin(wanted)), "wanted")  # else every lookup would read the whole snapshot
    for i in wanted:
        one = SC.score_detail(snap, i, name).select("listing_id", "demand_score", "context_name", "context_size", "price_percentile", "premium_score", F.col("score_explanation.context").isNotNull().alias("explained"))
        out = one if out is None else out.unionByName(one)
    return out


@query("src_extract_path", sql="SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, d):
    return D.read(spark, d, "events").select("event_id", I.extract_path("props", "k").alias("k"))


@query("src_flatten_and_decode", sql="SELECT event_id, title, price_amount_cents AS price, brand, size_label AS tag, run_id AS noted FROM sightings")
def _(spark, d):
    """A struct in a struct, an array and a map, through JSON text and back."""
    s = D.sightings(spark, d).select("event_id", F.struct("title", F.struct("price_amount_cents", "brand").alias("offer")).alias("card"), F.array(F.lit(None).cast("string"), "size_label").alias("tags"), F.create_map(F.lit("run"), "run_id").alias("notes"))
    back = I.decode_json_columns(I.flatten_nested(s), {"card": "struct<title: string, offer: struct<price_amount_cents: bigint, brand: string>>", "tags": "array<string>", "notes": "map<string, string>"})
    return back.select("event_id", "card.title", F.col("card.offer.price_amount_cents").alias("price"), "card.offer.brand", F.get("tags", 1).alias("tag"), F.col("notes")["run"].alias("noted"))


@query("prj_checksum", sql="SELECT event_id, sha256('{\"listing\":' || listing_id || ',\"run\":\"' || run_id || '\"}') AS checksum FROM sightings")
def _(spark, d):
    return D.sightings(spark, d).select("event_id", I.sha256_json(run="run_id", listing="listing_id").alias("checksum"))


@query("prj_uuid5", sql=f"""SELECT event_id, {_UUID} AS uuid FROM (SELECT event_id, sha1(unhex('{I.NAMESPACE.hex}') || encode('sighting:{{"event":"' || event_id || '"}}')) AS h FROM sightings)""")
def _(spark, d):
    return D.sightings(spark, d).select("event_id", I.deterministic_uuid("sighting", event="event_id").alias("uuid"))


@query("prj_storage_segment", sql="SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS segment FROM part")
def _(spark, d):
    return D.read(spark, d, "part").select("p_partkey", X.storage_segment(F.concat("p_name", F.lit(" / "), "p_brand")).alias("segment"))


@query("prj_canonical_url", sql="SELECT page_id, regexp_replace(url, '[?#].*$', '') AS canonical FROM pages")
def _(spark, d):
    return D.read(spark, d, "pages").select("page_id", X.canonical_url("url").alias("canonical"))


@query("prj_redaction", sql="SELECT page_id, regexp_replace('http://user:pw@' || substr(url, strpos(url, '://') + 3), '://[^/@\\s]+@', '://***@') AS link, '***' AS api_key FROM pages")
def _(spark, d):
    p = D.read(spark, d, "pages").select("page_id", F.expr("concat('http://user:pw@', substring(url, instr(url, '://') + 3))").alias("link"), F.lit("abc").alias("api_key"))
    return I.redact(p)


_CONDITION_SQL = " ".join(f"WHEN {k} THEN '{v}'" for k, v in C.CONDITIONS.items())


@query("prs_parse_api_pages", sql=f"SELECT l_orderkey AS page, l_partkey AS listing_id, p_name AS title, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_amount_cents, 'https://shop.example/items/' || l_partkey AS canonical_url, CASE p_size % 6 + 1 {_CONDITION_SQL} END AS condition_label, 'https://img.example/' || CASE l_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS image_url FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(spark, d):
    rows = D.read(spark, d, "lineitem").join(D.read(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    image = lambda name: F.lit(f"https://img.example/{name}").alias("url")
    kind = F.col("l_partkey") % 3  # an image in each of three places
    photo = F.when(kind == 0, F.struct(image("a"), F.lit(None).cast("string").alias("full_size_url"))).when(kind == 1, F.struct(F.lit(None).cast("string").alias("url"), F.lit("https://img.example/b").alias("full_size_url")))
    item = F.struct(
        F.col("l_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("https://shop.example/items/"), "l_partkey", F.lit("?ref=x")).alias("url"), (F.col("p_size") % 6 + 1).alias("status_id"),
        F.struct(F.format_string("%.2f", "l_extendedprice").alias("amount"), F.lit("EUR").alias("currency_code")).alias("price"), photo.alias("photo"), F.when(kind == 2, F.array(F.struct(image("c")))).alias("photos"),
    )
    pages = rows.groupBy(F.col("l_orderkey").alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("body"))
    return PR.parse_api_pages(pages).select("page", "listing_id", "title", "price_amount_cents", "canonical_url", "condition_label", "image_url")


@query("prs_parse_pagination", sql="SELECT o_orderkey, CAST(ceil(o_orderkey / 96.0) AS INTEGER) AS total_pages FROM orders")
def _(spark, d):
    o = D.read(spark, d, "orders").select("o_orderkey", F.concat(F.lit('{"pagination":{"current_page":1,"per_page":96,"total_entries":'), "o_orderkey", F.lit("}}")).alias("body"))
    return PR.parse_pagination(o).select("o_orderkey", "total_pages")


@query("prs_parse_money", sql="SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem")
def _(spark, d):
    shown = F.concat(F.translate(F.format_number("l_extendedprice", 2), ",.", ".,"), F.lit(" €"))
    return D.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.parse_money(shown).alias("cents"))


@query("prs_parse_html_cards", sql="SELECT p_partkey AS listing_id, p_name AS title, p_brand AS brand, 'https://shop.example/items/' || p_partkey || '-x' AS canonical_url, p_size * 100 + 50 AS price_amount_cents FROM part")
def _(spark, d):
    html = F.format_string('<div><a href="https://shop.example/items/%s-x?q=1" title="%s, brand: %s, état: bon"><p data-testid="item-subtitle">M · bon</p><b>%s,50 €</b></a></div>', F.col("p_partkey").cast("string"), "p_name", "p_brand", F.col("p_size").cast("string"))
    return PR.parse_html_pages(D.read(spark, d, "part").select(html.alias("html"))).select("listing_id", "title", "brand", "canonical_url", "price_amount_cents")


#: One page per event: its flags, own id, markers and status follow from the event's number.
_PAGE = (
    "event_id", "event_id % 2 = 0 AS can_buy", "event_id % 3 = 0 AS is_closed", "event_id % 5 = 0 AS is_hidden", "event_id % 7 = 0 AS is_reserved", "event_id % 11 = 0 AS other", "event_id % 13 = 0 AS bare", "event_id % 4 = 1 AS marked",
    "CASE event_id % 17 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 403 WHEN 3 THEN 418 WHEN 4 THEN NULL ELSE 200 END AS status",
)
_OPEN, _SOLD, _GONE = "can_buy AND NOT is_closed AND NOT is_hidden", "is_closed AND NOT can_buy", "is_hidden OR is_reserved OR NOT can_buy"


@query("prs_classify_probe_pages", sql=f"""SELECT event_id, probe_outcome, reason, reason = 'anti_bot_challenge' OR (status IS NULL AND marked) AS has_markers FROM (SELECT *,
  CASE WHEN status = 404 THEN 'deleted' WHEN status IS NULL OR status >= 400 OR bare OR other THEN 'unknown' WHEN {_OPEN} THEN 'active' WHEN {_SOLD} THEN 'sold' WHEN {_GONE} THEN 'unavailable' ELSE 'unknown' END AS probe_outcome,
  CASE WHEN status IN (404, 503) THEN 'http_' || status WHEN status IS NULL THEN 'no_response_status' WHEN status = 403 OR marked AND (status = 418 OR bare) THEN 'anti_bot_challenge' WHEN status = 418 THEN 'unexpected_http_418'
  WHEN bare THEN 'buy_signal_not_found' WHEN other THEN 'item_id_mismatch' WHEN {_OPEN} THEN 'buy_signal_open' WHEN {_SOLD} THEN 'buy_signal_closed' WHEN {_GONE} THEN 'buy_signal_unavailable' ELSE 'buy_signal_ambiguous' END AS reason
  FROM (SELECT {", ".join(_PAGE)} FROM events))""")
def _(spark, d):
    quoted = lambda name, value: F.concat(F.lit(f'\\"{name}\\":'), value.cast("string"))
    own = F.when(F.col("other"), F.col("event_id") + 1).otherwise(F.col("event_id"))
    signal = F.concat(quoted("item_id", own), F.lit(',"x":1,'), F.concat_ws(",", *[quoted(n, F.col(n)) for n in ("can_buy", "is_closed", "is_hidden", "is_reserved")]))
    html = F.concat(F.when(F.col("marked"), "<p>Just a Moment</p>").otherwise("<p>hello</p>"), F.when(F.col("bare"), "").otherwise(signal))
    pages = D.read(spark, d, "events").selectExpr(*_PAGE).select("event_id", F.col("event_id").alias("listing_id"), "status", html.alias("html"))
    return PR.classify_probe_pages(pages).select("event_id", "probe_outcome", "reason", F.col("challenge_markers").isNotNull().alias("has_markers"))


@query("prs_catalog_tree", sql="SELECT r_regionkey AS id, NULL AS parent_id, r_regionkey AS root_id, r_name AS path, 0 AS depth, false AS is_leaf FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_regionkey, r_name || ' > ' || n_name, 1, true FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    kids = D.read(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct((F.col("n_nationkey") + 100).alias("id"), F.col("n_name").alias("title")))).alias("kids"))
    tree = D.read(spark, d, "region").join(kids, F.expr("r_regionkey = n_regionkey")).select(F.concat(F.lit('[{"id":'), "r_regionkey", F.lit(',"title":"'), "r_name", F.lit('","catalogs":'), "kids", F.lit("}]")).alias("body"))
    return PR.flatten_catalog_tree(tree).select("id", "parent_id", "root_id", "path", "depth", "is_leaf")


@query("agg_probe_summary", sql=f"SELECT count(*) AS probed, count(*) FILTER (WHERE probe_outcome = 'active') AS active, count(*) FILTER (WHERE probe_outcome = 'sold') AS sold, count(*) FILTER (WHERE probe_outcome = 'unavailable') AS unavailable, count(*) FILTER (WHERE probe_outcome = 'deleted') AS deleted, count(*) FILTER (WHERE probe_outcome = 'unknown') AS unknown, count(*) FILTER (WHERE probe_outcome <> 'unknown') AS direct_signals, count(*) FILTER (WHERE {DEGRADED}) AS degraded, count(*) FILTER (WHERE response_status IN (403, 429)) AS anti_bot, count(*) FILTER (WHERE response_status >= 500) AS http_errors, count(error_message) AS transport_errors, CASE WHEN count(*) = 0 THEN 'unknown' WHEN count(*) FILTER (WHERE {DEGRADED}) * 2 > count(*) THEN 'degraded' WHEN count(*) FILTER (WHERE {DEGRADED}) > 0 THEN 'partial' ELSE 'healthy' END AS status FROM probes")
def _(spark, d):
    return OP.summarize_probes(D.probes(spark, d))


@query("agg_top_failing_catalogs", sql="SELECT catalog_id, count(*) AS failures, max(fetched_at) AS latest_at, count(*) FILTER (WHERE response_status = 403) AS blocked, min(coalesce(error_message, 'n/a')) AS sample_message FROM scans WHERE NOT success GROUP BY 1 ORDER BY failures DESC, catalog_id LIMIT 5")
def _(spark, d):
    return OP.top_failing_catalogs(D.scans(spark, d), 5)


@query("agg_coverage_breadth", sql="SELECT count(DISTINCT catalog_id) AS scanned, count(*) AS scans, any_value(known) AS known, CAST(count(DISTINCT catalog_id) AS DOUBLE) / any_value(known) AS breadth, CAST(count(*) AS DOUBLE) / count(DISTINCT catalog_id) AS repeat_factor, count(DISTINCT catalog_id) * 2 < any_value(known) AS narrow FROM scans, (SELECT count(DISTINCT p_type) AS known FROM part)")
def _(spark, d):
    return OP.coverage_breadth(D.scans(spark, d), D.catalogs(spark, d))


def _cycles(spark, d):
    e = D.read(spark, d, "events")
    return e.selectExpr("event_id AS cycle_id", "concat('lane-', user_id % 4) AS lane_name", "IF(event_type = 'error', 'failed', 'completed') AS status", "ts AS started_at", "timestamp_micros(unix_micros(ts) + (event_id % 50) * 1000000) AS finished_at", "map(event_type, cast(1 AS bigint), 'all', cast(event_id % 3 AS bigint)) AS reason_counts")


@query("agg_cycle_summary", sql="SELECT 'lane-' || (user_id % 4) AS lane_name, count(*) AS cycles, count(*) FILTER (WHERE event_type <> 'error') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed, CAST(count(*) FILTER (WHERE event_type <> 'error') AS DOUBLE) / count(*) AS success_rate, CAST(sum(event_id % 50) AS BIGINT) AS seconds, avg(event_id % 50) AS mean_seconds FROM events GROUP BY 1")
def _(spark, d):
    return OP.summarize_cycles(_cycles(spark, d))


@query("agg_probe_maps", sql="SELECT k, kind, name, n FROM (SELECT listing_id % 3 AS k, 'outcome' AS kind, probe_outcome AS name, count(*) AS n FROM probes GROUP BY ALL UNION ALL SELECT listing_id % 3, 'reason', coalesce(reason, 'none'), count(*) FROM probes GROUP BY ALL)")
def _(spark, d):
    maps = OP.probe_maps(D.probes(spark, d).withColumn("k", F.col("listing_id") % 3), "k")
    part = lambda kind: maps.select("k", F.lit(kind).alias("kind"), F.explode(f"{kind}_counts").alias("name", "n"))
    return part("outcome").unionByName(part("reason"))


@query("agg_failure_phases", sql="SELECT 'phase-' || (user_id % 7) AS phase, count(*) AS failures, max(ts) AS latest_at FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY failures DESC, phase LIMIT 5")
def _(spark, d):
    phased = D.read(spark, d, "events").select(F.col("event_id").alias("cycle_id"), F.concat(F.lit("phase-"), F.col("user_id") % 7).alias("phase"))
    return OP.failure_phases(_cycles(spark, d).join(phased, "cycle_id"), 5)


@query("ops_runtime_status", sql="SELECT part, cycle_id, n FROM ((SELECT 'recent' AS part, event_id AS cycle_id, 1 AS n FROM events ORDER BY ts DESC, event_id DESC LIMIT 8) UNION ALL (SELECT 'failures', event_id, 1 FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 8) UNION ALL (SELECT 'latest', last(event_id ORDER BY ts, event_id), 1 FROM events GROUP BY user_id % 4) UNION ALL (SELECT 'totals', NULL, count(*) FROM events GROUP BY user_id % 4))")
def _(spark, d):
    parts = OP.runtime_status(_cycles(spark, d), "2024-02-01 00:00:00")
    rows = lambda name: parts[name].select(F.lit(name).alias("part"), "cycle_id", F.lit(1).cast("long").alias("n"))
    totals = parts["totals"].select(F.lit("totals").alias("part"), F.lit(None).cast("long").alias("cycle_id"), F.col("cycles").alias("n"))
    return rows("recent").unionByName(rows("failures")).unionByName(rows("latest")).unionByName(totals)


@query("agg_top_reasons", sql="SELECT reason, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type AS reason, 1 AS n FROM events UNION ALL SELECT 'all', event_id % 3 FROM events) GROUP BY 1 ORDER BY n DESC, reason LIMIT 4")
def _(spark, d):
    return OP.top_counts(_cycles(spark, d), "reason_counts", 4)


@query("ops_runtime_report", sql="SELECT 'lane-' || (user_id % 4) AS lane_name, last(event_id ORDER BY ts, event_id) AS cycle_id FROM events GROUP BY 1")
def _(spark, d):
    return OP.runtime_report(_cycles(spark, d), "2024-02-01 00:00:00").select("lane_name", "cycle_id")


#: Cycles from events: status, phase, run and what their state refresh counted follow from the event's number.
_CYCLE = (
    "event_id AS cycle_id", "CASE WHEN event_type <> 'error' THEN 'completed' WHEN event_id % 2 = 0 THEN 'failed' ELSE 'interrupted' END AS status", "concat('phase-', user_id % 7) AS phase", "ts AS started_at", "CASE WHEN event_id % 11 <> 0 THEN ts END AS ended_at", "event_id % 50 AS seconds",
    "CASE event_id % 4 WHEN 0 THEN 'healthy' WHEN 1 THEN 'partial' WHEN 2 THEN 'degraded' END AS refresh", "event_id % 3 AS direct_signal_count", "event_id % 5 AS inconclusive_probe_count", "event_id % 2 AS degraded_probe_count", "event_id % 7 AS anti_bot_challenge_count", "event_id % 6 AS http_error_count", "event_id % 8 AS transport_error_count", "event_type",
)
_CYCLES = f"(SELECT {', '.join(_CYCLE)} FROM events)"
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in OP.REFRESHED)
_RUNS = "(SELECT run_id, min(fetched_at) AS started_at, max(fetched_at) AS finished_at, count(DISTINCT catalog_id) AS scanned_leaf_catalogs, count(*) FILTER (WHERE success) AS successful_scans, count(*) FILTER (WHERE NOT success) AS failed_scans, sum(listing_count) AS unique_listing_hits, 6 AS max_leaf_categories FROM scans GROUP BY run_id)"


def _long_cycles(spark, d):
    c = D.read(spark, d, "events").selectExpr(*_CYCLE)
    refresh = F.struct(F.col("refresh").alias("status"), *OP.REFRESHED, F.create_map(F.col("event_type"), F.lit(1).cast("long")).alias("reason_counts"))
    run = F.when(F.col("cycle_id") % 2 == 0, "2001-03").otherwise("no-such-run")
    return c.select("cycle_id", "status", "phase", "started_at", F.timestamp_seconds(F.unix_seconds("ended_at") + F.col("seconds")).alias("finished_at"), run.alias("discovery_run_id"), refresh.alias("state_refresh_summary"))


def _runs(scans):
    return scans.groupBy("run_id").agg(F.min("fetched_at").alias("started_at"), F.max("fetched_at").alias("finished_at"), F.count_distinct("catalog_id").alias("scanned_leaf_catalogs"), F.count_if("success").alias("successful_scans"), F.count_if(~F.col("success")).alias("failed_scans"), F.sum("listing_count").alias("unique_listing_hits"), F.lit(6).alias("max_leaf_categories"))


@query("ops_acquisition_health", sql=f"""SELECT CASE WHEN failures > 0 OR degraded_probe_count > 0 THEN 'degraded' WHEN inconclusive_probe_count > 0 THEN 'partial' ELSE 'healthy' END AS status, cycle_id AS latest_cycle_id, run_id AS latest_run_id, failures AS recent_scan_failure_count,
  CASE WHEN failures > 0 OR degraded_probe_count > 0 THEN concat_ws(',', CASE WHEN failures > 0 THEN 'failed_scans=' || failures END, CASE WHEN anti_bot_challenge_count > 0 THEN 'anti_bot=' || anti_bot_challenge_count END, CASE WHEN transport_error_count > 0 THEN 'transport_errors=' || transport_error_count END, CASE WHEN http_error_count > 0 THEN 'http_errors=' || http_error_count END)
    WHEN inconclusive_probe_count > 0 THEN 'inconclusive_probes=' || inconclusive_probe_count ELSE 'healthy' END AS reasons, shown
  FROM (SELECT *, CASE WHEN cycle_id % 2 = 0 THEN '2001-03' ELSE (SELECT run_id FROM {_RUNS} ORDER BY started_at DESC, run_id DESC LIMIT 1) END AS run_id FROM {_CYCLES} ORDER BY started_at DESC, cycle_id DESC LIMIT 1),
  LATERAL (SELECT count(*) AS failures, string_agg(catalog_path || '/' || response_status, ',' ORDER BY catalog_path) AS shown FROM (SELECT DISTINCT c.run_id, s.catalog_path, c.response_status FROM scans c JOIN sightings s USING (catalog_id) WHERE NOT c.success) f WHERE f.run_id = run_id)""".replace("f.run_id = run_id", "f.run_id = (CASE WHEN cycle_id % 2 = 0 THEN '2001-03' ELSE (SELECT max(run_id) FROM scans) END)"))
def _(spark, d):
    scans = materialize(D.scans(spark, d), "scans")
    h = OP.acquisition_health(_long_cycles(spark, d), _runs(scans), scans, D.catalogs(spark, d))
    return h.select("status", "latest_cycle_id", "latest_run_id", F.col("recent_scan_failure_count").cast("long").alias("recent_scan_failure_count"), F.array_join("reasons", ",").alias("reasons"), F.array_join(F.transform("recent_scan_failures", lambda x: F.concat_ws("/", x["catalog_path"], x["response_status"].cast("string"))), ",").alias("shown"))


_ARM = "CASE WHEN catalog_id % 2 = 0 THEN 'even' ELSE 'odd' END"
_CARDS = f"SELECT arm, hits, listings, scans, challenged, CAST(hits - listings AS DOUBLE) / hits AS duplicate_ratio, CAST(challenged AS DOUBLE) / scans AS challenge_rate, listings / 2160.0::DOUBLE AS new_per_hour FROM (SELECT {_ARM} AS arm, count(*) AS hits, count(DISTINCT listing_id) AS listings FROM sightings WHERE observed_at BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '1999-04-01' GROUP BY 1) JOIN (SELECT {_ARM} AS arm, count(*) AS scans, count(*) FILTER (WHERE response_status = 403) AS challenged FROM scans WHERE fetched_at BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '1999-04-01' GROUP BY 1) USING (arm)"


def _scorecard(spark, d):
    arm = F.when(F.col("catalog_id") % 2 == 0, "even").otherwise("odd")
    return OP.scorecard(D.sightings(spark, d), D.scans(spark, d), D.probes(spark, d), arm, "1999-01-01", "1999-04-01")


@query("ops_scorecard", sql=_CARDS)
def _(spark, d):
    return _scorecard(spark, d)


@query("ops_leaderboard", sql=f"SELECT arm, row_number() OVER (ORDER BY new_per_hour DESC, duplicate_ratio, challenge_rate, arm) AS rank FROM ({_CARDS})")
def _(spark, d):
    return OP.leaderboard(_scorecard(spark, d)).select("arm", "rank")


@query("ops_paired_mode_report", sql="SELECT catalog_id, count(*) AS pairs, sum(ba - ua)::BIGINT AS delta_sum, avg(ba - ua) AS mean_delta, CAST(sum(ba) AS DOUBLE) / sum(bs) AS bounded_ratio, CAST(sum(ua) AS DOUBLE) / sum(us) AS unbounded_ratio, min(ba - ua) AS min_delta, max(ba - ua) AS max_delta, median(ba - ua) AS median_delta, count(*) FILTER (WHERE ba > ua) AS better, count(*) FILTER (WHERE ba < ua) AS worse FROM (SELECT catalog_id, page_number, count(*) FILTER (WHERE b AND a) AS ba, count(*) FILTER (WHERE NOT b AND a) AS ua, count(*) FILTER (WHERE b) AS bs, count(*) FILTER (WHERE NOT b) AS us FROM (SELECT catalog_id, page_number, user_id % 2 = 0 AS b, coalesce(price_amount_cents >= 150000, false) AS a FROM sightings) GROUP BY 1, 2) WHERE bs > 0 AND us > 0 GROUP BY 1")
def _(spark, d):
    s = D.sightings(spark, d)
    pages = s.groupBy("catalog_id", "page_number", F.when(F.col("user_id") % 2 == 0, "bounded").otherwise("unbounded").alias("mode")).agg(F.count("*").alias("seen"), F.count_if(F.col("price_amount_cents") >= 150_000).alias("accepted"))
    return OP.paired_mode_report(pages)


@query("ops_storage_growth", sql="SELECT lane, last(o_orderkey ORDER BY o_orderdate, o_orderkey) - first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS listing_growth, last(o_custkey * 11 ORDER BY o_orderdate, o_orderkey) - first(o_custkey * 11 ORDER BY o_orderdate, o_orderkey) AS byte_growth FROM (SELECT o_orderpriority AS lane, * FROM orders) GROUP BY 1")
def _(spark, d):
    o = D.read(spark, d, "orders").select(F.col("o_orderpriority").alias("lane"), F.col("o_orderkey").alias("listing_count"), (F.col("o_custkey") * 11).alias("bytes"), F.struct("o_orderdate", "o_orderkey").alias("captured_at"))
    return OP.storage_growth(o, "lane")


_AUDITED = ("cycle_count", "completed_cycles", "failed_cycles", "interrupted_cycles", "success_rate", "average_cycle_seconds", "run_count", "leaf_catalogs_known", "leaf_catalogs_scanned", "coverage_ratio", "repeated_scan_factor", "sum_scanned_leaf_catalogs", "sum_successful_scans", "sum_failed_scans", "sum_unique_listing_hits", "average_hits_per_run", "same_leaves", "few_leaves",
            "healthy_refreshes", "partial_refreshes", "degraded_refreshes", "unknown_refreshes", *OP.REFRESHED, "tracked_listings", "first_pass_only", "stale_followup", "score", "verdict")


@query("ops_long_run_audit", P.OBS, P.CARDS, P.INPUTS, sql=f"""SELECT {", ".join(_AUDITED)}, findings, recommendations, failure_phases, top_reasons FROM (SELECT *, CASE WHEN cycle_count = 0 OR score BETWEEN 3 AND 5 THEN 'caution' WHEN score >= 6 THEN 'degraded' ELSE 'healthy' END AS verdict FROM (SELECT *,
    least(failed_cycles * 2, 4) + least(interrupted_cycles, 2) + least(degraded_refreshes * 2, 4) + least(partial_refreshes, 2) + CASE WHEN sum_failed_scans > 0 THEN 2 ELSE 0 END + CASE WHEN same_leaves OR few_leaves THEN 2 ELSE 0 END + CASE WHEN first_heavy THEN 1 ELSE 0 END + CASE WHEN stale_heavy THEN 1 ELSE 0 END AS score,
    concat_ws(',', CASE WHEN cycle_count = 0 THEN 'no_cycles' WHEN failed_cycles > 0 OR interrupted_cycles > 0 THEN 'failed_cycles=' || failed_cycles || '+' || interrupted_cycles END, CASE WHEN same_leaves THEN 'same_leaves' END, CASE WHEN few_leaves THEN 'few_leaves' END, CASE WHEN sum_failed_scans > 0 THEN 'failed_scans=' || sum_failed_scans END,
      CASE WHEN degraded_refreshes > 0 THEN 'degraded_refreshes=' || degraded_refreshes WHEN partial_refreshes > 0 THEN 'partial_refreshes=' || partial_refreshes END, CASE WHEN first_heavy THEN 'first_pass_heavy=' || first_pass_only END, CASE WHEN stale_heavy THEN 'stale_backlog=' || stale_followup END) AS findings,
    concat_ws(',', CASE WHEN cycle_count = 0 THEN 'check_window' END, CASE WHEN failed_cycles > 0 THEN 'inspect_failures' END, CASE WHEN same_leaves OR few_leaves THEN 'widen_coverage' END, CASE WHEN sum_failed_scans > 0 THEN 'review_failing_catalogs' END,
      CASE WHEN anti_bot_challenge_count > 0 THEN 'relieve_anti_bot' WHEN degraded_probe_count > 0 THEN 'sample_degraded' WHEN inconclusive_probe_count > 0 THEN 'inspect_inconclusive' END, CASE WHEN first_heavy THEN 'revisit_more' END, CASE WHEN stale_heavy THEN 'work_off_backlog' END) AS recommendations
  FROM (SELECT *, round(completed_cycles / (completed_cycles + failed_cycles + interrupted_cycles)::DOUBLE, 3) AS success_rate, round(leaf_catalogs_scanned / leaf_catalogs_known::DOUBLE, 3) AS coverage_ratio, round(sum_scanned_leaf_catalogs / leaf_catalogs_scanned::DOUBLE, 3) AS repeated_scan_factor, round(sum_unique_listing_hits / run_count::DOUBLE, 2) AS average_hits_per_run,
      run_count >= 2 AND leaf_catalogs_scanned <= 6 AND sum_scanned_leaf_catalogs > leaf_catalogs_scanned AS same_leaves, leaf_catalogs_scanned / leaf_catalogs_known::DOUBLE <= 0.25 AND sum_scanned_leaf_catalogs / leaf_catalogs_scanned::DOUBLE >= 1.5 AS few_leaves, first_pass_only / tracked_listings::DOUBLE >= 0.7 AS first_heavy, stale_followup / tracked_listings::DOUBLE >= 0.2 AS stale_heavy
    FROM (SELECT count(*) AS cycle_count, count(*) FILTER (WHERE status = 'completed') AS completed_cycles, count(*) FILTER (WHERE status = 'failed') AS failed_cycles, count(*) FILTER (WHERE status = 'interrupted') AS interrupted_cycles, round(avg(seconds) FILTER (WHERE ended_at IS NOT NULL), 2) AS average_cycle_seconds,
        count(*) FILTER (WHERE refresh = 'healthy') AS healthy_refreshes, count(*) FILTER (WHERE refresh = 'partial') AS partial_refreshes, count(*) FILTER (WHERE refresh = 'degraded') AS degraded_refreshes, count(*) FILTER (WHERE refresh IS NULL) AS unknown_refreshes, {_SUMS} FROM {_CYCLES} WHERE started_at >= TIMESTAMP '1999-05-01'),
      (SELECT count(*) AS run_count, sum(scanned_leaf_catalogs)::BIGINT AS sum_scanned_leaf_catalogs, sum(successful_scans)::BIGINT AS sum_successful_scans, sum(failed_scans)::BIGINT AS sum_failed_scans, sum(unique_listing_hits)::BIGINT AS sum_unique_listing_hits FROM {_RUNS} WHERE finished_at >= TIMESTAMP '1999-05-01'),
      (SELECT count(DISTINCT catalog_id) AS leaf_catalogs_scanned FROM scans JOIN {_RUNS} USING (run_id) WHERE started_at >= TIMESTAMP '1999-05-01'), (SELECT count(DISTINCT p_type) AS leaf_catalogs_known FROM part),
      (SELECT count(*) AS tracked_listings, count(*) FILTER (WHERE freshness_bucket = 'first-pass-only') AS first_pass_only, count(*) FILTER (WHERE freshness_bucket = 'stale-followup') AS stale_followup FROM history)))),
  (SELECT string_agg(label || '=' || n, ',' ORDER BY n DESC, label) AS failure_phases FROM (SELECT status || ':' || phase AS label, count(*) AS n FROM {_CYCLES} WHERE status <> 'completed' GROUP BY 1 ORDER BY n DESC, label LIMIT 5)),
  (SELECT string_agg(reason || '=' || n, ',' ORDER BY n DESC, reason) AS top_reasons FROM (SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, reason LIMIT 5))""")
def _(spark, d):
    s = D.sightings(spark, d)
    scans = materialize(D.scans(spark, d, s), "scans")
    audit = OP.long_run_audit(_long_cycles(spark, d), _runs(scans), scans, D.catalogs(spark, d), O.history_summaries(O.fold_observations(s), O.latest_cards(s), D.NOW), "1999-05-01")
    counts = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["name"], x["n"].cast("string"))), ",").alias(c)
    return audit.select(*_AUDITED, *[F.array_join(c, ",").alias(c) for c in ("findings", "recommendations")], counts("failure_phases"), counts("top_reasons"))


@query("dq_reconcile", sql="SELECT 'sightings' AS dataset, count(*) AS row_count, count(*) FILTER (WHERE run_id <> '1999-05') AS actual_row_count, 'mismatch' AS status FROM sightings UNION ALL SELECT 'scans', count(*), count(*), 'match' FROM scans")
def _(spark, d):
    s, c = D.sightings(spark, d), D.scans(spark, d)
    both = lambda s: Q.table_window(s, "observed_at", "sightings").unionByName(Q.table_window(c, "fetched_at", "scans"))
    return Q.reconcile(both(s), both(s.where("run_id <> '1999-05'"))).select("dataset", "row_count", "actual_row_count", "status")


@query("dq_parity", sql="""SELECT sha256('{"event_id":"' || event_id || '","listing_id":' || listing_id || ',"price_amount_cents":' || coalesce(CAST(price_amount_cents AS VARCHAR), 'null') || '}') AS row_hash, CAST(sum(n) AS BIGINT) AS surplus FROM (SELECT *, CASE WHEN run_id = '1999-05' THEN 1 ELSE -1 END AS n FROM sightings WHERE run_id IN ('1999-05', '1999-06')) GROUP BY 1""")
def _(spark, d):
    s = D.sightings(spark, d).select("event_id", "listing_id", "price_amount_cents", "run_id")
    return Q.parity(s.where("run_id <> '1999-06'"), s.where("run_id <> '1999-05'"), ("run_id",))


@query("dq_constraints", sql="SELECT 'price_positive' AS check_name, count(*) FILTER (WHERE NOT coalesce(price_amount_cents > 0, false)) AS violations FROM sightings UNION ALL SELECT 'brand_known', count(*) FILTER (WHERE brand IS NULL) FROM sightings")
def _(spark, d):
    return Q.check_constraints(D.sightings(spark, d), {"price_positive": F.col("price_amount_cents") > 0, "brand_known": F.col("brand").isNotNull()})


@query("dq_orphans_and_duplicates", sql="SELECT listing_id, copies FROM (SELECT listing_id, run_id, count(*) AS copies FROM sightings GROUP BY 1, 2) WHERE copies > 1")
def _(spark, d):
    return Q.duplicate_keys(D.sightings(spark, d), ["listing_id", "run_id"]).select("listing_id", "copies")


def _stream(spark, d):
    """The sightings as a stream over a table that Spark derives from the inputs first."""
    path = folder(spark, "sightings")
    D.sightings(spark, d).select("event_id", "listing_id", "run_id", "observed_at", "catalog_id", "price_amount_cents").write.parquet(path)
    return ST.stream_lake(spark, path, 4)


@query("str_rollup_daily", sql="SELECT CAST(day AS TIMESTAMP) AS bucket, catalog_id, count(*) AS events, sum(price_amount_cents)::BIGINT AS price_sum, count(price_amount_cents) AS price_count, count(DISTINCT listing_id) AS listings FROM sightings GROUP BY 1, 2")
def _(spark, d):
    return ST.rollup_available(_stream(spark, d), "1 day", ("catalog_id",))


@query("str_latest_listing", sql="SELECT listing_id, last(event_id ORDER BY observed_at, event_id) AS event_id FROM sightings GROUP BY 1")
def _(spark, d):
    return ST.latest_available(_stream(spark, d), ["listing_id"], ["observed_at", "event_id"]).select("listing_id", "event_id")


@query("str_presence", P.OBS, sql="SELECT listing_id, observation_count, total_sightings, first_seen_at, last_seen_at, last_observed_run_id AS last_run_id, 0 AS late_rows FROM summary")
def _(spark, d):
    # one batch: rows of a listing come in order, so nothing is late and the stream equals the batch fold
    path = folder(spark, "presence-in")
    D.sightings(spark, d).select("event_id", "listing_id", "run_id", "observed_at").write.parquet(path)
    return ST.presence_available(ST.stream_lake(spark, path)).drop("gap_micros")


@query("str_changes", P.LOG, sql='''SELECT listing_id, "at", source_id, change_kind, state_code, basis_kind, misses, now_price AS price, b_price AS price_before, b_state AS state_before, run_id FROM (SELECT *, CASE WHEN last_probe IN ('deleted', 'sold', 'active', 'unavailable') OR misses = 0 THEN 'observed' ELSE 'inferred' END AS basis_kind FROM changes)''')
def _(spark, d):
    """Events arrive two years at a time, some a chunk late; a last event of another listing moves the watermark past them all."""
    root, s = folder(spark, "changes"), D.sightings(spark, d)
    events = CH.streamed_log(s, materialize(D.scans(spark, d, s), "scans"), D.probes(spark, d))
    end = {"listing_id": F.lit(-1), "at": F.lit("2010-01-01"), "event_kind": F.lit("end"), "source_id": F.lit("end")}
    end = spark.range(1).select(*[end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    stream = D.arrivals(events.unionByName(end), F.when(F.col("event_kind") == "end", 4).otherwise(F.floor(D.year_chunk("at", "source_id") / 2)), f"{root}/in", 5)
    ch = CG.changes_available(stream, root, "740 days")
    return ch.select("listing_id", "at", "source_id", "change_kind", "state_code", "basis_kind", F.col("misses").cast("long").alias("misses"), F.col("now_price_amount_cents").alias("price"), F.col("before.now_price_amount_cents").alias("price_before"), F.col("before.state_code").alias("state_before"), "run_id")


@query("agg_hll_sketches")
def _(spark, d):
    sk = R.distinct_sketches(D.sightings(spark, d), F.to_date("observed_at").alias("day"), "catalog_id")
    return sk.groupBy("catalog_id").agg(F.hll_sketch_estimate(F.hll_union_agg("listings_sketch")).alias("listings_about"))


@query("map_seen_facts", sql="""SELECT event_id, day AS occurred_on, '{"manifest_id":"' || manifest_id || '","run_id":"' || run_id || '","source_event_id":"' || event_id || '"}' AS metadata_json, manifest_id AS traced FROM sightings""")
def _(spark, d):
    return M.with_trace(M.to_seen_facts(D.sightings(spark, d))).select("event_id", "occurred_on", "metadata_json", F.col("trace.manifest_id").alias("traced"))


@query("map_probe_facts", sql="SELECT probe_id, listing_id, CAST(probed_at AS DATE) AS occurred_on FROM probes")
def _(spark, d):
    return M.to_probe_facts(D.probes(spark, d)).select("probe_id", "listing_id", "occurred_on")


@query("prj_display", *STATE, P.SCORES, sql="""SELECT listing_id, CASE WHEN premium_score >= 80 THEN 'very_strong' WHEN premium_score >= 60 THEN 'solid' WHEN premium_score >= 40 THEN 'medium' ELSE 'modest' END AS score_band, CASE WHEN price_percentile IS NULL THEN 'none' WHEN price_percentile >= 0.85 THEN 'high' WHEN price_percentile >= 0.65 THEN 'above_middle' WHEN price_percentile >= 0.35 THEN 'middle' ELSE 'low' END AS percentile_band,
  CASE WHEN state_code IN ('deleted', 'unknown') THEN CASE WHEN confidence_label = 'low' THEN 'danger' ELSE 'warning' END WHEN basis_kind = 'inferred' OR confidence_label = 'low' THEN 'warning' WHEN state_code IN ('active', 'sold_observed') THEN 'success' ELSE 'info' END AS tone,
  coalesce((price_amount_cents // 100) || '.' || lpad(CAST(price_amount_cents % 100 AS VARCHAR), 2, '0') || ' €', 'price n/a') AS price_text, coalesce(CAST(view_count AS VARCHAR), 'n/a') AS views_text, strftime(to_timestamp(created_at_ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS published_text FROM scores""")
def _(spark, d):
    return M.with_display(scores(spark, d)).select("listing_id", "score_band", "percentile_band", "tone", "price_text", "views_text", "published_text")


_MARTS = ("listing_day", "segment_day", "price_change", "state_transition", "evidence_packs")


_DAY_ROWS = "SELECT DISTINCT listing_id, day, brand, condition_label, CASE WHEN price_amount_cents IS NULL THEN 'unknown' WHEN price_amount_cents < 2000 THEN 'under' WHEN price_amount_cents < 4000 THEN 'middle' ELSE 'over' END AS band FROM sightings"


@query("mart_export", P.LOG, sql=f"SELECT 'listing_day' AS mart, (SELECT count(*) FROM ({_DAY_ROWS})) AS row_count UNION ALL SELECT 'segment_day', (SELECT count(*) FROM (SELECT DISTINCT day, catalog_id FROM sightings)) + (SELECT count(*) FROM (SELECT DISTINCT day, brand FROM sightings)) UNION ALL SELECT 'price_change', count(*) FROM changes WHERE change_kind = 'price_change' UNION ALL SELECT 'state_transition', count(*) FROM changes WHERE change_kind = 'state_transition' UNION ALL SELECT 'evidence_packs', count(DISTINCT listing_id) FROM sightings")
def _(spark, d):
    """All five marts; the packs are made of the others as written."""
    s = D.sightings(spark, d)
    scans = materialize(D.scans(spark, d, s), "scans")
    price, state = CH.mart_price_change(CH.derive_changes(CH.seen_log(s, scans))), transitions(s, scans, D.probes(spark, d))
    packs = lambda m: CH.evidence_packs(pack_base(spark, d, scans), m["listing_day"], m["price_change"], m["state_transition"])
    marts = dict(zip(_MARTS, (R.mart_listing_day(CH.by_listing(s, scans)), R.mart_segment_day(s), price, state, packs), strict=True))
    return M.export_marts(marts, folder(spark, "marts"))


_PACK = """SELECT listing_id, days, price_changes, state_transitions, manifests FROM {ids} LEFT JOIN (SELECT listing_id, string_agg(strftime(day, '%Y-%m-%d') || ':' || events, ';' ORDER BY day DESC, events DESC) AS days, string_agg(DISTINCT m, ';' ORDER BY m) AS manifests FROM (SELECT listing_id, day, count(*) AS events, any_value(manifest_id) AS m FROM (SELECT *, {band} FROM sightings) GROUP BY listing_id, day, catalog_id, root_title, catalog_path, brand, condition_label, price_band_code) GROUP BY 1) USING (listing_id)
  LEFT JOIN (SELECT listing_id, string_agg(strftime("at", '%Y-%m-%d') || ':' || coalesce(b_price::VARCHAR, '-') || '>' || coalesce(now_price::VARCHAR, '-'), ';' ORDER BY "at" DESC, source_id DESC) AS price_changes FROM changes WHERE change_kind = 'price_change' GROUP BY 1) USING (listing_id)
  LEFT JOIN (SELECT listing_id, string_agg(strftime("at", '%Y-%m-%d') || ':' || coalesce(b_state, 'none') || ' → ' || state_code, ';' ORDER BY "at" DESC, source_id DESC) AS state_transitions FROM changes WHERE change_kind = 'state_transition' GROUP BY 1) USING (listing_id)"""


def _pack_texts(packs):
    """Packs with their nested rows and trace as texts, so that every value is compared."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    joined = lambda c, f: F.array_join(F.transform(c, f), ";").alias(c)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return packs.select(
        "listing_id", joined("days", lambda x: F.concat(day(x["day"]), F.lit(":"), x["events"])), joined("price_changes", lambda x: F.concat(day(x["at"]), F.lit(":"), text(x["price_before"]), F.lit(">"), text(x["price_after"]))),
        joined("state_transitions", lambda x: F.concat(day(x["at"]), F.lit(":"), x["transition"])), F.nullif(F.array_join("trace_manifest_ids", ";"), F.lit("")).alias("manifests"),
    )


@query("mart_evidence_pack_ids", P.LOG, sql=_PACK.format(ids="(SELECT max(listing_id) AS listing_id FROM sightings GROUP BY catalog_id UNION SELECT -1)", band=_BAND))
def _(spark, d):
    """Packs of named listings, one of which is unknown: their rows are taken before anything is derived, scans are those of all."""
    s, probes = D.sightings(spark, d), D.probes(spark, d)
    scans = materialize(D.scans(spark, d, s), "scans")
    ids = [*[r.id for r in s.groupBy("catalog_id").agg(F.max("listing_id").alias("id")).collect()], -1]  # a row per catalog
    own, probes = materialize(s.where(F.col("listing_id").isin(ids)), "own"), probes.where(F.col("listing_id").isin(ids))
    snap = S.classified_snapshot(O.state_inputs(own, scans, probes, D.NOW, keep=materialize), D.NOW, D.BANDS)
    price, state = CH.mart_price_change(CH.derive_changes(CH.seen_log(own))), CH.mart_state_transition(CH.changes_of(own, scans, probes))
    return _pack_texts(CH.evidence_packs(snap, R.mart_listing_day(own), price, state, ids))


@query("mart_evidence_pack_rows", P.LOG, sql=_PACK.format(ids="(SELECT DISTINCT listing_id FROM sightings)", band=_BAND))
def _(spark, d):
    return _pack_texts(packs_of_all(spark, d))


@query("mart_first_rows", P.LOG, sql="""SELECT * FROM (SELECT 'price_change' AS mart, listing_id, strftime("at", '%Y-%m-%d') AS day, source_id AS name FROM changes WHERE change_kind = 'price_change' ORDER BY "at" DESC, listing_id DESC, source_id DESC LIMIT 20) UNION ALL SELECT * FROM (SELECT 'segment_day', events, strftime(day, '%Y-%m-%d'), segment FROM (SELECT day, CAST(catalog_id AS VARCHAR) AS segment, count(*) AS events FROM sightings GROUP BY ALL UNION ALL SELECT day, brand, count(*) FROM sightings GROUP BY ALL) ORDER BY day DESC, events DESC, segment DESC NULLS LAST LIMIT 20)""")
def _(spark, d):
    """The newest twenty rows of two marts."""
    price = M.first_rows(price_changes(spark, d), "price_change", 20)
    segment = M.first_rows(R.mart_segment_day(D.sightings(spark, d)), "segment_day", 20)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day")
    return price.select(F.lit("price_change").alias("mart"), "listing_id", day("at"), F.col("source_id").alias("name")).unionByName(segment.select(F.lit("segment_day").alias("mart"), F.col("events").alias("listing_id"), day("day"), F.col("segment").alias("name")))


@query("src_identity_snapshots", P.OBS, P.CARDS, sql="SELECT listing_id, first_seen_at, last_seen_at, first_run_id, last_observed_run_id AS last_run_id, title, brand, catalog_id, root_title, user_id FROM summary JOIN cards USING (listing_id)")
def _(spark, d):
    s = D.sightings(spark, d)
    return O.identity_snapshots(O.fold_observations(s), O.latest_cards(s)).select("listing_id", "first_seen_at", "last_seen_at", "first_run_id", "last_run_id", "title", "brand", "catalog_id", "root_title", "user_id")


@query("src_state_snapshots", *STATE, sql="SELECT listing_id, state_code, follow_up_miss_count, latest_miss_at, latest_primary_scan_run_id, probe_outcome, probed_at, price_amount_cents, first_run_id, last_observed_run_id AS last_run_id FROM snapshot")
def _(spark, d):
    s = D.sightings(spark, d)
    return O.state_snapshots(O.fold_observations(s), snapshot(spark, d)).select("listing_id", "state_code", "follow_up_miss_count", "latest_miss_at", "latest_primary_scan_run_id", "probe_outcome", "probed_at", "price_amount_cents", "first_run_id", "last_run_id")


@query("src_export_cycles", sql="""SELECT event_id AS cycle_id, 'lane-' || (user_id % 4) AS lane_name, '{"' || event_type || '":1,"all":' || (event_id % 3) || '}' AS reason_counts FROM events""")
def _(spark, d):
    return L.export_cycles(_cycles(spark, d)).select("cycle_id", "lane_name", "reason_counts")


@query("mrg_latest_catalogs", sql="SELECT CAST(1000 + n_regionkey AS BIGINT) AS catalog_id, last(n_name ORDER BY n_nationkey, n_name) AS title FROM nation GROUP BY 1")
def _(spark, d):
    c = D.read(spark, d, "nation").select((F.col("n_regionkey") + 1000).cast("long").alias("catalog_id"), F.col("n_name").alias("title"), F.col("n_nationkey").alias("synced_at"))
    return O.latest_catalogs(c).select("catalog_id", "title")


@query("ops_lane_rollup", sql="SELECT count(*) AS lanes, arg_min(lane_name, k) AS lane_name, arg_min(status, k) AS status FROM (SELECT lane_name, status, (CASE status WHEN 'failed' THEN 1 ELSE 2 END, next_at, lane_name) AS k FROM (SELECT 'lane-' || (user_id % 6) AS lane_name, CASE WHEN last(event_type ORDER BY ts, event_id) = 'error' THEN 'failed' ELSE 'scheduled' END AS status, max(ts) AS next_at FROM events GROUP BY 1))")
def _(spark, d):
    lanes = D.read(spark, d, "events").groupBy(F.concat(F.lit("lane-"), F.col("user_id") % 6).alias("lane_name")).agg(F.when(F.max_by("event_type", F.struct("ts", "event_id")) == "error", "failed").otherwise("scheduled").alias("status"), F.max("ts").alias("next_at"))
    return OP.lane_rollup(lanes)


@query("ops_mode_statuses", sql="SELECT catalog_id, mode, status, count(*) AS n FROM (SELECT catalog_id, CASE WHEN user_id % 2 = 0 THEN 'bounded' ELSE 'unbounded' END AS mode, CASE page_number % 3 WHEN 0 THEN 200 WHEN 1 THEN 403 ELSE 0 END AS status FROM sightings) GROUP BY ALL")
def _(spark, d):
    pages = D.sightings(spark, d).select("catalog_id", F.when(F.col("user_id") % 2 == 0, "bounded").otherwise("unbounded").alias("mode"), F.when(F.col("page_number") % 3 == 0, 200).when(F.col("page_number") % 3 == 1, 403).alias("response_status"))
    return OP.mode_statuses(pages, "catalog_id").select("catalog_id", "mode", F.explode("status_counts").alias("status", "n"))


@query("prj_scan_and_probe_flags", sql=f"SELECT 'scan' AS source, count(*) FILTER (WHERE response_status = 403) AS flagged FROM scans UNION ALL SELECT 'probe', count(*) FILTER (WHERE {DEGRADED}) FROM probes")
def _(spark, d):
    scan = D.scans(spark, d).agg(F.lit("scan").alias("source"), F.count_if(X.scan_is_challenge("response_status", "error_message")).alias("flagged"))
    return scan.unionByName(D.probes(spark, d).agg(F.lit("probe").alias("source"), F.count_if(X.probe_is_degraded("reason", "error_message", "response_status")).alias("flagged")))


@query("jn_as_of_probe", sql="SELECT event_id, last_probe FROM (SELECT event_id, k, last_value(probe_outcome IGNORE NULLS) OVER (PARTITION BY listing_id ORDER BY t, k, id ROWS UNBOUNDED PRECEDING) AS last_probe FROM (SELECT listing_id, observed_at AS t, 0 AS k, event_id AS id, event_id, NULL AS probe_outcome FROM sightings UNION ALL SELECT listing_id, probed_at, 1, CAST(probe_id AS VARCHAR), NULL, probe_outcome FROM probes)) WHERE k = 0")
def _(spark, d):
    # latest probe strictly before each sighting: union and a running last value, no range join
    s = D.sightings(spark, d).select("listing_id", F.col("observed_at").alias("t"), F.lit(0).alias("k"), F.col("event_id").alias("id"), "event_id", F.lit(None).cast("string").alias("probe_outcome"))
    p = D.probes(spark, d).select("listing_id", F.col("probed_at").alias("t"), F.lit(1).alias("k"), F.col("probe_id").cast("string").alias("id"), F.lit(None).cast("string").alias("event_id"), "probe_outcome")
    return O.as_of(s.unionByName(p), ["listing_id"], ["t", "k", "id"], "probe_outcome", "last_probe").where("k = 0").select("event_id", "last_probe")


@query("jn_semi_join", sql="SELECT probe_id FROM probes WHERE listing_id IN (SELECT listing_id FROM sightings)")
def _(spark, d):
    return D.probes(spark, d).join(D.sightings(spark, d).select("listing_id"), "listing_id", "left_semi").select("probe_id")


@query("str_facts", sql="SELECT event_id, observed_at FROM sightings")
def _(spark, d):
    """A year's events arrive at a time, and each is sent again with the next year's; the state of older ones has gone by then."""
    root, s = folder(spark, "facts"), D.sightings(spark, d).select("event_id", "observed_at")
    sent = s.withColumn("_n", F.explode(F.array(F.lit(0), F.lit(1))))
    year = F.year("observed_at") - D.FIRST_YEAR
    stream = D.arrivals(sent, F.least(year + F.col("_n"), F.lit(D.YEARS - 1)), f"{root}/in", D.YEARS)
    return ST.take_in(ST.stream_facts(stream, delay="740 days"), root).select("event_id", "observed_at")


_KNOWN = ("view", "click", "purchase", "signup")
_DAYS = "day(ts) // 8"


@query("str_progress", sql=f"SELECT {_DAYS} AS batch_id, count(*) AS input_rows, count(*) FILTER (WHERE event_type <> 'error') AS known, count(*) FILTER (WHERE event_type = 'error') AS skipped, last(event_id ORDER BY ts, event_id) AS last_event_id, max(ts) AS newest_event FROM events GROUP BY 1")
def _(spark, d):
    """What the listener wrote of each batch: eight days of events arrive at a time."""
    return _progress(spark, d).where("input_rows > 0").select("batch_id", "input_rows", "known", "skipped", "last_event_id", "newest_event")


def _progress(spark, d):
    root, e = folder(spark, "progress"), D.read(spark, d, "events").select("event_id", "ts", "event_type")
    stream = D.arrivals(e, F.floor(F.dayofmonth("ts") / 8), f"{root}/in", 4)
    with ST.ProgressLog(spark) as heard:
        ST.run_available(ST.known_events(stream, _KNOWN), lambda b, k: b.write.mode("overwrite").parquet(f"{root}/out/batch={k}"), "append", "events", f"{root}/checkpoint", "events")
    heard.save(f"{root}/progress")
    return spark.read.parquet(f"{root}/progress")


@query("str_health", sql="SELECT 'events' AS consumer, 'lagging' AS status, count(*) AS rows, count(*) FILTER (WHERE event_type <> 'error') AS known, count(*) FILTER (WHERE event_type = 'error') AS skipped, last(event_id ORDER BY ts, event_id) AS last_event_id, CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ts))) AS BIGINT) AS lag_seconds FROM events UNION ALL SELECT 'later', 'idle', count(*), count(*) FILTER (WHERE event_type <> 'error'), count(*) FILTER (WHERE event_type = 'error'), last(event_id ORDER BY ts, event_id), CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ts))) AS BIGINT) - 86400 FROM events")
def _(spark, d):
    """Two consumers from one progress table, one of events that are a day newer, and a lag limit between them."""
    rows = _progress(spark, d)
    later = rows.withColumns({"consumer": F.lit("later"), "newest_event": F.col("newest_event") + F.expr("INTERVAL 1 DAY")})
    return ST.stream_health(rows.unionByName(later), "2024-02-01 00:00:00", 80_000).select("consumer", "status", "rows", "known", "skipped", "last_event_id", "lag_seconds")


@query("str_current_state", *STATE, sql="SELECT listing_id, state_code, basis_kind, confidence_score, follow_up_miss_count, latest_miss_at, observation_count, total_sightings, first_seen_at, last_seen_at, mean_revisit_hours, freshness_bucket, price_band_code, title, price_amount_cents, probe_outcome, seen_in_latest_primary_scan FROM snapshot")
def _(spark, d):
    """The stream's state after seven years of arrivals, some late, and a restart; the SQL is the batch snapshot's."""
    root, s = folder(spark, "state"), D.sightings(spark, d)
    events = LS.state_events(s, D.scans(spark, d, s), D.probes(spark, d))
    for stream in D.arrivals_in_turns(events, D.year_chunk("at", "payload"), f"{root}/in", (4, D.YEARS - 4)):
        LS.stream_state(stream, root, "740 days", 780)
    delete(spark, f"{root}/in")
    card = ", ".join(f"{c} {s.schema[c].dataType.simpleString()}" for c in LS.CARD_FIELDS)
    return LS.current_state(spark, root, D.NOW, D.BANDS, card).select("listing_id", "state_code", "basis_kind", "confidence_score", "follow_up_miss_count", "latest_miss_at", "observation_count", "total_sightings", "first_seen_at", "last_seen_at", "mean_revisit_hours", "freshness_bucket", "price_band_code", "title", "price_amount_cents", "probe_outcome", "seen_in_latest_primary_scan")


@query("str_probe_as_of", sql="SELECT p.probe_id, p.listing_id, max(s.observed_at) AS observed_at, last(s.event_id ORDER BY s.observed_at, s.event_id) FILTER (WHERE s.event_id IS NOT NULL) AS event_id FROM probes p LEFT JOIN sightings s ON s.listing_id = p.listing_id AND s.observed_at <= p.probed_at AND s.observed_at >= p.probed_at - INTERVAL 90 DAYS GROUP BY 1, 2")
def _(spark, d):
    """Both sides arrive a year at a time; one last row on each moves the watermarks, so that unmatched probes come out too."""
    root = folder(spark, "as-of")
    s = D.sightings(spark, d).select("listing_id", "observed_at", "event_id")
    p = D.probes(spark, d).select("listing_id", "probed_at", "probe_id")
    streams = []
    for name, df, at, key in (("s", s, "observed_at", "event_id"), ("p", p, "probed_at", "probe_id")):
        end = spark.range(1).select(F.lit(-1).cast("long").alias("listing_id"), F.lit("2010-01-01").cast("timestamp").alias(at), F.lit(None).cast(df.schema[key].dataType).alias(key))
        streams.append(D.arrivals(df.unionByName(end), F.when(F.col("listing_id") < 0, D.YEARS).otherwise(D.year_chunk(at, key)), f"{root}/in/{name}", D.YEARS + 1))
    return ST.probe_as_of_available(*streams, root, "90 days", "740 days").where("listing_id >= 0").select("probe_id", "listing_id", "observed_at", "event_id")


_ENDS = "SELECT run_id, catalog_id, page_number, chunk_index, page_number = max(page_number) OVER (PARTITION BY run_id, catalog_id) AND chunk_index = chunk_count - 1 AS is_terminal FROM (SELECT DISTINCT run_id, catalog_id, page_number, (row_number() OVER w - 1) // 10 AS chunk_index, (count(*) OVER (PARTITION BY run_id, catalog_id, page_number) + 9) // 10 AS chunk_count FROM sightings WINDOW w AS (PARTITION BY run_id, catalog_id, page_number ORDER BY observed_at, event_id))"


@query("str_scan_ends", sql=_ENDS)
def _(spark, d):
    """Chunks of ten sightings a page; the last chunk of a scan's last page ends the scan."""
    s = L.assign_chunks(D.sightings(spark, d).select("event_id", "run_id", "catalog_id", "page_number", "observed_at"), ["run_id", "catalog_id", "page_number"], [F.col("observed_at"), F.col("event_id")], 10)
    pages = s.groupBy("run_id", "catalog_id").agg(F.max("page_number").alias("total_pages"))
    chunks = s.select("run_id", "catalog_id", "page_number", "chunk_index", "chunk_count").distinct().join(pages, ["run_id", "catalog_id"])
    return ST.is_terminal(chunks.withColumn("next_page", F.when(F.col("page_number") < F.col("total_pages"), F.col("page_number") + 1))).select("run_id", "catalog_id", "page_number", "chunk_index", "is_terminal")


@query("str_late_rows", sql="SELECT event_id, coalesce(epoch(observed_at) < epoch(max(observed_at) OVER (PARTITION BY listing_id ORDER BY card_position, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) - 2000 * 3600, false) AS is_late FROM sightings")
def _(spark, d):
    return ST.within_late_limit(D.sightings(spark, d), "observed_at", ["card_position", "event_id"], 2000).select("event_id", "is_late")


_EXPERIMENT = "SELECT CASE WHEN catalog_id % 2 = 0 THEN 'even' ELSE 'odd' END AS arm"


@query("ops_experiment_scorecard", sql=f"""SELECT arm, 'storage' AS net_new_source, net_new, round(net_new / hours, 4) AS new_per_hour, raw AS raw_listing_hits, greatest(raw - net_new, 0) AS duplicate_hits, round(greatest(raw - net_new, 0) / raw::DOUBLE, 4) AS duplicate_ratio, blocked + anti_bot AS challenge_count,
  round((blocked + anti_bot) / (scans + probed)::DOUBLE, 4) AS challenge_rate, degraded AS degraded_count, round(degraded / (scans + probed)::DOUBLE, 4) AS degraded_rate, CASE WHEN net_new > 0 THEN round(growth / net_new::DOUBLE, 4) END AS bytes_per_new_listing, mean_cpu, peak_cpu, peak_rss_mb
  FROM ({_EXPERIMENT}, sum(listing_count)::BIGINT AS raw, count(*) AS scans, count(*) FILTER (WHERE response_status = 403) AS blocked, (epoch(max(fetched_at)) - epoch(min(fetched_at))) / 3600 AS hours FROM scans GROUP BY 1)
  JOIN (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS arm, count(*) AS probed, count(*) FILTER (WHERE event_type = 'error' AND event_id % 2 = 0) AS anti_bot, count(*) FILTER (WHERE event_type = 'error') + count(*) FILTER (WHERE event_id % 50 = 0) AS degraded, round(avg(event_id % 97), 4) AS mean_cpu, CAST(max(event_id % 97) AS DOUBLE) AS peak_cpu, CAST(max(user_id) AS DOUBLE) AS peak_rss_mb FROM events GROUP BY 1) USING (arm)
  JOIN (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS arm, greatest(last(o_custkey ORDER BY o_orderdate, o_orderkey) - first(o_custkey ORDER BY o_orderdate, o_orderkey), 0) AS net_new, last(o_custkey * 7 ORDER BY o_orderdate, o_orderkey) - first(o_custkey * 7 ORDER BY o_orderdate, o_orderkey) AS growth FROM orders GROUP BY 1) USING (arm)""")
def _(spark, d):
    odd = lambda c: F.when(F.col(c) % 2 == 0, "even").otherwise("odd").alias("arm")
    sc, e, o = materialize(D.scans(spark, d), "scans"), D.read(spark, d, "events"), D.read(spark, d, "orders")
    runs = sc.select(odd("catalog_id"), F.col("listing_count").alias("raw_listing_hits"), F.lit(0).cast("long").alias("unique_listing_hits"))
    failed = F.col("event_type") == "error"
    cycles = e.select(odd("user_id"), F.lit(1).alias("probed"), (failed & (F.col("event_id") % 2 == 0)).cast("int").alias("anti_bot"), failed.cast("int").alias("degraded_probes"), (F.col("event_id") % 50 == 0).alias("is_degraded"))
    storage = o.select(odd("o_orderkey"), F.struct("o_orderdate", "o_orderkey").alias("captured_at"), F.col("o_custkey").alias("listing_count"), (F.col("o_custkey") * 7).alias("bytes"))
    resources = e.select(odd("user_id"), (F.col("event_id") % 97).cast("double").alias("cpu_percent"), F.col("user_id").cast("double").alias("rss_mb"))
    hours = sc.groupBy(odd("catalog_id")).agg(((F.unix_seconds(F.max("fetched_at")) - F.unix_seconds(F.min("fetched_at"))) / 3600).alias("hours"))
    return OP.experiment_scorecard(runs, sc.select(odd("catalog_id"), "response_status", "error_message"), cycles, storage, resources, hours)


@query("srt_issue_examples", P.CARDS, sql=f"SELECT listing_id, n AS degraded_probe_count, title, brand FROM (SELECT listing_id, count(*) AS n FROM probes WHERE {DEGRADED} GROUP BY 1 ORDER BY n DESC, listing_id LIMIT 25) LEFT JOIN cards USING (listing_id)")
def _(spark, d):
    return OP.issue_examples(D.probes(spark, d), O.latest_cards(D.sightings(spark, d)), 25).select("listing_id", "degraded_probe_count", "title", "brand")


@query("dq_orphans", sql="SELECT probe_id FROM probes WHERE listing_id IS NOT NULL AND listing_id NOT IN (SELECT listing_id FROM sightings)")
def _(spark, d):
    return Q.orphans(D.probes(spark, d), D.sightings(spark, d).select("listing_id").distinct(), "listing_id").select("probe_id")


@query("dq_pipeline_audit", sql="SELECT 'consumer-' || catalog_id AS path, CASE WHEN catalog_id = 1003 THEN 'failed' WHEN count(*) > 60 THEN 'lagging' ELSE 'healthy' END AS status FROM scans GROUP BY catalog_id UNION ALL SELECT 'sightings', 'lagging' UNION ALL SELECT 'scans', 'healthy'")
def _(spark, d):
    s = D.sightings(spark, d)
    c = D.scans(spark, d)
    health = c.groupBy("catalog_id").agg(F.count("*").alias("n")).select(F.concat(F.lit("consumer-"), "catalog_id").alias("consumer"), F.when(F.col("catalog_id") == 1003, "failed").otherwise("running").alias("status"), (F.col("n") * 5).alias("lag_seconds"))
    both = lambda s: Q.table_window(s, "observed_at", "sightings").unionByName(Q.table_window(c, "fetched_at", "scans"))
    return Q.pipeline_audit(health, Q.reconcile(both(s), both(s.where("run_id <> '1999-05'"))))


@query("agg_resource_summary", sql="SELECT user_id % 5 AS host, avg(event_id % 97) AS mean_cpu, CAST(max(event_id % 97) AS DOUBLE) AS peak_cpu, max(user_id * 1000) / 1048576.0::DOUBLE AS peak_rss_mb FROM events GROUP BY 1")
def _(spark, d):
    e = D.read(spark, d, "events").select((F.col("user_id") % 5).alias("host"), (F.col("event_id") % 97).cast("double").alias("cpu"), (F.col("user_id") * 1000).cast("double").alias("rss_bytes"))
    return OP.resource_summary(e, "host")


@query("agg_collapse_unique", sql="""SELECT user_id % 3 AS arm, '["' || string_agg(DISTINCT event_type, '","' ORDER BY event_type) || '"]' AS kinds, CAST(user_id % 3 AS VARCHAR) AS own, NULL::VARCHAR AS none FROM events GROUP BY 1""")
def _(spark, d):
    e = D.read(spark, d, "events").withColumn("arm", F.col("user_id") % 3).withColumn("none", F.lit(None).cast("string"))
    return e.groupBy("arm").agg(OP.collapse_unique("event_type").alias("kinds"), OP.collapse_unique("arm").alias("own"), OP.collapse_unique("none").alias("none"))


@query("mrg_latest_runs", sql="SELECT run_id, last(event_id ORDER BY observed_at, event_id) FILTER (WHERE brand IS NOT NULL) AS event_id, last(brand ORDER BY observed_at, event_id) FILTER (WHERE brand IS NOT NULL) AS brand FROM sightings GROUP BY 1")
def _(spark, d):
    s = D.sightings(spark, d).select("run_id", F.when(F.col("brand").isNotNull(), F.col("event_id")).alias("event_id"), "brand", F.struct("observed_at", F.col("event_id").alias("e")).alias("updated_at"))
    return O.latest_runs(s)


@query("mrg_upgrade_scans", sql="SELECT run_id, catalog_id, listing_count AS api_listing_count, NULL::BIGINT AS accepted_listing_count FROM scans")
def _(spark, d):
    return O.upgrade_scans(D.scans(spark, d)).select("run_id", "catalog_id", "api_listing_count", "accepted_listing_count")


@query("flt_leaf_catalogs", sql="SELECT DISTINCT catalog_id FROM sightings WHERE root_title = 'first' AND catalog_id IN (1001, 1003, 1005)")
def _(spark, d):
    return X.select_leaf_catalogs(D.catalogs(spark, d), ["first"], [1001, 1003, 1005]).select("catalog_id")


@query("flt_mart", sql="SELECT day, segment, events FROM (SELECT day, brand AS segment, count(*) AS events FROM sightings GROUP BY ALL) WHERE day BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' ORDER BY day DESC, events DESC, segment NULLS LAST LIMIT 500")
def _(spark, d):
    m = X.filter_mart(R.mart_segment_day(D.sightings(spark, d)), start="1998-01-01", end="1998-06-30", lens="brand")
    return m.orderBy(F.desc("day"), F.desc("events"), F.asc_nulls_last("segment")).limit(500).select("day", "segment", "events")


def _melted(part, row, columns):
    """A row's numbers as (part, name, value)."""
    return row.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "name", "value").select(F.lit(part).alias("part"), "name", "value")


def _compared(rows):
    """Every number of the comparisons as (part, name, value)."""
    numbers = ("support", "share", "mean_price", "sold_like", "sold_like_rate", "inferred", "thin_signal", "estimated_publication", "rank")
    values = F.array(*[F.struct(F.concat_ws("|", F.lit("lens"), "drilldown", F.lit(c)).alias("name"), F.col(c).cast("double").alias("value")) for c in numbers])
    return rows.select(F.lit("comparison").alias("part"), F.inline(values))


_STATE_COUNTS = {s: f"state_code = '{s}'" for s in C.STATES} | {f"{b}_basis": f"basis_kind = '{b}'" for b in ("observed", "inferred", "unknown")} | {"sold_like": "sold_like", "partial_signal": "partial_signal", "thin_signal": "thin_signal", "estimated_publication": "has_estimated_publication", "missing_publication": "NOT has_estimated_publication"}


def _parts(where, extra=""):
    """SQL of a summary's counts and of all comparisons, as (part, name, value), over a slice of the snapshot."""
    counts = " UNION ALL ".join([f"SELECT 'summary' AS part, 'tracked_listings' AS name, count(*)::DOUBLE AS value FROM snapshot WHERE {where}", *[f"SELECT 'summary', '{n}', (count(*) FILTER (WHERE {c}))::DOUBLE FROM snapshot WHERE {where}" for n, c in _STATE_COUNTS.items()]])
    numbers = {"support": "support", "share": "support / total", "mean_price": "price_sum / nullif(priced, 0)", "sold_like": "sold_like", "sold_like_rate": "sold_like / support", "inferred": "inferred", "thin_signal": "thin_signal", "estimated_publication": "estimated_publication", "rank": "rank"}
    lens = f"SELECT *, sum(support) OVER (PARTITION BY lens)::DOUBLE AS total, row_number() OVER (PARTITION BY lens ORDER BY support DESC, label, value) AS rank FROM (SELECT lens, value, label, count(*)::DOUBLE AS support, (count(*) FILTER (WHERE sold_like))::DOUBLE AS sold_like, sum(price_amount_cents)::DOUBLE AS price_sum, count(price_amount_cents) AS priced, count(*) FILTER (WHERE basis_kind = 'inferred') AS inferred, count(*) FILTER (WHERE thin_signal) AS thin_signal, count(*) FILTER (WHERE has_estimated_publication) AS estimated_publication FROM (SELECT * FROM ({_LENSES}) WHERE {where}) GROUP BY lens, value, label)"
    compared = " UNION ALL ".join(f"SELECT 'comparison', 'lens|' || lens || '=' || value || '|{n}', ({c})::DOUBLE FROM ranked WHERE rank <= 6" for n, c in numbers.items())
    return f"SELECT * FROM (WITH ranked AS ({lens}) {counts} UNION ALL {compared}{extra})"


_SLICE = "root_title = 'second' AND price_band_code = 'middle' AND contains(lower(title), 'ring')"


@query("exp_explorer_snapshot", *STATE, sql=_parts(_SLICE, f" UNION ALL SELECT 'summary', 'average_price', round(avg(price_amount_cents), 2) FROM snapshot WHERE {_SLICE} UNION ALL SELECT 'page', '' || row_number() OVER (ORDER BY favourite_count DESC NULLS LAST, last_seen_at DESC, listing_id DESC), listing_id FROM (SELECT * FROM snapshot WHERE {_SLICE} ORDER BY favourite_count DESC NULLS LAST, last_seen_at DESC, listing_id DESC LIMIT 12 OFFSET 12)"))
def _(spark, d):
    """Summary, every comparison and one page of a slice by root, price band (in the snapshot's limits) and text."""
    parts = E.explore(snapshot(spark, d), 2, 12, "favourite_desc", "ring", bands=D.BANDS, root_title="second", price_band_code="middle")
    order = Window.orderBy(F.desc_nulls_last("favourite_count"), F.desc("last_seen_at"), F.desc("listing_id"))  # a page's rows
    page = parts["page"].select(F.lit("page").alias("part"), F.row_number().over(order).cast("string").alias("name"), F.col("listing_id").cast("double").alias("value"))
    return _melted("summary", parts["summary"], ["tracked_listings", *_STATE_COUNTS, "average_price"]).unionByName(_compared(parts["comparisons"])).unionByName(page)


@query("exp_overview_snapshot", *STATE, sql=_parts("true", " UNION ALL SELECT 'summary', 'latest_seen', epoch(max(last_seen_at)) FROM snapshot UNION ALL SELECT 'summary', 'latest_scan', epoch(max(fetched_at)) FROM scans WHERE success UNION ALL SELECT 'caution', 'mostly_inferred', 1 FROM snapshot HAVING count(*) FILTER (WHERE basis_kind = 'inferred') * 2 > count(*) UNION ALL SELECT 'caution', 'many_unknown', 1 FROM snapshot HAVING count(*) FILTER (WHERE basis_kind = 'unknown') * 4 > count(*) UNION ALL SELECT 'caution', 'mostly_low_confidence', 1 FROM snapshot HAVING count(*) FILTER (WHERE confidence_label = 'low') * 2 > count(*) UNION ALL SELECT 'caution', 'mostly_partial_signal', 1 FROM snapshot HAVING count(*) FILTER (WHERE partial_signal) * 2 > count(*) UNION ALL SELECT 'caution', 'mostly_first_pass', 1 FROM snapshot HAVING count(*) FILTER (WHERE freshness_bucket = 'first-pass-only') * 2 > count(*)"))
def _(spark, d):
    """The overview with its latest times, cautions and comparisons."""
    whole = E.overview_snapshot(snapshot(spark, d), D.scans(spark, d), bands=D.BANDS)
    row = whole["summary"].withColumns({"latest_seen": F.unix_seconds("latest_seen_at"), "latest_scan": F.unix_seconds("latest_scan_at")})
    cautions = whole["summary"].select(F.lit("caution").alias("part"), F.explode("cautions").alias("name"), F.lit(1.0).alias("value"))
    return _melted("summary", row, ["tracked_listings", *_STATE_COUNTS, "latest_seen", "latest_scan"]).unionByName(_compared(whole["comparisons"])).unionByName(cautions)


@query("prj_caution_notes", *STATE, sql="""SELECT count(*) AS tracked_listings, concat_ws(',', CASE WHEN count(*) = 0 THEN 'empty' END, CASE WHEN count(*) FILTER (WHERE basis_kind = 'inferred') * 2 > count(*) THEN 'mostly_inferred' END, CASE WHEN count(*) FILTER (WHERE basis_kind = 'unknown') * 4 > count(*) THEN 'many_unknown' END, CASE WHEN count(*) FILTER (WHERE confidence_label = 'low') * 2 > count(*) THEN 'mostly_low_confidence' END,
  CASE WHEN count(*) FILTER (WHERE partial_signal) * 2 > count(*) THEN 'mostly_partial_signal' END, CASE WHEN count(*) FILTER (WHERE freshness_bucket = 'first-pass-only') * 2 > count(*) THEN 'mostly_first_pass' END) AS notes FROM snapshot""")
def _(spark, d):
    return E.caution_notes(E.overview(snapshot(spark, d)))


_MODES = {m: f"{c} {w.upper()} NULLS LAST" for m, (w, c) in E.SORTS.items()}


@query("srt_modes", *STATE, sql=" UNION ALL ".join(f"(SELECT '{m}' AS mode, listing_id, row_number() OVER (ORDER BY {o}, last_seen_at DESC, listing_id DESC) AS place FROM snapshot ORDER BY place LIMIT 20)" for m, o in _MODES.items()))
def _(spark, d):
    snap, out = snapshot(spark, d), None
    for m in _MODES:
        page = E.sort_listings(snap, m).limit(20).select(F.lit(m).alias("mode"), "listing_id", F.monotonically_increasing_id().alias("n"))
        page = page.select("mode", "listing_id", F.row_number().over(Window.partitionBy("mode").orderBy("n")).alias("place"))
        out = page if out is None else out.unionByName(page)
    return out

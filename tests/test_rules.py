"""Hand-made rows for rules, folds, parsers, ids and streams."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tracklot.functions import columns as X
from tracklot.functions import identity as I
from tracklot.operators import explore as E
from tracklot.operators import observe as O
from tracklot.operators import ops as OP
from tracklot.operators import quality as Q
from tracklot.operators import score as SC
from tracklot.operators import state as ST
from tracklot.sources import lake as L
from tracklot.sources import parse as PR
from tracklot.streaming import streams

EVIDENCE = "listing_id long, probe_outcome string, probe_status int, seen_in_latest_primary_scan boolean, follow_up_miss_count long, observation_count long, last_seen_age_hours double, latest_primary_scan_run_id string"
SIGHTING = "event_id string, listing_id long, run_id string, observed_at timestamp, catalog_id long, page_number int, card_position long, title string, brand string, condition_label string, price_amount_cents long"


def test_state_rules(spark):
    rows = [
        (1, "deleted", 404, True, 0, 1, 1.0, "r"), (2, "sold", 200, True, 0, 1, 1.0, "r"), (3, "active", 200, False, 5, 1, 1.0, "r"), (4, "unavailable", 200, False, 0, 1, 1.0, "r"),
        (5, "unknown", 403, True, 0, 1, 1.0, "r"), (6, None, None, False, 3, 2, 1.0, "r"), (7, None, None, False, 2, 1, 1.0, "r"), (8, None, None, False, 1, 1, 1.0, "r"),
        (9, None, None, False, 0, 1, 24.0, None), (10, "unknown", 403, False, 0, 1, 96.0, "r"), (11, None, None, False, 0, 1, 30.0, "r"), (12, None, None, None, None, None, None, None),
    ]
    out = ST.with_state_explanation(ST.classify_state(spark.createDataFrame(rows, EVIDENCE)))
    got = {r.listing_id: (r.state_code, r.basis_kind, r.confidence_score, r.confidence_label) for r in out.collect()}
    assert [got[i][2] for i in range(1, 12)] == [0.97, 0.91, 0.95, 0.62, 0.90, 0.82, 0.72, 0.46, 0.58, 0.24, 0.32]
    assert got[5][:2] == ("active", "observed") and got[7] == ("sold_probable", "inferred", 0.72, "medium") and got[12][0] == "active"
    reasons = {r.listing_id: r.state_explanation.reasons for r in out.collect()}
    assert len(reasons[6]) == 2 and "latest probe" in reasons[5][0]


def score_rows(spark, n, brand="b"):
    return spark.createDataFrame([(i, "active", "observed", "high", "fresh-followup", 3, 0, 1000 * (i + 1), brand, "good", 7, "root") for i in range(n)], "listing_id long, state_code string, basis_kind string, confidence_label string, freshness_bucket string, observation_count long, follow_up_miss_count long, price_amount_cents long, brand string, condition_label string, catalog_id long, root_title string")


def test_scores(spark):
    rows = {r.listing_id: r for r in SC.score_listings(score_rows(spark, 5)).collect()}
    assert rows[4].demand_score == 56.0 and rows[4].context_name == "catalog_brand_condition" and rows[4].price_percentile == 0.9
    assert rows[4].premium_score == round(56 * 0.78 + 80 * 0.22, 2) and rows[0].expensive_signal == 0
    few = SC.score_listings(score_rows(spark, 2, None)).collect()
    assert all(r.context_name is None and r.premium_score == round(56 * 0.85, 2) for r in few)


def sightings(spark, seed=1):
    rng = random.Random(seed)
    rows = [(f"e{i}", rng.randrange(4), f"r{rng.randrange(3)}", None, 7, 1, i, rng.choice(["t", None]), rng.choice(["x", "y", None]), None, rng.choice([None, 100, 200])) for i in range(40)]
    df = spark.createDataFrame(rows, SIGHTING)
    return df.withColumn("observed_at", F.timestamp_seconds(F.expr("cast(substring(run_id, 2) AS int)") * 86400 + F.col("card_position") % 5))


def test_folds_do_not_depend_on_order_or_replay(spark):
    s = sightings(spark)
    once = {tuple(r) for r in O.fold_observations(s).collect()}
    shuffled = s.orderBy(F.rand(3)).repartition(3)
    assert {tuple(r) for r in O.fold_observations(shuffled).collect()} == once
    replay = O.dedupe_events(s.unionByName(shuffled))
    assert {tuple(r) for r in O.fold_observations(replay).collect()} == once
    best = lambda d: {tuple(r) for r in d.groupBy("listing_id").agg(O._newest("brand", F.struct("observed_at", "event_id"))).collect()}
    assert best(s) == best(shuffled)


def test_two_runs_give_a_mean_gap(spark):
    s = spark.createDataFrame([("a", 9001, "r1", "2024-01-01 00:00:00", 1), ("b", 9001, "r1", "2024-01-01 01:00:00", 2), ("c", 9001, "r2", "2024-01-02 02:00:00", 1)], "event_id string, listing_id long, run_id string, at string, page_number int")
    s = s.selectExpr("*", "cast(at AS timestamp) AS observed_at", "1L AS card_position", "1L AS catalog_id", "'t' AS title", "'b' AS brand", "'c' AS condition_label", "5L AS price_amount_cents")
    r = O.summarize_observations(O.fold_observations(s)).first()
    assert (r.observation_count, r.total_sightings, r.mean_revisit_hours) == (2, 3, 26.0)


def test_money_and_text(spark):
    texts = [("1.234,56 €", 123456), ("12,50", 1250), ("12.50", 1250), ("1,234.50 $", 123450), ("1 234 €", 123400), ("free", None), (None, None)]
    df = spark.createDataFrame(texts, "t string, want long")
    assert all(r.c == r.want for r in df.withColumn("c", X.parse_money("t")).collect())
    row = spark.createDataFrame([("M · Bon état", "Robe rouge, brand: Zed, état: neuf", "https://x/items/5-robe-rouge?r=1#top")], "sub string, alt string, url string").select(X.split_subtitle("sub").alias("s"), X.named_value("alt", "brand").alias("b"), X.title_from(F.lit(""), "url").alias("t"), X.canonical_url("url").alias("u")).first()
    assert (row.s.size_label, row.s.condition_label, row.b, row.t, row.u) == ("M", "Bon état", "Zed", "robe rouge", "https://x/items/5-robe-rouge")


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([(1, "50% off"), (2, "5000 off")], "listing_id long, title string")
    assert [r.listing_id for r in X.search_listings(df, "50%").collect()] == [1]
    assert X.search_listings(df, " ").count() == 2


def test_uuid5_equals_the_library(spark):
    names = ["", "a", "é" * 30]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", I.uuid5(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(I.NAMESPACE, r.n)) for r in rows)


def test_api_page_edges(spark):
    body = '{"items":[{"id":"5","title":"a","brand_dto":{"title":"B"},"status_id":2,"price":{"amount":"1,5","currency_code":"EUR"}},{"id":"x"},{"title":"none"},{"id":6,"brand_title":"C","status":"Neuf","price":null}]}'
    rows = PR.parse_api_pages(spark.createDataFrame([("p", body), ("q", "broken"), ("r", None)], "page string, body string")).collect()
    assert [(r.listing_id, r.brand, r.condition_label, r.price_amount_cents, r.price_currency) for r in rows] == [(5, "B", "Neuf sans étiquette", 150, "€"), (6, "C", "Neuf", None, None)]


def test_sql_functions_and_table_function(spark):
    I.register_functions(spark)
    assert spark.sql("SELECT price_band(2500L), freshness_bucket(2L, 30D), canonical_url('a?b')").first()[:] == ("middle", "aging-followup", "a")
    html = "<a title='Robe, x' href='/items/7-robe?a'><b>5,00 €</b></a>"
    assert spark.sql(f'SELECT listing_id, price_text FROM parse_cards("{html}")').first()[0] == 7


def test_lake_checks(spark):
    assert L.choose_datasets(["probes", "sightings"]) == ["sightings", "probes"]
    with pytest.raises(ValueError):
        L.choose_datasets(["nope"])
    report = {r.name: r.present for r in L.table_health(spark, {"no": "/tmp/does-not-exist-at-all"}).collect()}
    assert report == {"no": False}


def test_parity_counts_copies(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "a int, b string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "a int, b string")
    assert sorted(r.surplus for r in Q.parity(a, b).collect()) == [-1, 1]
    assert Q.parity(a, a).count() == 0


def test_pages_and_interleave(spark):
    df = spark.createDataFrame([(i, i % 3, "2024-01-01", i) for i in range(10)], "listing_id long, g int, last_seen_at string, price_amount_cents long")
    page = E.paginate(df, 2, 4, "price_asc").collect()
    assert [r.listing_id for r in page] == [4, 5, 6, 7] and page[0].total_listings == 10 and page[0].has_next
    assert [r.g for r in E.interleave(df, "g", [F.col("listing_id")], 6).collect()] == [0, 1, 2, 0, 1, 2]


def test_leaderboard_and_lanes(spark):
    cards = spark.createDataFrame([("a", 10.0, 0.23, 0.0), ("b", 10.0, 0.44, 0.0)], "arm string, new_per_hour double, duplicate_ratio double, challenge_rate double")
    best = OP.leaderboard(cards).where("rank = 1").first()
    assert (best.arm, best.won_by) == ("a", "duplicate_ratio")
    lanes = spark.createDataFrame([("x", "idle", 1), ("y", "failed", 2)], "lane_name string, status string, next_at int")
    assert OP.lane_rollup(lanes).first().lane_name == "y"


def test_presence_stream_ignores_late_rows(spark):
    path = streams.folder(spark, "late")
    cols = "event_id string, listing_id long, run_id string, observed_at timestamp"
    from datetime import datetime

    for rows in ([("a", 1, "r2", datetime(2024, 1, 2))], [("b", 1, "r1", datetime(2024, 1, 1)), ("c", 1, "r3", datetime(2024, 1, 3))]):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(path)
    r = streams.presence_available(streams.stream_lake(spark, path, 1)).first()
    assert r.observation_count + r.late_rows == 3 and r.observation_count >= 2


def test_condition_names_and_amounts_with_blanks(spark):
    rows = spark.createDataFrame([(i, a) for i, a in zip(range(1, 8), ["1 250,00", "12.50", " 3 ", "x", None, "7,5", "1,250.00"], strict=True)], "i int, a string")
    got = rows.select(X.resolve_condition(F.lit(""), "i").alias("c"), X.price_to_cents("a").alias("p")).collect()
    assert [r.c for r in got] == ["Neuf avec étiquette", "Neuf sans étiquette", "Très bon état", "Bon état", "Satisfaisant", "Mauvais état", None]
    assert [r.p for r in got] == [125_000, 1250, 300, None, None, 750, None]


def test_probe_pages(spark):
    page = lambda i=7, b="true", c="false", h="false", r="false": f'<p>x</p>\\"item_id\\":{i},"y":0,"can_buy":{b},"is_closed":{c},"is_hidden":{h},"is_reserved":{r}'
    cases = [
        (page(), 200, "active", "buy_signal_open"), (page(b="false", c="true"), 200, "sold", "buy_signal_closed"), (page(b="true", c="true"), 200, "unknown", "buy_signal_ambiguous"),
        (page(b="false", r="true"), 200, "unavailable", "buy_signal_unavailable"), (page(h="true"), 200, "unavailable", "buy_signal_unavailable"), (page(i=8), 200, "unknown", "item_id_mismatch"),
        ("cloudflare " + page(), 200, "active", "buy_signal_open"), ("Turnstile", 200, "unknown", "anti_bot_challenge"), ("plain", 200, "unknown", "buy_signal_not_found"), (None, 200, "unknown", "buy_signal_not_found"),
        (page(), 404, "deleted", "http_404"), (page(), 410, "deleted", "http_410"), ("", 403, "unknown", "anti_bot_challenge"), ("captcha", 400, "unknown", "anti_bot_challenge"), ("", 418, "unknown", "unexpected_http_418"),
        ("", 502, "unknown", "http_502"), (page(), None, "unknown", "no_response_status"),
    ]
    rows = PR.classify_probe_pages(spark.createDataFrame([(k, 7, h, s) for k, (h, s, _, _) in enumerate(cases)], "k int, listing_id long, html string, status int")).orderBy("k").collect()
    assert [(r.probe_outcome, r.reason) for r in rows] == [c[2:] for c in cases]
    assert rows[7].challenge_markers == ["turnstile"] and rows[6].challenge_markers is None


def test_degraded_and_challenge_flags(spark):
    p = spark.createDataFrame([("http_500", None, 200), ("unexpected_http_418", "", 418), ("probe_exception", "", None), ("anti_bot_challenge", None, 200), ("buy_signal_open", "", 200), (None, None, None), ("x", "timeout", 200), ("x", None, 429), ("x", None, 503)], "r string, e string, s int")
    assert [r[0] for r in p.select(X.probe_is_degraded("r", "e", "s")).collect()] == [True, True, True, True, False, False, True, True, True]
    m = spark.createDataFrame([("Just a Moment...", 200), ("page __cf_chl_x", 200), ("Attention Required!", None), ("forbidden", 200), (None, 403), (None, None), ("", 429)], "m string, s int")
    assert [r[0] for r in m.select(X.scan_is_challenge("s", "m")).collect()] == [True, True, True, False, True, False, True]


def test_html_cards_equal_the_table_function(spark):
    html = """<div><a href="https://shop.example/items/5-x?q=1" title="Robe, brand: B, état: bon"><p data-testid="i-subtitle">M · bon</p><b>1 250,50 €</b></a><a href='/items/6' title='No price, x'>y</a><a href="/other">z</a><a\nhref="/items/7" title="In title 3,00 €">\n</a></div>"""
    rows = [tuple(r) for r in PR.parse_html_pages(spark.createDataFrame([(html,), (None,), ("",)], "html string")).collect()]
    plain = list(PR.card_rows(html))
    assert [r[0] for r in rows] == [p[0] for p in plain] == [5, 6, 7] and [r[1] for r in rows] == [p[1] for p in plain]
    assert [r[6] for r in rows] == [125_050, None, 300] and rows[0][2:6] == ("Robe", "B", "M", "bon")


def test_catalog_trees_of_any_depth(spark):
    body = '{"id":9,"title":"t9"}'
    for i in range(8, 0, -1):
        body = f'{{"id":{i},"title":"t{i}","catalogs":[{body}]}}'
    rows = PR.flatten_catalog_tree(spark.createDataFrame([(f"[{body}]",)], "body string")).orderBy("id").collect()
    assert [(r.id, r.depth, r.is_leaf) for r in rows] == [(i, i - 1, i == 9) for i in range(1, 10)] and rows[8].path.count(" > ") == 8


def test_experiment_scorecard(spark):
    arms = ["a", "b"]
    runs = spark.createDataFrame([("a", 14, 10), ("a", 12, 10), ("b", 36, 20)], "arm string, raw_listing_hits long, unique_listing_hits long")
    scans = spark.createDataFrame([("a", 200, None), ("a", 200, None), ("b", 200, None), ("b", 403, "captcha")], "arm string, response_status int, error_message string")
    cycles = spark.createDataFrame([("a", 2, 0, 0, False), ("b", 2, 1, 1, True)], "arm string, probed int, anti_bot int, degraded_probes int, is_degraded boolean")
    storage = spark.createDataFrame([("a", 1, 100, 12_000), ("a", 2, 120, 13_600), ("b", 1, 100, 12_000), ("b", 2, 120, 14_400)], "arm string, captured_at int, listing_count long, bytes long")
    resources = spark.createDataFrame([("a", 39.0, 360.0), ("a", 41.0, 370.0)], "arm string, cpu_percent double, rss_mb double")
    hours = spark.createDataFrame([(x, 2.0) for x in arms], "arm string, hours double")
    a, b = OP.experiment_scorecard(runs, scans, cycles, storage, resources, hours).orderBy("arm").collect()
    assert (a.net_new, a.new_per_hour, a.duplicate_ratio, a.bytes_per_new_listing, a.mean_cpu, a.peak_rss_mb) == (20, 10.0, 0.2308, 80.0, 40.0, 370.0)
    assert (b.new_per_hour, b.duplicate_ratio, b.bytes_per_new_listing, b.challenge_rate, b.degraded_rate, b.mean_cpu) == (10.0, 0.4444, 120.0, 0.5, 0.5, None)
    alone = OP.experiment_scorecard(runs, scans, cycles, storage.where("captured_at = 1"), resources, hours).orderBy("arm").first()
    assert (alone.net_new_source, alone.net_new, alone.bytes_per_new_listing) == ("unique_hits", 20, None)

"""Queries over listings: observations, state, scores, explorer, rollups, changes; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklot import constants as C
from tracklot.functions import columns as X
from tracklot.operators import changes as CH
from tracklot.operators import explore as E
from tracklot.operators import observe as O
from tracklot.operators import rollups as R
from tracklot.operators import score as SC
from tracklot.operators import state as ST
from tracklot.plans import prelude as P
from tracklot.sources import standin as D
from tracklot.sources.scratch import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, *parts: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = P.with_(*parts, select=sql)
        return f

    return keep


def inputs(spark: SparkSession, d: str, scans: DataFrame | None = None) -> DataFrame:
    """State inputs; scans (unless they are at hand) and histories are tables, and sightings are read once for each."""
    s = D.sightings(spark, d)
    return O.state_inputs(s, D.scans(spark, d, s) if scans is None else scans, D.probes(spark, d), D.NOW, keep=lambda df, name: df if df is scans else materialize(df, name))


def snapshot(spark: SparkSession, d: str, scans: DataFrame | None = None) -> DataFrame:
    """The classified snapshot as a table, for as many questions as a query asks of it."""
    return materialize(ST.classified_snapshot(inputs(spark, d, scans), D.NOW, D.BANDS), "snapshot")


def scores(spark: SparkSession, d: str, scans: DataFrame | None = None) -> DataFrame:
    return SC.score_listings(snapshot(spark, d, scans))


def log(spark: SparkSession, d: str) -> DataFrame:
    s = D.sightings(spark, d)
    return CH.event_log(s, materialize(D.scans(spark, d, s), "scans"), D.probes(spark, d))


def changes(spark: SparkSession, d: str) -> DataFrame:
    s = D.sightings(spark, d)
    return CH.changes_of(s, materialize(D.scans(spark, d, s), "scans"), D.probes(spark, d))


def price_changes(spark: SparkSession, d: str) -> DataFrame:
    """The mart of price changes; only sightings make them."""
    s = D.sightings(spark, d)
    return CH.mart_price_change(CH.derive_changes(CH.seen_log(s, materialize(D.scans(spark, d, s), "scans"))))


def transitions(s: DataFrame, scans: DataFrame, probes: DataFrame) -> DataFrame:
    """The mart of state transitions; of the misses after a sighting only the first few can make them."""
    return CH.mart_state_transition(CH.changes_of_turns(CH.turns_of(s, scans, probes), states_only=True))


def pack_base(spark: SparkSession, d: str, scans: DataFrame) -> DataFrame:
    """The snapshot for packs, which ask one question of it and of few columns: it is no table, and cards do not move."""
    return ST.classified_snapshot(O.state_inputs(D.sightings(spark, d), scans, D.probes(spark, d), D.NOW), D.NOW, D.BANDS)


def packs_of_all(spark: SparkSession, d: str) -> DataFrame:
    """Packs of all listings; their parts come partitioned by listing, so only sightings and probes move."""
    s = D.sightings(spark, d)
    scans = materialize(D.scans(spark, d, s), "scans")
    price, state = CH.mart_price_change(CH.derive_changes(CH.seen_log(s, scans))), transitions(s, scans, D.probes(spark, d))
    return CH.evidence_packs(pack_base(spark, d, scans), R.mart_listing_day(CH.by_listing(s, scans)), price, state)


@query("prj_price_band", sql="SELECT event_id, CASE WHEN price_amount_cents IS NULL THEN 'unknown' WHEN price_amount_cents < 139500 THEN 'under' WHEN price_amount_cents < 312400 THEN 'middle' ELSE 'over' END AS band, CASE WHEN price_amount_cents IS NULL THEN 3 WHEN price_amount_cents < 139500 THEN 0 WHEN price_amount_cents < 312400 THEN 1 ELSE 2 END AS band_order FROM sightings")
def _(spark, d):
    return D.sightings(spark, d).select("event_id", X.price_band("price_amount_cents", D.BANDS).alias("band"), X.price_band_order("price_amount_cents", D.BANDS).alias("band_order"))


@query("flt_facets_and_search", sql="SELECT event_id, brand, title FROM sightings WHERE coalesce(brand, 'unknown-brand') = 'unknown-brand' AND root_title = 'first' AND contains(lower(title), 'ring')")
def _(spark, d):
    s = X.filter_listings(D.sightings(spark, d), brand="unknown-brand", root_title="first", condition_label="")
    return X.search_listings(s, " RING ", ("title", "brand")).select("event_id", "brand", "title")


@query("flt_accept_sightings", sql="SELECT event_id, price_amount_cents FROM sightings WHERE price_amount_cents >= 100000 AND price_amount_cents <= 200000 AND lower(trim(brand)) IN ('brand#1', 'brand#12')")
def _(spark, d):
    return X.accept_sightings(D.sightings(spark, d), 100_000, 200_000, ["BRAND#1 ", "brand#12"]).select("event_id", "price_amount_cents")


@query("flt_window_overlap", sql="SELECT listing_id, min(observed_at) AS first_at, max(observed_at) AS last_at FROM sightings GROUP BY listing_id HAVING min(observed_at) <= TIMESTAMP '1999-06-30' AND max(observed_at) >= TIMESTAMP '1999-06-01'")
def _(spark, d):
    s = D.sightings(spark, d).groupBy("listing_id").agg(F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))
    return s.where(X.overlaps_window("first_at", "last_at", "1999-06-01", "1999-06-30"))


@query("mrg_latest_cards", P.CARDS, sql="SELECT listing_id, title, brand, condition_label, price_amount_cents, total_price_amount_cents, favourite_count, view_count, created_at_ts, first_discovered_at FROM cards")
def _(spark, d):
    return O.latest_cards(D.sightings(spark, d)).select("listing_id", "title", "brand", "condition_label", "price_amount_cents", "total_price_amount_cents", "favourite_count", "view_count", "created_at_ts", "first_discovered_at")


@query("mrg_dedupe_sightings", sql="SELECT run_id, listing_id, catalog_id, page_number, max(observed_at) AS observed_at, last(event_id ORDER BY observed_at, event_id) AS event_id FROM sightings GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return O.dedupe_sightings(D.sightings(spark, d)).select("run_id", "listing_id", "catalog_id", "page_number", "observed_at", "event_id")


@query("obs_fold_observations", sql="SELECT run_id, listing_id, min(observed_at) AS observed_at, count(*) AS sighting_count, min(card_position) AS card_position, first(price_amount_cents ORDER BY observed_at, event_id) FILTER (WHERE price_amount_cents IS NOT NULL) AS price_amount_cents FROM sightings GROUP BY 1, 2")
def _(spark, d):
    return O.fold_observations(D.sightings(spark, d)).select("run_id", "listing_id", "observed_at", "sighting_count", "card_position", "price_amount_cents")


@query("agg_observation_summary", P.OBS, sql="SELECT * FROM summary")
def _(spark, d):
    return O.summarize_observations(O.fold_observations(D.sightings(spark, d)))


@query("src_snapshots", P.OBS, sql="SELECT listing_id, first_seen_at, last_seen_at, first_run_id, last_observed_run_id AS last_run_id FROM summary")
def _(spark, d):
    return O.build_snapshots(O.fold_observations(D.sightings(spark, d)))


HISTORY = "listing_id, observation_count, total_sightings, first_seen_at, last_seen_at, last_seen_age_hours, freshness_bucket, signal_completeness, partial_signal, thin_signal, has_estimated_publication"


@query("obs_history_summaries", P.OBS, P.CARDS, P.INPUTS, sql=f"SELECT {HISTORY} FROM history")
def _(spark, d):
    s = D.sightings(spark, d)
    return O.history_summaries(O.fold_observations(s), O.latest_cards(s), D.NOW).selectExpr(*HISTORY.split(", "))


@query("obs_follow_up_misses", P.OBS, P.CARDS, P.INPUTS, sql="SELECT listing_id, follow_up_miss_count, latest_miss_at FROM inputs")
def _(spark, d):
    s = D.sightings(spark, d)
    obs = O.fold_observations(s).select("listing_id", "run_id", "observed_at", "sighting_count")
    last = O.summarize_observations(obs).select("listing_id", "last_seen_at").join(O.latest_cards(s).select("listing_id", "catalog_id"), "listing_id")
    return O.follow_up_misses(materialize(last, "last"), obs, materialize(D.scans(spark, d, s), "scans"))


@query("obs_state_inputs", P.OBS, P.CARDS, P.INPUTS, sql="SELECT listing_id, follow_up_miss_count, latest_primary_scan_run_id, seen_in_latest_primary_scan, probe_outcome, probed_at, probe_status FROM inputs")
def _(spark, d):
    return inputs(spark, d).select("listing_id", "follow_up_miss_count", "latest_primary_scan_run_id", "seen_in_latest_primary_scan", "probe_outcome", "probed_at", "probe_status")


STATE = (P.OBS, P.CARDS, P.INPUTS, P.SNAPSHOT)


@query("state_classified_snapshot", *STATE, sql="SELECT listing_id, state_code, basis_kind, confidence_score, confidence_label, sold_like, price_band_code FROM snapshot")
def _(spark, d):
    return snapshot(spark, d).select("listing_id", "state_code", "basis_kind", "confidence_score", "confidence_label", "sold_like", "price_band_code")


_COUNTS = "count(*) AS tracked_listings, " + ", ".join(f"count(*) FILTER (WHERE state_code = '{s}') AS {s}" for s in C.STATES)


@query("state_summary", *STATE, sql=f"SELECT root_title, {_COUNTS}, count(*) FILTER (WHERE confidence_label = 'high') AS high_confidence, count(*) FILTER (WHERE basis_kind = 'inferred') AS inferred_basis FROM snapshot GROUP BY ROLLUP (root_title)")
def _(spark, d):
    return ST.state_summary(snapshot(spark, d))


@query("agg_freshness_summary", *STATE, sql="SELECT root_title, count(*) AS tracked_listings, " + ", ".join(f"count(*) FILTER (WHERE freshness_bucket = '{b}') AS {b.replace('-', '_')}" for b in C.FRESHNESS_POINTS) + " FROM snapshot GROUP BY ROLLUP (root_title)")
def _(spark, d):
    return ST.freshness_summary(snapshot(spark, d))


_REASON = """CASE WHEN probe_outcome = 'deleted' THEN 'probe shows deletion (' || probe_status || ')' WHEN probe_outcome = 'sold' THEN 'probe shows it cannot be bought any more' WHEN probe_outcome = 'active' THEN 'probe shows it can be bought' WHEN probe_outcome = 'unavailable' THEN 'probe shows it unavailable without a clear sign'
  WHEN seen_in_latest_primary_scan THEN 'seen in its catalog''s latest scan that worked' WHEN follow_up_miss_count > 2 THEN 'missing from ' || follow_up_miss_count || ' later scans' WHEN follow_up_miss_count = 2 THEN 'missing from 2 later scans' WHEN follow_up_miss_count = 1 THEN 'missing from one later scan'
  WHEN latest_primary_scan_run_id IS NULL AND last_seen_age_hours <= 24 THEN 'seen lately, no newer scan' WHEN last_seen_age_hours > 72 THEN 'last seen too long ago' ELSE 'too little evidence' END"""


@query("prj_state_explanation", *STATE, sql=f"SELECT listing_id, concat_ws(';', CASE WHEN probe_outcome = 'unknown' THEN 'the latest probe says nothing' END, {_REASON}, CASE WHEN follow_up_miss_count >= 2 AND observation_count >= 2 THEN 'seen repeatedly before it went missing' END) AS reasons FROM snapshot")
def _(spark, d):
    return ST.with_state_explanation(snapshot(spark, d)).select("listing_id", F.array_join("state_explanation.reasons", ";").alias("reasons"))


@query("srt_revisit_plan", *STATE, sql="SELECT listing_id, last_seen_age_hours + CASE observation_count WHEN 1 THEN 18.0 WHEN 2 THEN 8.0 ELSE 0.0 END + CASE WHEN last_seen_age_hours > 72 THEN 12.0 WHEN last_seen_age_hours > 24 THEN 6.0 ELSE 0.0 END + signal_completeness * 1.5 AS priority_score, freshness_bucket || ',' || CASE WHEN observation_count <= 2 THEN 'under-observed' ELSE 'tracked' END || ',' || CASE WHEN signal_completeness >= 5 THEN 'high-signal' ELSE 'thin-signal' END AS priority_reasons FROM history ORDER BY priority_score DESC, signal_completeness DESC, last_seen_at, listing_id LIMIT 50")
def _(spark, d):
    s = D.sightings(spark, d)
    return O.revisit_plan(O.history_summaries(O.fold_observations(s), O.latest_cards(s), D.NOW), 50).select("listing_id", "priority_score", "priority_reasons")


@query("srt_probe_targets", *STATE, sql="SELECT listing_id, follow_up_miss_count, observation_count FROM inputs WHERE (probed_at IS NULL OR probed_at < last_seen_at) AND (follow_up_miss_count > 0 OR observation_count = 1) ORDER BY follow_up_miss_count DESC, observation_count = 1 DESC, last_seen_age_hours, signal_completeness DESC, listing_id LIMIT 40")
def _(spark, d):
    return O.probe_targets(inputs(spark, d), 40).select("listing_id", "follow_up_miss_count", "observation_count")


@query("score_demand", *STATE, P.DEMAND, sql="SELECT listing_id, demand_score FROM demand")
def _(spark, d):
    return SC.demand_score(snapshot(spark, d)).select("listing_id", "demand_score")


@query("score_peer_context", *STATE, P.SCORES, sql="SELECT listing_id, context_name, context_size FROM scores")
def _(spark, d):
    return SC.peer_context(SC.demand_score(snapshot(spark, d))).select("listing_id", "context_name", "context_size")


@query("score_premium", *STATE, P.SCORES, sql="SELECT listing_id, demand_score, context_name, price_percentile, premium_score FROM scores")
def _(spark, d):
    return scores(spark, d).select("listing_id", "demand_score", "context_name", "price_percentile", "premium_score")


@query("score_rankings", *STATE, P.SCORES, sql="SELECT listing_id, demand_score, premium_score FROM scores ORDER BY premium_score DESC, demand_score DESC, last_seen_at DESC, listing_id LIMIT 50")
def _(spark, d):
    return SC.rank_listings(scores(spark, d), "premium", 50).select("listing_id", "demand_score", "premium_score")


@query("score_market_segments", *STATE, P.SCORES, sql="""SELECT catalog_id, count(*) AS tracked_listings, sum(price_amount_cents)::BIGINT AS price_sum, count(price_amount_cents) AS priced, count(*) FILTER (WHERE sold_like) AS sold_like_count,
  count(*) FILTER (WHERE last_seen_age_hours <= 24 AND observation_count = 1) AS recent_arrivals, any_value(latest) AS latest_scan_count, any_value(previous) AS previous_scan_count, coalesce(any_value(latest) - any_value(previous), 0) AS visible_delta
  FROM scores LEFT JOIN (SELECT catalog_id, max(listing_count) FILTER (WHERE rn = 1) AS latest, max(listing_count) FILTER (WHERE rn = 2) AS previous FROM (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY fetched_at DESC, run_id DESC) AS rn FROM scans WHERE success) GROUP BY catalog_id) USING (catalog_id)
  GROUP BY catalog_id HAVING count(*) >= 3""")
def _(spark, d):
    return SC.market_segments(scores(spark, d), D.scans(spark, d)).select("catalog_id", "tracked_listings", "price_sum", "priced", "sold_like_count", "recent_arrivals", "latest_scan_count", "previous_scan_count", "visible_delta")


_TOPS = "list, rank, catalog_id, tracked_listings, avg_demand_score, avg_price_amount_cents, sold_like_count, recent_arrivals, visible_delta"


@query("score_market_summary", *STATE, P.SCORES, sql=f"""SELECT {_TOPS} FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY score DESC, second DESC, catalog_id) AS rank FROM (
  SELECT list, *, CASE list WHEN 'performing' THEN round(avg_demand_score * 0.68 + avg_premium_score * 0.32, 2) ELSE round(avg_demand_score * 0.35 + sold_like_count / tracked_listings::DOUBLE * 40 + recent_arrivals * 6 + greatest(visible_delta, 0) * 4, 2) END AS score,
    CASE list WHEN 'performing' THEN tracked_listings ELSE recent_arrivals END AS second FROM (VALUES ('performing'), ('rising')) l(list), (
  SELECT catalog_id, count(*) AS tracked_listings, round(avg(demand_score), 2) AS avg_demand_score, round(avg(premium_score), 2) AS avg_premium_score, round(coalesce(sum(price_amount_cents), 0) / greatest(count(price_amount_cents), 1)::DOUBLE, 2) AS avg_price_amount_cents, count(*) FILTER (WHERE sold_like) AS sold_like_count,
    count(*) FILTER (WHERE last_seen_age_hours <= 24 AND observation_count = 1) AS recent_arrivals, coalesce(any_value(latest) - any_value(previous), 0) AS visible_delta
  FROM scores LEFT JOIN (SELECT catalog_id, max(listing_count) FILTER (WHERE rn = 1) AS latest, max(listing_count) FILTER (WHERE rn = 2) AS previous FROM (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY fetched_at DESC, run_id DESC) AS rn FROM scans WHERE success) GROUP BY catalog_id) USING (catalog_id)
  GROUP BY catalog_id HAVING count(*) >= 3))) WHERE rank <= 4""")
def _(spark, d):
    scans = materialize(D.scans(spark, d), "scans")
    tops = SC.market_summary(materialize(scores(spark, d, scans), "scores"), scans, 4)
    ranked = lambda name, by, then: tops[name].select("*", F.lit(name).alias("list"), F.row_number().over(Window.orderBy(F.desc(by), F.desc(then), "catalog_id")).alias("rank"))  # noqa: E731  (four rows)
    return ranked("performing", "performance_score", "tracked_listings").unionByName(ranked("rising", "rising_score", "recent_arrivals")).select(*_TOPS.split(", "))


@query("obs_listing_history", P.OBS, P.CARDS, P.INPUTS, sql="""SELECT listing_id, turn, run_id, observed_at, sighting_count, o.title, coalesce(o.brand, c.brand) AS brand, coalesce(o.price_amount_cents, c.price_amount_cents) AS price_amount_cents, c.catalog_path, h.observation_count, h.freshness_bucket FROM (
  SELECT listing_id, run_id, min(observed_at) AS observed_at, count(*) AS sighting_count, first(title ORDER BY observed_at, event_id) FILTER (WHERE title IS NOT NULL) AS title, first(brand ORDER BY observed_at, event_id) FILTER (WHERE brand IS NOT NULL) AS brand,
    first(price_amount_cents ORDER BY observed_at, event_id) FILTER (WHERE price_amount_cents IS NOT NULL) AS price_amount_cents, row_number() OVER (PARTITION BY listing_id ORDER BY min(observed_at) DESC, run_id DESC) AS turn FROM sightings GROUP BY listing_id, run_id) o
  JOIN cards c USING (listing_id) JOIN history h USING (listing_id) WHERE turn <= 12""")
def _(spark, d):
    s = D.sightings(spark, d)
    scans = materialize(D.scans(spark, d, s), "scans")
    card = O.histories(s, D.NOW, scans).select("listing_id", "title", "brand", "condition_label", "price_amount_cents", "catalog_path", "root_title", "observation_count", "freshness_bucket")
    rows = O.timeline_rows(O.fold_observations(O.by_listing(s, scans)), card, limit=12)
    return rows.select("listing_id", "turn", "run_id", "observed_at", "sighting_count", "title", "brand", "price_amount_cents", "catalog_path", "observation_count", "freshness_bucket")


_PROBE_BAD = "(p.error_message <> '' OR p.response_status IN (403, 429) OR p.response_status >= 500)"


@query("exp_listing_detail", *STATE, P.SCORES, sql=f"""SELECT s.listing_id, demand_score, premium_score, context_name, state_code, least(observation_count, 12) AS timeline, CASE WHEN bad THEN 'history after a degraded probe' WHEN probe_outcome IN ('active', 'sold', 'deleted', 'unavailable') THEN 'item page' ELSE 'history' END AS state_source,
  CASE WHEN created_at_ts IS NULL THEN 'missing' ELSE 'estimated' END AS publication_kind,
  concat_ws(';', 'first_seen=' || catalog_path, 'last_seen=' || freshness_bucket, CASE WHEN follow_up_miss_count > 0 THEN 'misses=' || follow_up_miss_count END, CASE WHEN probe_outcome IS NOT NULL THEN 'probe=' || CASE WHEN bad THEN 'degraded' ELSE probe_outcome END END, 'state=' || state_code) AS events,
  concat_ws(';', 'state', 'basis', 'confidence', 'freshness', CASE WHEN observation_count = 1 THEN 'single_observation' END, CASE WHEN thin_signal THEN 'thin_signal' END, CASE WHEN price_amount_cents IS NULL THEN 'no_price' END, CASE WHEN probe_outcome IS NOT NULL THEN 'probe' END, CASE WHEN has_estimated_publication THEN 'estimated_publication' END, CASE WHEN price_percentile IS NOT NULL THEN 'price_standing' END) AS reading
  FROM scores s LEFT JOIN (SELECT listing_id, coalesce({_PROBE_BAD}, false) AS bad FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY probed_at DESC, probe_id DESC) AS rn FROM probes) p WHERE rn = 1) USING (listing_id)""")
def _(spark, d):
    s = D.sightings(spark, d)
    scans = materialize(D.scans(spark, d, s), "scans")
    snap = snapshot(spark, d, scans)
    history = O.timelines(O.fold_observations(O.by_listing(s, scans)), snap, limit=12)
    rows = E.listing_detail(SC.score_listings(snap), history, D.NOW)
    joined = lambda c, f: F.array_join(F.transform(c, f), ";").alias(c)
    return rows.select("listing_id", "demand_score", "premium_score", "context_name", "state_code", F.size("timeline").cast("long").alias("timeline"), "provenance.state_source", "provenance.publication_kind", joined("events", lambda e: F.concat(e["kind"], F.lit("="), e["detail"])), joined("reading", lambda r: r["code"]))


_LENSES = """SELECT 'category' AS lens, CAST(catalog_id AS VARCHAR) AS value, catalog_path AS label, * FROM snapshot
  UNION ALL SELECT 'brand', coalesce(brand, 'unknown-brand'), coalesce(brand, 'Unknown brand'), * FROM snapshot
  UNION ALL SELECT 'price_band', price_band_code, CASE price_band_code WHEN 'under' THEN '< 1395' WHEN 'middle' THEN '1395-3123' WHEN 'over' THEN '>= 3124' ELSE 'no price' END, * FROM snapshot
  UNION ALL SELECT 'condition', coalesce(condition_label, 'unknown-condition'), coalesce(condition_label, 'Unknown condition'), * FROM snapshot
  UNION ALL SELECT 'sold_state', state_code, CASE state_code WHEN 'active' THEN 'Active' WHEN 'sold_observed' THEN 'Sold Observed' WHEN 'sold_probable' THEN 'Sold Probable' WHEN 'unavailable_non_conclusive' THEN 'Unavailable Non Conclusive' WHEN 'deleted' THEN 'Deleted' ELSE 'Unknown' END, * FROM snapshot"""
_COMPARED = "lens, value, label, support, share, mean_price, price_sum, priced, sold_like, sold_like_rate, inferred, thin_signal, estimated_publication, low_support, lens_status, drilldown, rank, " + ", ".join(C.STATES)


@query("exp_comparisons", *STATE, sql=f"""SELECT {_COMPARED} FROM (
  SELECT *, CAST(support AS DOUBLE) / sum(support) OVER (PARTITION BY lens) AS share, CAST(price_sum AS DOUBLE) / nullif(priced, 0) AS mean_price, CAST(sold_like AS DOUBLE) / support AS sold_like_rate, support < 3 AS low_support, lens || '=' || value AS drilldown,
    CASE WHEN max(support) OVER (PARTITION BY lens) >= 3 THEN 'ok' ELSE 'thin' END AS lens_status, row_number() OVER (PARTITION BY lens ORDER BY support DESC, label, value) AS rank FROM (
  SELECT lens, value, label, count(*) AS support, count(*) FILTER (WHERE sold_like) AS sold_like, sum(price_amount_cents)::BIGINT AS price_sum, count(price_amount_cents) AS priced, count(*) FILTER (WHERE basis_kind = 'inferred') AS inferred, count(*) FILTER (WHERE thin_signal) AS thin_signal, count(*) FILTER (WHERE has_estimated_publication) AS estimated_publication,
    {", ".join(f"count(*) FILTER (WHERE state_code = '{x}') AS {x}" for x in C.STATES)} FROM ({_LENSES}) GROUP BY lens, value, label)) WHERE rank <= 6""")
def _(spark, d):
    return E.compare_all(snapshot(spark, d), bands=D.BANDS).select(*_COMPARED.split(", "))


@query("exp_compare_by", *STATE, sql=f"SELECT value, label, support, row_number() OVER (ORDER BY support DESC, label, value) AS rank FROM (SELECT value, label, count(*) AS support FROM ({_LENSES}) WHERE lens = 'brand' GROUP BY value, label) ORDER BY rank LIMIT 60")
def _(spark, d):
    return E.compare_by(snapshot(spark, d), "brand", 60, bands=D.BANDS).select("value", "label", "support", "rank")


@query("exp_facet_options", *STATE, sql=f"SELECT lens, value, listings FROM (SELECT lens, value, count(*) AS listings, row_number() OVER (PARTITION BY lens ORDER BY count(*) DESC, max(label), value) AS rank FROM ({_LENSES} UNION ALL SELECT 'root', root_title, root_title, * FROM snapshot) GROUP BY lens, value) WHERE rank <= CASE lens WHEN 'brand' THEN 40 WHEN 'category' THEN 80 ELSE 1000 END")
def _(spark, d):
    return E.facet_options(snapshot(spark, d), bands=D.BANDS).select("lens", "value", "listings")


@query("exp_page", *STATE, sql="SELECT listing_id, price_amount_cents, (SELECT count(*) FROM snapshot WHERE root_title = 'second') AS total_listings FROM snapshot WHERE root_title = 'second' ORDER BY price_amount_cents ASC NULLS LAST, last_seen_at DESC, listing_id DESC LIMIT 30 OFFSET 60")
def _(spark, d):
    return E.explore(snapshot(spark, d), 3, 30, "price_asc", root_title="second")["page"].select("listing_id", "price_amount_cents", "total_listings")


@query("exp_overview", *STATE, sql=f"SELECT {_COUNTS}, " + ", ".join(f"count(*) FILTER (WHERE confidence_label = '{c}') AS {c}_confidence" for c in ("high", "medium", "low")) + ", " + ", ".join(f"count(*) FILTER (WHERE basis_kind = '{b}') AS {b}_basis" for b in ("observed", "inferred", "unknown")) + ", " + ", ".join(f"count(*) FILTER (WHERE freshness_bucket = '{b}') AS {b.replace('-', '_')}" for b in C.FRESHNESS_POINTS) + ", count(*) FILTER (WHERE partial_signal) AS partial_signal, count(*) FILTER (WHERE sold_like) AS sold_like FROM snapshot")
def _(spark, d):
    return E.overview(snapshot(spark, d))


@query("exp_detail_notes", *STATE, sql="SELECT listing_id, concat_ws(',', 'state:' || state_code, CASE WHEN basis_kind = 'inferred' THEN 'inferred' END, CASE WHEN confidence_label = 'low' THEN 'low_confidence' END, CASE WHEN observation_count = 1 THEN 'single_observation' END, CASE WHEN thin_signal THEN 'thin_signal' END, CASE WHEN price_amount_cents IS NULL THEN 'no_price' END, CASE WHEN probe_outcome IS NOT NULL THEN 'has_probe' END, CASE WHEN has_estimated_publication THEN 'estimated_publication' END) AS notes FROM snapshot")
def _(spark, d):
    return E.detail_notes(snapshot(spark, d)).select("listing_id", "notes")


@query("srt_interleave", *STATE, sql="SELECT listing_id, root_title, turn FROM (SELECT *, row_number() OVER (PARTITION BY root_title ORDER BY last_seen_at DESC, listing_id) AS turn FROM history) ORDER BY turn, root_title LIMIT 40")
def _(spark, d):
    s = D.sightings(spark, d)
    return E.interleave(O.history_summaries(O.fold_observations(s), O.latest_cards(s), D.NOW), "root_title", [F.desc("last_seen_at"), F.col("listing_id")], 40).select("listing_id", "root_title", F.col("turn"))


_SUMS = "count(*) AS events, min(observed_at) AS first_at, max(observed_at) AS last_at, sum(price_amount_cents)::BIGINT AS price_sum, count(price_amount_cents) AS price_count, sum(favourite_count)::BIGINT AS likes_sum, count(favourite_count) AS likes_count, sum(view_count)::BIGINT AS views_sum, count(view_count) AS views_count"
_BAND = "CASE WHEN price_amount_cents IS NULL THEN 'unknown' WHEN price_amount_cents < 2000 THEN 'under' WHEN price_amount_cents < 4000 THEN 'middle' ELSE 'over' END AS price_band_code"


@query("agg_rollup_listing_hourly", sql=f"SELECT date_trunc('hour', observed_at)::TIMESTAMP AS hour, listing_id, catalog_id, root_title, catalog_path, brand, condition_label, {_BAND}, {_SUMS} FROM sightings GROUP BY ALL")
def _(spark, d):
    return R.rollup_listing_hourly(D.sightings(spark, d))


@query("agg_rollup_listing_daily", sql=f"SELECT day, listing_id, catalog_id, root_title, catalog_path, brand, condition_label, {_BAND}, {_SUMS} FROM sightings GROUP BY ALL")
def _(spark, d):
    return R.rollup_listing_daily(D.sightings(spark, d))


@query("agg_rollup_category_daily", sql=f"SELECT day, catalog_id, root_title, catalog_path, {_SUMS}, count(DISTINCT listing_id) AS listings FROM sightings GROUP BY ALL")
def _(spark, d):
    return R.rollup_category_daily(D.sightings(spark, d))


@query("agg_rollup_brand_daily", sql=f"SELECT day, catalog_id, root_title, brand, {_SUMS}, count(DISTINCT listing_id) AS listings FROM sightings GROUP BY ALL")
def _(spark, d):
    return R.rollup_brand_daily(D.sightings(spark, d))


@query("agg_rerollup_monthly", sql=f"SELECT date_trunc('month', observed_at)::DATE AS month, catalog_id, {_SUMS}, count(DISTINCT listing_id) AS listings FROM sightings GROUP BY ALL")
def _(spark, d):
    return R.rerollup(R.rollup_listing_daily(D.sightings(spark, d)), F.trunc("day", "month").alias("month"), ("catalog_id",))


@query("mart_listing_day", sql=f"SELECT day, listing_id, brand, {_BAND}, {_SUMS}, CAST(sum(price_amount_cents) AS DOUBLE) / nullif(count(price_amount_cents), 0) AS avg_price, array_to_string(list_sort(list_distinct(list(run_id))), ',') AS runs FROM sightings GROUP BY ALL")
def _(spark, d):
    names = "day, listing_id, brand, price_band_code, events, first_at, last_at, price_sum, price_count, likes_sum, likes_count, views_sum, views_count, avg_price".split(", ")
    return R.mart_listing_day(D.sightings(spark, d)).select(*names, F.array_join("run_ids", ",").alias("runs"))


@query("mart_segment_day", sql=f"SELECT day, 'category' AS lens, CAST(catalog_id AS VARCHAR) AS segment, {_SUMS}, count(DISTINCT listing_id) AS listings, array_to_string(list_sort(list_distinct(list(manifest_id))), ',') AS manifests FROM sightings GROUP BY ALL UNION ALL SELECT day, 'brand', brand, {_SUMS}, count(DISTINCT listing_id), array_to_string(list_sort(list_distinct(list(manifest_id))), ',') FROM sightings GROUP BY ALL")
def _(spark, d):
    names = "day, lens, segment, events, first_at, last_at, price_sum, price_count, likes_sum, likes_count, views_sum, views_count, listings".split(", ")
    return R.mart_segment_day(D.sightings(spark, d)).select(*names, F.array_join("manifest_ids", ",").alias("manifests"))


@query("src_retention", sql="SELECT event_id FROM sightings WHERE observed_at >= TIMESTAMP '2001-11-05' - INTERVAL 730 DAYS")
def _(spark, d):
    return R.apply_retention(D.sightings(spark, d), "observed_at", C.FACT_DAYS, D.NOW).select("event_id")


@query("agg_scan_telemetry", sql="SELECT run_id, catalog_id, page_number, count(*) AS listing_count, count(*) FILTER (WHERE price_amount_cents >= 150000) AS accepted, min(price_amount_cents) AS min_price_cents, max(price_amount_cents) AS max_price_cents, count(*) - count(*) FILTER (WHERE price_amount_cents >= 150000) AS filtered, CAST(count(*) FILTER (WHERE price_amount_cents >= 150000) AS DOUBLE) / count(*) AS accepted_ratio FROM sightings GROUP BY 1, 2, 3")
def _(spark, d):
    return O.scan_telemetry(D.sightings(spark, d), F.col("price_amount_cents") >= 150_000)


@query("agg_run_totals", sql="SELECT run_id, s.scans, successful_scans, raw_hits, unique_hits FROM (SELECT run_id, count(*) AS scans, count(*) FILTER (WHERE success) AS successful_scans, sum(listing_count)::BIGINT AS raw_hits FROM scans GROUP BY 1) s LEFT JOIN (SELECT run_id, count(DISTINCT listing_id) AS unique_hits FROM sightings GROUP BY 1) USING (run_id)")
def _(spark, d):
    return O.run_totals(D.scans(spark, d), D.sightings(spark, d))


@query("agg_coverage_summary", sql="SELECT root_title, count(DISTINCT catalog_id) AS leaf_catalogs, count(DISTINCT catalog_id) FILTER (WHERE run_id = '1999-05') AS scanned_catalogs, count(DISTINCT catalog_id) FILTER (WHERE run_id = '1999-05' AND catalog_id <> 1003) AS successful_scans, count(DISTINCT catalog_id) FILTER (WHERE run_id = '1999-05' AND catalog_id = 1003) AS failed_scans, count(*) FILTER (WHERE run_id = '1999-05') AS sightings, count(DISTINCT listing_id) FILTER (WHERE run_id = '1999-05') AS listings FROM sightings GROUP BY 1")
def _(spark, d):
    return O.coverage_summary(D.catalogs(spark, d), D.scans(spark, d), D.sightings(spark, d), "1999-05")


@query("agg_listing_timeline", sql="SELECT listing_id, run_id, count(*) AS sightings, last(event_id ORDER BY observed_at, event_id) AS event_id, last(price_amount_cents ORDER BY observed_at, event_id) AS price_amount_cents, last(view_count ORDER BY observed_at, event_id) AS view_count FROM sightings GROUP BY 1, 2")
def _(spark, d):
    return O.listing_timeline(D.sightings(spark, d)).select("listing_id", "run_id", "sightings", "event_id", "price_amount_cents", "view_count")


@query("agg_derive_scan_runs", sql="SELECT catalog_id, run_id, max(observed_at) AS fetched_at, count(DISTINCT listing_id) AS listing_count FROM sightings GROUP BY 1, 2")
def _(spark, d):
    return O.derive_scan_runs(D.sightings(spark, d))


@query("chg_event_log", P.LOG, sql='''SELECT listing_id, "at", event_kind, source_id, run_id, price_amount_cents, probe_outcome FROM log''')
def _(spark, d):
    return log(spark, d).select("listing_id", "at", "event_kind", "source_id", "run_id", "price_amount_cents", "probe_outcome")


@query("chg_derive_changes", P.LOG, sql='''SELECT listing_id, "at", source_id, change_kind, state_code, misses, now_price AS price FROM changes''')
def _(spark, d):
    return changes(spark, d).select("listing_id", "at", "source_id", "change_kind", "state_code", "misses", F.col("now_price_amount_cents").alias("price"))


@query("mart_price_change", P.LOG, sql='''SELECT listing_id, "at", source_id, b_price AS price_before, now_price AS price_after, now_price - b_price AS price_delta, now_total - b_total AS total_price_delta FROM changes WHERE change_kind = 'price_change' ''')
def _(spark, d):
    return price_changes(spark, d)


@query("mart_state_transition", P.LOG, sql='''SELECT listing_id, "at", source_id, coalesce(b_state, 'none') || ' → ' || state_code AS transition, CASE WHEN score >= 80 THEN 'high' WHEN score >= 55 THEN 'medium' ELSE 'low' END AS confidence_label, event_kind = 'miss' AS missing_from_scan FROM changes WHERE change_kind = 'state_transition' ''')
def _(spark, d):
    s = D.sightings(spark, d)
    return transitions(s, materialize(D.scans(spark, d, s), "scans"), D.probes(spark, d))


@query("prj_change_summary", P.LOG, sql="SELECT listing_id, source_id, change_kind, CASE change_kind WHEN 'price_change' THEN 'price ' || coalesce(CAST(b_price AS VARCHAR), 'n/a') || ' to ' || coalesce(CAST(now_price AS VARCHAR), 'n/a') WHEN 'engagement_shift' THEN 'likes ' || coalesce(CAST(b_likes AS VARCHAR), 'n/a') || ' to ' || coalesce(CAST(now_likes AS VARCHAR), 'n/a') WHEN 'follow_up_miss_transition' THEN 'misses ' || b_misses || ' to ' || misses ELSE 'state ' || coalesce(b_state, 'none') || ' to ' || state_code END AS change_summary FROM changes")
def _(spark, d):
    return CH.with_change_summary(changes(spark, d)).select("listing_id", "source_id", "change_kind", "change_summary")


@query("mart_evidence_packs", *STATE, P.LOG, sql="SELECT listing_id, state_code, days, price_changes, state_transitions FROM snapshot LEFT JOIN (SELECT listing_id, count(*) AS days FROM (SELECT DISTINCT listing_id, day, brand, condition_label, " + _BAND + " FROM sightings) GROUP BY 1) USING (listing_id) LEFT JOIN (SELECT listing_id, count(*) AS price_changes FROM changes WHERE change_kind = 'price_change' GROUP BY 1) USING (listing_id) LEFT JOIN (SELECT listing_id, count(*) AS state_transitions FROM changes WHERE change_kind = 'state_transition' GROUP BY 1) USING (listing_id)")
def _(spark, d):
    packs = packs_of_all(spark, d)
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c).cast("long")).alias(c)
    return packs.select("listing_id", "state_code", n("days"), n("price_changes"), n("state_transitions"))

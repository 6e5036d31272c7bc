"""The domain tables and folds in SQL, shared by the oracle queries as common table expressions."""

S = """
sightings AS (
  SELECT *, price_amount_cents + (price_amount_cents * tax) // 100 AS total_price_amount_cents,
    CASE WHEN catalog_id <= 1003 THEN 'first' ELSE 'second' END AS root_title,
    CAST(CASE WHEN catalog_id <= 1003 THEN 1 ELSE 2 END AS BIGINT) AS root_catalog_id,
    CASE WHEN catalog_id <= 1003 THEN 'first' ELSE 'second' END || ' > ' || lower(p_type) AS catalog_path,
    'm-' || run_id AS manifest_id, CAST(observed_at AS DATE) AS day
  FROM (SELECT l_partkey * 4 + l_suppkey % 4 AS listing_id, strftime(l_shipdate, '%Y-%m') AS run_id, l_shipdate AS observed_at,
      concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(epoch(l_shipdate) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS event_id,
      CAST(CASE p_type WHEN 'ECONOMY' THEN 1001 WHEN 'LARGE' THEN 1002 WHEN 'MEDIUM' THEN 1003 WHEN 'PROMO' THEN 1004 WHEN 'SMALL' THEN 1005 ELSE 1006 END AS BIGINT) AS catalog_id,
      p_type, p_name AS title, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS brand,
      CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size < 17 THEN 'new' WHEN p_size < 34 THEN 'good' ELSE 'worn' END AS condition_label,
      'S' || (p_size % 5) AS size_label, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'https://img.example/' || l_partkey END AS image_url,
      CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) END AS price_amount_cents,
      CAST(round(l_tax * 100) AS BIGINT) AS tax, CAST(l_quantity AS BIGINT) AS favourite_count,
      CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(l_linenumber * 10 AS BIGINT) END AS view_count,
      l_suppkey AS user_id, l_linenumber AS page_number, l_orderkey % 96 AS card_position,
      CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE CAST(epoch(l_shipdate) AS BIGINT) - 86400 * l_linenumber END AS created_at_ts
    FROM lineitem JOIN part ON l_partkey = p_partkey)),
scans AS (
  SELECT catalog_id, run_id, 1 AS page_number, max(observed_at) AS fetched_at, catalog_id <> 1003 AS success,
    CASE WHEN catalog_id <> 1003 THEN 200 ELSE 403 END AS response_status,
    CASE WHEN catalog_id <> 1003 THEN NULL ELSE 'blocked by challenge' END AS error_message, count(*) AS listing_count
  FROM sightings GROUP BY catalog_id, run_id),
probes AS (
  SELECT event_id AS probe_id, user_id * 4 AS listing_id,
    CASE event_type WHEN 'purchase' THEN 'sold' WHEN 'view' THEN 'active' WHEN 'click' THEN 'active' WHEN 'signup' THEN 'unavailable' ELSE 'unknown' END AS probe_outcome,
    ts - to_days(CAST(8100 + 30 * (user_id % 60) AS INTEGER)) AS probed_at,
    CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 403 ELSE 503 END ELSE 200 END AS response_status,
    CASE WHEN event_type = 'error' THEN 'challenge_page' ELSE event_type END AS reason,
    CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'timeout' END AS error_message, props
  FROM events)"""

OBS = """,
obs AS (
  SELECT run_id, listing_id, min(observed_at) AS observed_at, count(*) AS sighting_count, min(card_position) AS card_position
  FROM sightings GROUP BY run_id, listing_id),
gaps AS (SELECT *, epoch_us(observed_at) - epoch_us(lag(observed_at) OVER (PARTITION BY listing_id ORDER BY observed_at, run_id)) AS gap FROM obs),
summary AS (
  SELECT listing_id, count(*) AS observation_count, CAST(sum(sighting_count) AS BIGINT) AS total_sightings, min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at,
    min(run_id) AS first_run_id, max(run_id) AS last_observed_run_id, CAST(sum(gap) AS DOUBLE) / 3.6e9 / nullif(count(gap), 0) AS mean_revisit_hours
  FROM gaps GROUP BY listing_id)"""

_CARD = ("title", "brand", "size_label", "condition_label", "price_amount_cents", "total_price_amount_cents", "image_url", "favourite_count", "view_count", "user_id", "created_at_ts", "catalog_id", "catalog_path", "root_title")
CARDS = """,
cards AS (
  SELECT listing_id, min(observed_at) AS first_discovered_at, """ + ", ".join(f"last({c} ORDER BY observed_at, event_id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _CARD) + """
  FROM sightings GROUP BY listing_id)"""

AGE = "greatest(0.0, (epoch_us(TIMESTAMP '2001-11-05') - epoch_us(last_seen_at)) / 3.6e9)"
SIGNAL = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in ("title", "brand", "size_label", "condition_label", "price_amount_cents", "total_price_amount_cents", "image_url"))
INPUTS = f""",
history AS (
  SELECT *, CASE WHEN observation_count <= 1 THEN 'first-pass-only' WHEN last_seen_age_hours <= 24 THEN 'fresh-followup' WHEN last_seen_age_hours <= 72 THEN 'aging-followup' ELSE 'stale-followup' END AS freshness_bucket,
    signal_completeness < 7 AS partial_signal, signal_completeness < 5 AS thin_signal, created_at_ts IS NOT NULL AS has_estimated_publication
  FROM (SELECT *, {AGE} AS last_seen_age_hours, {SIGNAL} AS signal_completeness FROM summary JOIN cards USING (listing_id))),
misses AS (
  SELECT h.listing_id, count(DISTINCT c.run_id) AS follow_up_miss_count, max(c.fetched_at) AS latest_miss_at
  FROM history h JOIN scans c ON c.catalog_id = h.catalog_id AND c.success AND c.fetched_at > h.last_seen_at
  LEFT JOIN obs o ON o.listing_id = h.listing_id AND o.run_id = c.run_id WHERE o.run_id IS NULL GROUP BY h.listing_id),
last_scan AS (SELECT catalog_id, last(run_id ORDER BY fetched_at, run_id) AS latest_primary_scan_run_id FROM scans WHERE success GROUP BY catalog_id),
last_probe AS (
  SELECT listing_id, probe_outcome, probed_at, response_status AS probe_status
  FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY probed_at DESC, probe_id DESC) AS rn FROM probes) WHERE rn = 1),
inputs AS (
  SELECT h.*, coalesce(m.follow_up_miss_count, 0) AS follow_up_miss_count, m.latest_miss_at, s.latest_primary_scan_run_id, p.probe_outcome, p.probed_at, p.probe_status,
    coalesce(s.latest_primary_scan_run_id = h.last_observed_run_id, false) AS seen_in_latest_primary_scan
  FROM history h LEFT JOIN misses m USING (listing_id) LEFT JOIN last_scan s USING (catalog_id) LEFT JOIN last_probe p USING (listing_id))"""

_RULES = (
    ("probe_outcome = 'deleted'", "deleted", "observed", 0.97), ("probe_outcome = 'sold'", "sold_observed", "observed", 0.91), ("probe_outcome = 'active'", "active", "observed", 0.95),
    ("probe_outcome = 'unavailable'", "unavailable_non_conclusive", "observed", 0.62), ("seen_in_latest_primary_scan", "active", "observed", 0.9), ("follow_up_miss_count > 2", "sold_probable", "inferred", 0.82),
    ("follow_up_miss_count = 2", "sold_probable", "inferred", 0.72), ("follow_up_miss_count = 1", "unavailable_non_conclusive", "inferred", 0.46),
    ("latest_primary_scan_run_id IS NULL AND last_seen_age_hours <= 24", "active", "inferred", 0.58), ("last_seen_age_hours > 72", "unknown", "unknown", 0.24), ("true", "unknown", "unknown", 0.32),
)


def _chain(i: int) -> str:
    return "CASE " + " ".join(f"WHEN {r[0]} THEN " + (f"'{r[i]}'" if isinstance(r[i], str) else f"CAST({r[i]} AS DOUBLE)") for r in _RULES) + " END"


SNAPSHOT = f""",
snapshot AS (
  SELECT *, CASE WHEN confidence_score >= 0.8 THEN 'high' WHEN confidence_score >= 0.55 THEN 'medium' ELSE 'low' END AS confidence_label,
    state_code IN ('sold_observed', 'sold_probable') AS sold_like,
    CASE WHEN price_amount_cents IS NULL THEN 'unknown' WHEN price_amount_cents < 139500 THEN 'under' WHEN price_amount_cents < 312400 THEN 'middle' ELSE 'over' END AS price_band_code
  FROM (SELECT *, {_chain(1)} AS state_code, {_chain(2)} AS basis_kind, {_chain(3)} AS confidence_score FROM inputs))"""

DEMAND = """,
demand AS (
  SELECT *, least(100.0, CASE state_code WHEN 'active' THEN 18.0 WHEN 'sold_observed' THEN 90.0 WHEN 'sold_probable' THEN 74.0 WHEN 'unavailable_non_conclusive' THEN 42.0 WHEN 'deleted' THEN 24.0 ELSE 10.0 END
    + CASE confidence_label WHEN 'high' THEN 12.0 WHEN 'medium' THEN 7.0 ELSE 2.0 END + CASE basis_kind WHEN 'observed' THEN 8.0 WHEN 'inferred' THEN 3.0 ELSE 0.0 END
    + CASE freshness_bucket WHEN 'fresh-followup' THEN 10.0 WHEN 'aging-followup' THEN 6.0 WHEN 'stale-followup' THEN 2.0 ELSE 4.0 END
    + least((observation_count - 1) * 4.0, 12.0) + least(follow_up_miss_count * 6.0, 18.0))::DOUBLE AS demand_score
  FROM snapshot)"""

_CTX = (("catalog_brand_condition", 4, ("catalog_id", "brand", "condition_label")), ("catalog_condition", 5, ("catalog_id", "condition_label")), ("catalog_brand", 5, ("catalog_id", "brand")), ("catalog", 8, ("catalog_id",)), ("root_condition", 10, ("root_title", "condition_label")), ("root", 20, ("root_title",)))
_N = ", ".join(f"count(price_amount_cents) OVER (PARTITION BY {', '.join(f)}) AS n_{n}" for n, _, f in _CTX)
_BELOW = ", ".join(f"rank() OVER (PARTITION BY price_amount_cents IS NULL, {', '.join(f)} ORDER BY price_amount_cents) - 1 AS b_{n}, count(*) OVER (PARTITION BY price_amount_cents, {', '.join(f)}) AS e_{n}" for n, _, f in _CTX)
_PICK = lambda p: "CASE " + " ".join(f"WHEN price_amount_cents IS NOT NULL AND n_{n} >= {k} THEN {p.replace('@', n)}" for n, k, _ in _CTX) + " END"
SCORES = DEMAND + f""",
scores AS (
  SELECT *, round(demand_score * CASE WHEN context_name IS NULL THEN 0.85 ELSE 0.78 END + coalesce(round(greatest(0.0, (price_percentile - 0.5) / 0.5) * 100, 2) * 0.22, 0), 2) AS premium_score
  FROM (SELECT *, round(CAST(below * 2 + equal AS DOUBLE) / (context_size * 2), 3) AS price_percentile
    FROM (SELECT *, {_PICK("'@'")} AS context_name, {_PICK("n_@")} AS context_size, {_PICK("b_@")} AS below, {_PICK("e_@")} AS equal
      FROM (SELECT *, {_N}, {_BELOW} FROM demand))))"""

LOG = """,
seen AS (
  SELECT listing_id, observed_at AS "at", 'seen' AS event_kind, event_id AS source_id, run_id, price_amount_cents, total_price_amount_cents, favourite_count, view_count, NULL AS probe_outcome
  FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, run_id ORDER BY observed_at DESC, event_id DESC) AS rn FROM sightings) WHERE rn = 1),
home AS (SELECT listing_id, min(observed_at) AS since, any_value(catalog_id) AS catalog_id FROM sightings GROUP BY listing_id),
missed AS (
  SELECT h.listing_id, c.fetched_at AS "at", 'miss' AS event_kind, 'miss-' || c.run_id AS source_id, c.run_id, NULL, NULL, NULL, NULL, NULL
  FROM home h JOIN scans c ON c.catalog_id = h.catalog_id AND c.success AND c.fetched_at > h.since LEFT JOIN seen s ON s.listing_id = h.listing_id AND s.run_id = c.run_id WHERE s.run_id IS NULL),
log AS (
  SELECT * FROM seen UNION ALL SELECT * FROM missed
  UNION ALL SELECT listing_id, probed_at, 'probe', 'probe-' || probe_id, NULL, NULL, NULL, NULL, NULL, probe_outcome FROM probes WHERE listing_id IN (SELECT listing_id FROM home)),
ordered AS (
  SELECT *, CASE event_kind WHEN 'seen' THEN 0 WHEN 'miss' THEN 1 ELSE 2 END AS k FROM log),
epochs AS (
  SELECT *, count(*) FILTER (WHERE k = 0) OVER w AS epoch, last_value(probe_outcome IGNORE NULLS) OVER w AS last_probe FROM ordered
  WINDOW w AS (PARTITION BY listing_id ORDER BY "at", k, source_id ROWS UNBOUNDED PRECEDING)),
running AS (
  SELECT *, count(*) FILTER (WHERE k = 1) OVER w AS misses, first_value(price_amount_cents) OVER w AS now_price, first_value(total_price_amount_cents) OVER w AS now_total,
    first_value(favourite_count) OVER w AS now_likes, first_value(view_count) OVER w AS now_views
  FROM epochs WHERE epoch > 0 WINDOW w AS (PARTITION BY listing_id, epoch ORDER BY "at", k, source_id ROWS UNBOUNDED PRECEDING)),
stated AS (
  SELECT *, CASE WHEN last_probe = 'deleted' THEN 'deleted' WHEN last_probe = 'sold' THEN 'sold_observed' WHEN last_probe = 'active' THEN 'active' WHEN last_probe = 'unavailable' THEN 'unavailable_non_conclusive' WHEN misses = 0 THEN 'active' WHEN misses >= 2 THEN 'sold_probable' ELSE 'unavailable_non_conclusive' END AS state_code,
    CASE WHEN last_probe = 'deleted' THEN 97 WHEN last_probe = 'sold' THEN 91 WHEN last_probe = 'active' THEN 95 WHEN last_probe = 'unavailable' THEN 62 WHEN misses = 0 THEN 90 WHEN misses = 2 THEN 72 WHEN misses > 2 THEN 82 ELSE 46 END AS score
  FROM running),
pairs AS (
  SELECT *, lag(state_code) OVER w AS b_state, lag(score) OVER w AS b_score, lag(now_price) OVER w AS b_price, lag(now_total) OVER w AS b_total, lag(now_likes) OVER w AS b_likes, lag(now_views) OVER w AS b_views, lag(misses) OVER w AS b_misses,
    row_number() OVER w = 1 AS is_first
  FROM stated WINDOW w AS (PARTITION BY listing_id ORDER BY "at", k, source_id)),
changes AS (
  SELECT *, 'state_transition' AS change_kind FROM pairs WHERE is_first OR state_code <> b_state OR score <> b_score
  UNION ALL SELECT *, 'price_change' FROM pairs WHERE NOT is_first AND (now_price IS DISTINCT FROM b_price OR now_total IS DISTINCT FROM b_total)
  UNION ALL SELECT *, 'engagement_shift' FROM pairs WHERE NOT is_first AND (now_likes IS DISTINCT FROM b_likes OR now_views IS DISTINCT FROM b_views)
  UNION ALL SELECT *, 'follow_up_miss_transition' FROM pairs WHERE NOT is_first AND misses <> b_misses)"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + S + "".join(parts) + "\n" + select

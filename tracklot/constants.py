"""Values that are part of the semantics."""

# Thresholds, scores, labels and orders that results depend on.
FRESH_HOURS, STALE_HOURS = 24, 72
FULL_SIGNAL, HIGH_SIGNAL = 7, 5
COMPARISON_LIMIT, SUPPORT_THRESHOLD = 6, 3
PRICE_BAND_CENTS = (2000, 4000)
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 0.80, 0.55
STATES = ("active", "sold_observed", "sold_probable", "unavailable_non_conclusive", "deleted", "unknown")
STATE_POINTS = {"active": 18.0, "sold_observed": 90.0, "sold_probable": 74.0, "unavailable_non_conclusive": 42.0, "deleted": 24.0, "unknown": 10.0}
CONFIDENCE_POINTS = {"high": 12.0, "medium": 7.0, "low": 2.0}
BASIS_POINTS = {"observed": 8.0, "inferred": 3.0, "unknown": 0.0}
FRESHNESS_POINTS = {"fresh-followup": 10.0, "aging-followup": 6.0, "stale-followup": 2.0, "first-pass-only": 4.0}
PEER_CONTEXTS = (
    ("catalog_brand_condition", 4, ("catalog_id", "brand", "condition_label")),
    ("catalog_condition", 5, ("catalog_id", "condition_label")),
    ("catalog_brand", 5, ("catalog_id", "brand")),
    ("catalog", 8, ("catalog_id",)),
    ("root_condition", 10, ("root_title", "condition_label")),
    ("root", 20, ("root_title",)),
)
CONDITIONS = {1: "Neuf avec étiquette", 2: "Neuf sans étiquette", 3: "Très bon état", 4: "Bon état", 5: "Satisfaisant", 6: "Mauvais état"}
CURRENCY_SYMBOLS = {"EUR": "€", "GBP": "£", "USD": "$"}
# Signs of a challenge in a page, and in a scan's error message.
CHALLENGE_MARKERS = ("just a moment", "attention required", "turnstile", "cf-chl", "challenge-platform", "verify you are human", "captcha", "cloudflare")
SCAN_MARKERS = ("captcha", "challenge", "turnstile", "cloudflare", "attention required", "just a moment", "__cf_chl")
# From where on scores and percentiles are shown under a name.
SCORE_BANDS = ((80.0, "very_strong"), (60.0, "solid"), (40.0, "medium"))
PERCENTILE_BANDS = ((0.85, "high"), (0.65, "above_middle"), (0.35, "middle"))
FACT_DAYS, ROLLUP_DAYS = 730, 3650
#: Fields whose presence makes up a listing's signal.
SIGNAL_FIELDS = ("title", "brand", "size_label", "condition_label", "price_amount_cents", "total_price_amount_cents", "image_url")

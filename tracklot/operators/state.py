"""State classification: eleven ordered rules over a listing's evidence, as shared conditions of a few ``when`` chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklot import constants as C
from tracklot.functions.columns import age_hours, confidence_label, is_sold_like, price_band, price_band_order, state_label, state_order


def rules(probe_max_age_hours: float | None = None) -> list[tuple[Column, str, str, float, Column]]:
    """(condition, state, basis, confidence, reason), first match wins. A probe counts whatever its age unless a limit is given."""
    probe = F.col("probe_outcome")
    if probe_max_age_hours is not None:
        probe = F.when(F.col("probe_age_hours") <= probe_max_age_hours, probe)
    misses, age = F.coalesce("follow_up_miss_count", F.lit(0)), F.coalesce("last_seen_age_hours", F.lit(0.0))
    text = lambda s: F.lit(s)
    return [
        (probe == "deleted", "deleted", "observed", 0.97, F.format_string("probe shows deletion (%s)", F.col("probe_status").cast("string"))),
        (probe == "sold", "sold_observed", "observed", 0.91, text("probe shows it cannot be bought any more")),
        (probe == "active", "active", "observed", 0.95, text("probe shows it can be bought")),
        (probe == "unavailable", "unavailable_non_conclusive", "observed", 0.62, text("probe shows it unavailable without a clear sign")),
        (F.col("seen_in_latest_primary_scan"), "active", "observed", 0.90, text("seen in its catalog's latest scan that worked")),
        (misses > 2, "sold_probable", "inferred", 0.82, F.format_string("missing from %s later scans", misses.cast("string"))),
        (misses == 2, "sold_probable", "inferred", 0.72, text("missing from 2 later scans")),
        (misses == 1, "unavailable_non_conclusive", "inferred", 0.46, text("missing from one later scan")),
        (F.col("latest_primary_scan_run_id").isNull() & (age <= C.FRESH_HOURS), "active", "inferred", 0.58, text("seen lately, no newer scan")),
        (age > C.STALE_HOURS, "unknown", "unknown", 0.24, text("last seen too long ago")),
        (F.lit(True), "unknown", "unknown", 0.32, text("too little evidence")),
    ]


def classify_state(df: DataFrame, probe_max_age_hours: float | None = None) -> DataFrame:
    """Add state_code, basis_kind, confidence_score and confidence_label."""
    found = None
    for condition, state, basis, score, _ in rules(probe_max_age_hours):
        value = F.struct(F.lit(state).alias("state_code"), F.lit(basis).alias("basis_kind"), F.lit(score).alias("confidence_score"))
        found = F.when(condition, value) if found is None else found.when(condition, value)
    return df.withColumn("_s", found).select("*", "_s.*").drop("_s").withColumn("confidence_label", confidence_label("confidence_score"))


def with_state_explanation(df: DataFrame) -> DataFrame:
    first = None
    for condition, _, _, _, reason in rules():
        first = F.when(condition, reason) if first is None else first.when(condition, reason)
    notes = F.array_compact(F.array(F.when(F.col("probe_outcome") == "unknown", "the latest probe says nothing"), first, F.when((F.col("follow_up_miss_count") >= 2) & (F.col("observation_count") >= 2), "seen repeatedly before it went missing")))
    return df.withColumn("state_explanation", F.struct(notes.alias("reasons"), "follow_up_miss_count", "last_seen_age_hours", F.col("probe_outcome").alias("latest_probe_outcome")))


def with_state_display(df: DataFrame) -> DataFrame:
    return df.withColumns({"state_label": state_label("state_code"), "state_sort_order": state_order("state_code"), "sold_like": is_sold_like("state_code")})


def classified_snapshot(inputs: DataFrame, now, bands: tuple[int, int] = C.PRICE_BAND_CENTS, probe_max_age_hours: float | None = None) -> DataFrame:
    """State inputs with state, display columns and price band; persist it before several questions are asked of it."""
    if probe_max_age_hours is not None:
        inputs = inputs.withColumn("probe_age_hours", age_hours("probed_at", now))
    out = with_state_display(classify_state(inputs, probe_max_age_hours))
    return out.withColumns({"price_band_code": price_band("price_amount_cents", bands), "price_band_sort_order": price_band_order("price_amount_cents", bands)})


def state_counts(df: DataFrame, *keys: str) -> DataFrame:
    counts = [F.count_if(F.col("state_code") == s).alias(s) for s in C.STATES]
    counts += [F.count_if(F.col("confidence_label") == c).alias(f"{c}_confidence") for c in ("high", "medium", "low")]
    counts += [F.count_if(F.col("basis_kind") == b).alias(f"{b}_basis") for b in ("observed", "inferred", "unknown")]
    return df.groupBy(*keys).agg(F.count("*").alias("tracked_listings"), *counts)


def state_summary(df: DataFrame) -> DataFrame:
    """Overall (root_title null) and by root, in one pass."""
    named = df.withColumn("root_title", F.coalesce("root_title", F.lit("Unknown")))
    counts = [F.count_if(F.col("state_code") == s).alias(s) for s in C.STATES]
    return named.rollup("root_title").agg(F.count("*").alias("tracked_listings"), *counts, F.count_if(F.col("confidence_label") == "high").alias("high_confidence"), F.count_if(F.col("basis_kind") == "inferred").alias("inferred_basis"))


def freshness_summary(df: DataFrame) -> DataFrame:
    named = df.withColumn("root_title", F.coalesce("root_title", F.lit("Unknown")))
    counts = [F.count_if(F.col("freshness_bucket") == b).alias(b.replace("-", "_")) for b in C.FRESHNESS_POINTS]
    return named.rollup("root_title").agg(F.count("*").alias("tracked_listings"), *counts)

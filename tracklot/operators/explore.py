"""Explorer and overview: comparison lenses, facets, sorted pages, summaries of a slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklot import constants as C
from tracklot.functions.columns import filter_listings, is_sold_like, price_band, price_band_label, probe_is_degraded, safe_ratio, search_listings, state_label
from tracklot.operators.score import with_score_explanation
from tracklot.operators.state import state_counts, with_state_explanation

LENSES = ("category", "brand", "price_band", "condition", "sold_state")


def _lens_rows(df: DataFrame, bands: tuple[int, int], roots: bool = False) -> DataFrame:
    """Every listing once per lens, as (lens, value, label): one scan and one aggregate serve all lenses.

    Codes and labels of price bands come from the same limits, whatever code the rows carry.
    """
    text = lambda c: F.col(c).cast("string")
    entry = lambda lens, value, label: F.struct(F.lit(lens).alias("lens"), value.alias("value"), label.alias("label"))
    return df.withColumn("_l", F.explode(F.array(
        entry("category", text("catalog_id"), F.col("catalog_path")),
        entry("brand", F.coalesce("brand", F.lit("unknown-brand")), F.coalesce("brand", F.lit("Unknown brand"))),
        entry("price_band", price_band("price_amount_cents", bands), price_band_label("price_amount_cents", bands)),
        entry("condition", F.coalesce("condition_label", F.lit("unknown-condition")), F.coalesce("condition_label", F.lit("Unknown condition"))),
        entry("sold_state", F.col("state_code"), state_label("state_code")),
        *([entry("root", F.col("root_title"), F.col("root_title"))] if roots else []),
    ))).select("*", "_l.lens", "_l.value", "_l.label").drop("_l")


def compare_all(df: DataFrame, limit: int = C.COMPARISON_LIMIT, threshold: int = C.SUPPORT_THRESHOLD, bands: tuple[int, int] = C.PRICE_BAND_CENTS) -> DataFrame:
    """Support, share, mean price, states, sold-like and honesty counts of each lens's largest values."""
    rows = _lens_rows(df, bands).groupBy("lens", "value", "label").agg(
        F.count("*").alias("support"), F.sum("price_amount_cents").alias("price_sum"), F.count("price_amount_cents").alias("priced"),
        F.count_if(is_sold_like("state_code")).alias("sold_like"), F.count_if(F.col("basis_kind") == "inferred").alias("inferred"),
        F.count_if("thin_signal").alias("thin_signal"), F.count_if("has_estimated_publication").alias("estimated_publication"),
        *[F.count_if(F.col("state_code") == s).alias(s) for s in C.STATES],
    )
    share = F.col("support") / F.sum("support").over(Window.partitionBy("lens"))
    rank = F.row_number().over(Window.partitionBy("lens").orderBy(F.desc("support"), "label", "value"))
    out = rows.withColumns({"share": share, "rank": rank}).where(F.col("rank") <= limit)
    best = F.max("support").over(Window.partitionBy("lens"))
    return out.withColumns({
        "mean_price": safe_ratio("price_sum", "priced"),
        "sold_like_rate": F.col("sold_like") / F.col("support"),
        "low_support": F.col("support") < threshold,
        "lens_status": F.when(best >= threshold, "ok").otherwise("thin"),
        "drilldown": F.concat("lens", F.lit("="), "value"),
    })


def compare_by(df: DataFrame, lens: str, limit: int = C.COMPARISON_LIMIT, threshold: int = C.SUPPORT_THRESHOLD, bands: tuple[int, int] = C.PRICE_BAND_CENTS) -> DataFrame:
    if lens not in LENSES:
        raise ValueError(f"lens must be one of {', '.join(LENSES)}")
    return compare_all(df, limit, threshold, bands).where(F.col("lens") == lens)


def facet_options(df: DataFrame, limits: dict[str, int] | None = None, bands: tuple[int, int] = C.PRICE_BAND_CENTS) -> DataFrame:
    """Values of each facet, roots too, with counts; catalogs are cut at 80 and brands at 40."""
    limits = limits or {"category": 80, "brand": 40}
    counts = _lens_rows(df, bands, roots=True).groupBy("lens", "value", "label").agg(F.count("*").alias("listings"))
    rank = F.row_number().over(Window.partitionBy("lens").orderBy(F.desc("listings"), "label", "value"))
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("lens")), F.lit(2**31 - 1))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)


SORTS = {
    "last_seen_desc": ("desc", "last_seen_at"),
    "price_desc": ("desc", "price_amount_cents"),
    "price_asc": ("asc", "price_amount_cents"),
    "favourite_desc": ("desc", "favourite_count"),
    "view_desc": ("desc", "view_count"),
    "created_at_desc": ("desc", "created_at_ts"),
    "first_seen_desc": ("desc", "first_seen_at"),
}


def sort_listings(df: DataFrame, mode: str = "last_seen_desc") -> DataFrame:
    """Nulls last; ties by last sighting, then id, both descending."""
    way, column = SORTS.get(mode, SORTS["last_seen_desc"])
    first = F.desc_nulls_last(column) if way == "desc" else F.asc_nulls_last(column)
    return df.orderBy(first, F.desc("last_seen_at"), F.desc("listing_id"))


def paginate(df: DataFrame, page: int = 1, size: int = 50, sort: str = "last_seen_desc") -> DataFrame:
    """One page of the sorted rows with the totals beside each."""
    size, page = min(max(size, 1), 100), max(page, 1)
    total = df.agg(F.count("*").alias("total_listings"))
    rows = sort_listings(df, sort).offset((page - 1) * size).limit(size)
    out = rows.crossJoin(F.broadcast(total))  # one row
    pages = F.ceil(F.col("total_listings") / size)
    return out.withColumns({"page": F.lit(page), "total_pages": pages, "has_next": pages > page, "has_previous": F.lit(page > 1)})


def slice_summary(df: DataFrame) -> DataFrame:
    """One row on a slice: how many, sold-like, mean price, counts by state and basis, honesty counts."""
    counts = state_counts(df).drop("high_confidence", "medium_confidence", "low_confidence")
    own = df.agg(
        F.count_if("sold_like").alias("sold_like"), F.sum("price_amount_cents").alias("price_sum"), F.count("price_amount_cents").alias("priced"), F.round(F.avg("price_amount_cents"), 2).alias("average_price"), F.count_if("partial_signal").alias("partial_signal"),
        F.count_if("thin_signal").alias("thin_signal"), F.count_if("has_estimated_publication").alias("estimated_publication"), F.count_if(~F.col("has_estimated_publication")).alias("missing_publication"),
    )
    return counts.crossJoin(own)  # one row each


def explore(snapshot: DataFrame, page: int = 1, size: int = 50, sort: str = "last_seen_desc", query: str | None = None, limit: int = C.COMPARISON_LIMIT, threshold: int = C.SUPPORT_THRESHOLD, bands: tuple[int, int] = C.PRICE_BAND_CENTS, **facets) -> dict[str, DataFrame]:
    """Summary, comparisons and one page of the slice that the facets and the query leave; ``bands`` are the snapshot's."""
    part = search_listings(filter_listings(snapshot, **facets), query)
    return {"summary": slice_summary(part), "comparisons": compare_all(part, max(limit, 1), max(threshold, 1), bands), "page": paginate(part, page, size, sort)}


def overview(snapshot: DataFrame) -> DataFrame:
    """One row: inventory, states, honesty and freshness counts."""
    fresh = [F.count_if(F.col("freshness_bucket") == b).alias(b.replace("-", "_")) for b in C.FRESHNESS_POINTS]
    return state_counts(snapshot).crossJoin(snapshot.agg(*fresh, F.count_if("partial_signal").alias("partial_signal"), F.count_if("sold_like").alias("sold_like")))


def overview_snapshot(snapshot: DataFrame, scans: DataFrame, limit: int = C.COMPARISON_LIMIT, threshold: int = C.SUPPORT_THRESHOLD, bands: tuple[int, int] = C.PRICE_BAND_CENTS) -> dict[str, DataFrame]:
    """The whole overview: the summary row with its latest times and caution codes, and the comparisons of all listings."""
    more = snapshot.agg(F.count_if("thin_signal").alias("thin_signal"), F.count_if("has_estimated_publication").alias("estimated_publication"), F.count_if(~F.col("has_estimated_publication")).alias("missing_publication"), F.max("last_seen_at").alias("latest_seen_at"))
    last = scans.where("success").agg(F.max("fetched_at").alias("latest_scan_at"))
    summary = overview(snapshot).crossJoin(more).crossJoin(last)  # one row each
    return {"summary": summary.withColumn("cautions", _cautions()), "comparisons": compare_all(snapshot, max(limit, 1), max(threshold, 1), bands)}


def _cautions() -> Column:
    n = F.col("tracked_listings")
    return F.array_compact(F.array(
        F.when(n == 0, "empty"), F.when(F.col("inferred_basis") * 2 > n, "mostly_inferred"), F.when(F.col("unknown_basis") * 4 > n, "many_unknown"),
        F.when(F.col("low_confidence") * 2 > n, "mostly_low_confidence"), F.when(F.col("partial_signal") * 2 > n, "mostly_partial_signal"), F.when(F.col("first_pass_only") * 2 > n, "mostly_first_pass"),
    ))


def caution_notes(summary: DataFrame) -> DataFrame:
    """Codes of what a reader of the overview should bear in mind."""
    return summary.select("tracked_listings", F.array_join(_cautions(), ",").alias("notes"))


def detail_notes(df: DataFrame) -> DataFrame:
    """Codes that make up the reading of one listing."""
    notes = F.array_compact(F.array(
        F.concat(F.lit("state:"), "state_code"), F.when(F.col("basis_kind") == "inferred", "inferred"), F.when(F.col("confidence_label") == "low", "low_confidence"),
        F.when(F.col("observation_count") == 1, "single_observation"), F.when(F.col("thin_signal"), "thin_signal"), F.when(F.col("price_amount_cents").isNull(), "no_price"),
        F.when(F.col("probe_outcome").isNotNull(), "has_probe"), F.when(F.col("has_estimated_publication"), "estimated_publication"),
    ))
    return df.withColumn("notes", F.array_join(notes, ","))


def interleave(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """Round robin over the groups: every group's first row, then every second."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).orderBy("turn", group).limit(k)


def listing_detail(scores: DataFrame, history: DataFrame, now, listing_id: int | None = None) -> DataFrame:
    """Score, explanations, history, reading, provenance and events of each listing (or one), a row each.

    ``reading`` says what a reader should know, as codes with values; ``events`` are the listing's story in order.
    """
    own = scores if listing_id is None else scores.where(F.col("listing_id") == listing_id)
    out = with_score_explanation(with_state_explanation(own)).join(history.select("listing_id", "timeline"), "listing_id", "left")
    code = lambda c, value: F.struct(F.lit(c).alias("code"), value.cast("string").alias("value"))
    reading = F.array_compact(F.array(
        code("state", F.col("state_code")), code("basis", F.col("basis_kind")), code("confidence", F.col("confidence_label")), code("freshness", F.col("freshness_bucket")),
        F.when(F.col("observation_count") == 1, code("single_observation", F.col("first_seen_at"))), F.when(F.col("thin_signal"), code("thin_signal", F.col("signal_completeness"))),
        F.when(F.col("price_amount_cents").isNull(), code("no_price", F.lit(None))), F.when(F.col("probe_outcome").isNotNull(), code("probe", F.col("probe_outcome"))),
        F.when(F.col("has_estimated_publication"), code("estimated_publication", F.timestamp_seconds("created_at_ts"))), F.when(F.col("price_percentile").isNotNull(), code("price_standing", F.col("peer_price_label"))),
    ))
    degraded = F.col("probe_outcome").isNotNull() & probe_is_degraded("probe_reason", "probe_error", "probe_status")
    source = F.when(degraded, "history after a degraded probe").when(F.col("probe_outcome").isin("active", "sold", "deleted", "unavailable"), "item page").otherwise("history")
    provenance = F.struct(
        F.col("basis_kind").alias("state_kind"), source.alias("state_source"), F.when(F.col("created_at_ts").isNotNull(), "estimated").otherwise("missing").alias("publication_kind"),
        F.timestamp_seconds("created_at_ts").alias("publication_at"), "first_seen_at", "last_seen_at",
    )
    at = F.lit(str(now)).cast("timestamp")
    event = lambda kind, when, text: F.struct(F.lit(kind).alias("kind"), when.alias("at"), text.cast("string").alias("detail"))
    events = F.array_compact(F.array(
        event("first_seen", F.col("first_seen_at"), F.col("catalog_path")), event("last_seen", F.col("last_seen_at"), F.col("freshness_bucket")),
        F.when(F.col("follow_up_miss_count") > 0, event("misses", at, F.col("follow_up_miss_count"))), F.when(F.col("probe_outcome").isNotNull(), event("probe", F.col("probed_at"), F.when(degraded, "degraded").otherwise(F.col("probe_outcome")))),
        event("state", at, F.col("state_code")),
    ))
    return out.withColumns({"reading": reading, "provenance": provenance, "events": events})

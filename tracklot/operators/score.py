"""Demand and premium scores, peer contexts, rankings, market segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklot import constants as C
from tracklot.functions.columns import is_sold_like, mapped
from tracklot.operators.state import state_counts


#: Parts into which the listings of a common context are split.
SALTS = 16


def demand_score(df: DataFrame) -> DataFrame:
    """Sum of six capped components, at most 100."""
    n, misses = F.coalesce("observation_count", F.lit(0)), F.coalesce("follow_up_miss_count", F.lit(0))
    parts = [
        mapped(F.col("state_code"), C.STATE_POINTS),
        mapped(F.col("confidence_label"), C.CONFIDENCE_POINTS),
        mapped(F.col("basis_kind"), C.BASIS_POINTS),
        mapped(F.col("freshness_bucket"), C.FRESHNESS_POINTS, 0.0),
        F.least(F.greatest(n - 1, F.lit(0)) * 4.0, F.lit(12.0)),
        F.least(misses * 6.0, F.lit(18.0)),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.withColumn("demand_score", F.least(total, F.lit(100.0)))


def _key(fields: tuple[str, ...]):
    """Null-safe key of a context: texts trimmed and lower-cased; none if every field is missing."""
    values = [F.col(f).cast("string") if f == "catalog_id" else F.nullif(F.lower(F.trim(F.col(f))), F.lit("")) for f in fields]
    return F.when(F.coalesce(*values).isNotNull(), F.to_json(F.array(*values)))


def peer_context(df: DataFrame) -> DataFrame:
    """The first of six contexts with enough priced peers (the listing itself counts), as context_name, context_key, context_size.

    ``listing_id`` names a row. Contexts are looked up in one join of narrow rows, six a listing, salted since all listings
    of a root share a key; only the chosen context meets the listing itself. No list of peers is built.
    """
    entries = [F.struct(F.lit(i).alias("rank"), F.lit(n).alias("name"), F.lit(least).alias("least"), _key(f).alias("key")) for i, (n, least, f) in enumerate(C.PEER_CONTEXTS)]
    long = df.where("price_amount_cents IS NOT NULL").select("listing_id", F.inline(F.array(*entries))).where("key IS NOT NULL")
    counts = long.groupBy("name", "key").agg(F.count("*").alias("peers"))
    copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = long.withColumn("salt", F.pmod(F.xxhash64("listing_id"), F.lit(SALTS)).cast("int"))
    best = salted.join(copies, ["name", "key", "salt"]).where("peers >= least").groupBy("listing_id").agg(F.min(F.struct("rank", "name", "key", "peers")).alias("c"))
    best = best.select("listing_id", F.col("c.name").alias("context_name"), F.col("c.key").alias("context_key"), F.col("c.peers").alias("context_size"))
    return df.join(best, "listing_id", "left")


def premium_score(df: DataFrame, listings: DataFrame | None = None) -> DataFrame:
    """Mid-rank percentile of the price among the context's peers, and the premium score.

    Percentiles come from counts by (context, price) and running sums over them: a partition of the window holds
    different prices, not listings. ``listings`` are the peers (all of ``df`` by default).
    """
    peers = df if listings is None else listings
    long = peers.where("price_amount_cents IS NOT NULL").select("price_amount_cents", F.inline(F.array(*[F.struct(F.lit(n).alias("context_name"), _key(f).alias("context_key")) for n, _, f in C.PEER_CONTEXTS]))).where("context_key IS NOT NULL")
    by_price = long.groupBy("context_name", "context_key", "price_amount_cents").agg(F.count("*").alias("equal"))
    order = Window.partitionBy("context_name", "context_key").orderBy("price_amount_cents").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = by_price.withColumn("below", F.sum("equal").over(order) - F.col("equal"))
    return _with_premium(df.join(below, ["context_name", "context_key", "price_amount_cents"], "left"))


def _with_premium(out: DataFrame) -> DataFrame:
    """Percentile, premium score and label from ``below``, ``equal`` and ``context_size``, null without a context."""
    percentile = F.round((F.col("below") * 2 + F.col("equal")) / (F.col("context_size") * 2), 3)
    out = out.withColumn("price_percentile", percentile)
    out = out.withColumn("expensive_signal", F.when(F.col("price_percentile").isNotNull(), F.round(F.greatest(F.lit(0.0), (F.col("price_percentile") - 0.5) / 0.5) * 100, 2)))
    with_price = F.round(F.col("demand_score") * 0.78 + F.col("expensive_signal") * 0.22, 2)
    label = F.when(F.col("price_percentile").isNull(), "unavailable").when(F.col("price_percentile") >= 0.67, "premium").when(F.col("price_percentile") >= 0.33, "mid").otherwise("budget")
    out = out.withColumn("premium_score", F.coalesce(with_price, F.round(F.col("demand_score") * 0.85, 2)))
    return out.withColumn("peer_price_label", label).drop("below", "equal")


def score_listings(snapshot: DataFrame) -> DataFrame:
    return premium_score(peer_context(demand_score(snapshot)), snapshot)


def with_score_explanation(df: DataFrame) -> DataFrame:
    return df.withColumn("score_explanation", F.struct("demand_score", F.when(F.col("context_name").isNotNull(), F.struct("context_name", "context_size", "price_percentile", "peer_price_label", "expensive_signal")).alias("context")))


def rank_listings(scores: DataFrame, kind: str = "demand", k: int = 20) -> DataFrame:
    first, second = (f"{kind}_score", "premium_score" if kind == "demand" else "demand_score")
    return scores.orderBy(F.desc(first), F.desc(second), F.desc("last_seen_at"), "listing_id").limit(k)


def write_rank_index(snapshot: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """Store every context's prices with their running counts as a table, bucketed by context and sorted by price.

    A listing's standing is one row of one context, so a lookup reads the buckets of its six contexts and in them, by the
    sort's statistics, the row groups with its price.
    """
    long = snapshot.where("price_amount_cents IS NOT NULL").select("price_amount_cents", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), _key(f).alias("key")) for n, _, f in C.PEER_CONTEXTS]))).where("key IS NOT NULL")
    by_price = long.groupBy(F.concat_ws("|", "name", "key").alias("context"), "price_amount_cents").agg(F.count("*").alias("equal"))
    order = Window.partitionBy("context").orderBy("price_amount_cents")
    ranked = by_price.withColumns({"below": F.sum("equal").over(order) - F.col("equal"), "peers": F.sum("equal").over(Window.partitionBy("context"))})
    ranked.repartition(buckets, "context").write.mode("overwrite").option("path", path).bucketBy(buckets, "context").sortBy("context", "price_amount_cents").saveAsTable(table)


def rank_rows(spark, table: str, contexts: list[str], price: int) -> DataFrame:
    """The index's rows of some contexts at one price: a point lookup, at most one row per context."""
    return spark.table(table).where(F.col("context").isin(contexts) & (F.col("price_amount_cents") == price))


def score_detail(snapshot: DataFrame, listing_id: int, table: str) -> DataFrame:
    """One listing's scores and their explanation, from its own row and the rank index of ``write_rank_index``; no row if it is unknown.

    The driver holds the listing's price and contexts, and at most six rows of the index.
    """
    own = demand_score(snapshot.where(F.col("listing_id") == listing_id))
    row = own.select("price_amount_cents", *[_key(f).alias(n) for n, _, f in C.PEER_CONTEXTS]).first()
    keys = {f"{n}|{row[n]}": (n, row[n], least) for n, least, _ in C.PEER_CONTEXTS if row and row[n] is not None}
    found = {r.context: r for r in rank_rows(snapshot.sparkSession, table, list(keys), row.price_amount_cents).collect()} if keys and row.price_amount_cents is not None else {}
    name, key, r = next(((n, k, found[c]) for c, (n, k, least) in keys.items() if c in found and found[c].peers >= least), (None, None, None))
    value = lambda x, kind: F.lit(x).cast(kind)
    stood = own.withColumns({"context_name": value(name, "string"), "context_key": value(key, "string"), **{c: value(r and r[f], "bigint") for c, f in (("context_size", "peers"), ("below", "below"), ("equal", "equal"))}})
    return with_score_explanation(_with_premium(stood))


def latest_two_scans(scans: DataFrame, per: str = "run") -> DataFrame:
    """Listing counts of the latest and the previous scan of each catalog; pages of a run are summed first unless ``per`` is 'page'."""
    good = scans.where("success")
    if per == "run":
        good = good.groupBy("catalog_id", "run_id").agg(F.max("fetched_at").alias("fetched_at"), F.sum("listing_count").alias("listing_count"), F.max("page_number").alias("page_number"))
    w = Window.partitionBy("catalog_id").orderBy(F.desc("fetched_at"), F.desc("run_id"), F.desc("page_number"))
    two = good.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    return two.groupBy("catalog_id").agg(F.max(F.when(F.col("rn") == 1, F.col("listing_count"))).alias("latest_scan_count"), F.max(F.when(F.col("rn") == 2, F.col("listing_count"))).alias("previous_scan_count"))


def market_segments(scores: DataFrame, scans: DataFrame, least: int = 3) -> DataFrame:
    """Metrics of every catalog with enough listings; the state mix as a map."""
    n = F.count("*")
    seg = scores.where("catalog_id IS NOT NULL").groupBy("catalog_id").agg(
        n.alias("tracked_listings"),
        F.min("catalog_path").alias("catalog_path"),
        F.min("root_title").alias("root_title"),
        F.round(F.avg("demand_score"), 2).alias("avg_demand_score"),
        F.round(F.avg("premium_score"), 2).alias("avg_premium_score"),
        F.sum("price_amount_cents").alias("price_sum"),
        F.count("price_amount_cents").alias("priced"),
        F.count_if(is_sold_like("state_code")).alias("sold_like_count"),
        F.count_if((F.col("last_seen_age_hours") <= 24) & (F.col("observation_count") == 1)).alias("recent_arrivals"),
        F.map_from_arrays(F.array(*map(F.lit, C.STATES)), F.array(*[F.count_if(F.col("state_code") == s) for s in C.STATES])).alias("state_mix"),
    )
    seg = seg.where(F.col("tracked_listings") >= least).join(latest_two_scans(scans), "catalog_id", "left")
    seg = seg.withColumn("visible_delta", F.coalesce(F.col("latest_scan_count") - F.col("previous_scan_count"), F.lit(0)))
    seg = seg.withColumn("sold_like_rate", F.col("sold_like_count") / F.col("tracked_listings"))
    return seg.withColumns({
        "avg_price_amount_cents": F.round(F.coalesce("price_sum", F.lit(0)) / F.greatest("priced", F.lit(1)), 2),
        "performance_score": F.round(F.col("avg_demand_score") * 0.68 + F.col("avg_premium_score") * 0.32, 2),
        "rising_score": F.round(F.col("avg_demand_score") * 0.35 + F.col("sold_like_rate") * 40 + F.col("recent_arrivals") * 6 + F.greatest("visible_delta", F.lit(0)) * 4, 2),
    })


def top_segments(segments: DataFrame, by: str = "performance", k: int = 8) -> DataFrame:
    second = "tracked_listings" if by == "performance" else "recent_arrivals"
    return segments.orderBy(F.desc(f"{by}_score"), F.desc(second), "catalog_id").limit(k)


def market_summary(scores: DataFrame, scans: DataFrame, k: int = 8) -> dict[str, DataFrame]:
    """Overall state counts, and the ``k`` segments that perform best and that rise fastest, in order."""
    segments = market_segments(scores, scans)
    return {"overall": state_counts(scores), "performing": top_segments(segments, "performance", k), "rising": top_segments(segments, "rising", k)}

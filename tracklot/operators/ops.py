"""Analytics of the collection itself: probes, cycles, lanes, experiments, long-run audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklot.functions.columns import in_window, probe_is_degraded, safe_ratio, scan_is_challenge


def count_map(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(value), F.col("n"))))).alias(name))


def summarize_probes(p: DataFrame, *keys: str) -> DataFrame:
    """Outcomes, direct and inconclusive, degraded, blocked, HTTP and transport errors, and a status."""
    degraded = probe_is_degraded("reason", "error_message", "response_status")
    out = p.groupBy(*keys).agg(
        F.count("*").alias("probed"), *[F.count_if(F.col("probe_outcome") == o).alias(o) for o in ("active", "sold", "unavailable", "deleted", "unknown")],
        F.count_if(F.col("probe_outcome") != "unknown").alias("direct_signals"), F.count_if(degraded).alias("degraded"), F.count_if(F.col("response_status").isin(403, 429)).alias("anti_bot"),
        F.count_if(F.col("response_status") >= 500).alias("http_errors"), F.count_if(F.col("error_message").isNotNull()).alias("transport_errors"),
    )
    return out.withColumn("status", F.when(F.col("probed") == 0, "unknown").when(F.col("degraded") * 2 > F.col("probed"), "degraded").when(F.col("degraded") > 0, "partial").otherwise("healthy"))


def probe_maps(p: DataFrame, *keys: str) -> DataFrame:
    """Counts of outcomes and of reasons, as a map each."""
    reasons = count_map(p.withColumn("reason", F.coalesce("reason", F.lit("none"))), "reason", list(keys), "reason_counts")
    return count_map(p, "probe_outcome", list(keys), "outcome_counts").join(reasons, list(keys), "full")


def top_failing_catalogs(scans: DataFrame, k: int) -> DataFrame:
    failed = scans.where("NOT success").groupBy("catalog_id").agg(F.count("*").alias("failures"), F.max("fetched_at").alias("latest_at"), F.count_if(F.col("response_status") == 403).alias("blocked"), F.min(F.coalesce("error_message", F.lit("n/a"))).alias("sample_message"))
    return failed.orderBy(F.desc("failures"), "catalog_id").limit(k)


def summarize_cycles(c: DataFrame) -> DataFrame:
    """Per lane: cycles by status, success rate and mean duration."""
    out = c.groupBy("lane_name").agg(F.count("*").alias("cycles"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum(F.unix_seconds("finished_at") - F.unix_seconds("started_at")).alias("seconds"))
    return out.withColumns({"success_rate": safe_ratio("completed", "cycles"), "mean_seconds": safe_ratio("seconds", "cycles")})


def failure_phases(c: DataFrame, k: int) -> DataFrame:
    """The phases in which most cycles failed; ties by name."""
    return c.where("status = 'failed'").groupBy("phase").agg(F.count("*").alias("failures"), F.max("started_at").alias("latest_at")).orderBy(F.desc("failures"), "phase").limit(k)


def top_counts(df: DataFrame, counts: str, k: int) -> DataFrame:
    """Largest sums over a column of count maps; ties by name."""
    return df.select(F.explode(counts).alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def coverage_breadth(scans: DataFrame, catalogs: DataFrame) -> DataFrame:
    known = catalogs.where("is_leaf").agg(F.count_distinct("catalog_id").alias("known"))
    seen = scans.agg(F.count_distinct("catalog_id").alias("scanned"), F.count("*").alias("scans"))
    out = seen.crossJoin(known)  # one row each
    return out.withColumns({"breadth": safe_ratio("scanned", "known"), "repeat_factor": safe_ratio("scans", "scanned"), "narrow": F.col("scanned") * 2 < F.col("known")})


def mode_statuses(pages: DataFrame, *keys: str) -> DataFrame:
    """How often each response status came in each mode, as a map per group; no status counts as 0."""
    return count_map(pages.withColumn("status", F.coalesce("response_status", F.lit(0))), "status", [*keys, "mode"], "status_counts")


#: Counts that a cycle's state refresh reports.
REFRESHED = ("direct_signal_count", "inconclusive_probe_count", "degraded_probe_count", "anti_bot_challenge_count", "http_error_count", "transport_error_count")


def _reason(condition: Column, code: str, count: str | None = None) -> Column:
    """A code, with a count where there is one, if the condition holds."""
    text = F.concat(F.lit(f"{code}="), F.col(count).cast("string")) if count else F.lit(code)
    return F.when(condition, text)


def acquisition_health(cycles: DataFrame, runs: DataFrame, scans: DataFrame, catalogs: DataFrame, limit: int = 5) -> DataFrame:
    """One row: status of the latest cycle and of its run (or the latest one), and the reasons for it, as codes with counts.

    Degraded: a failed scan in that run, or degraded probes in that cycle. Partial: inconclusive probes. Unknown: neither run
    nor cycle. ``cycles`` have ``discovery_run_id`` and ``state_refresh_summary``; at most ``limit`` failed scans are shown and counted.
    """
    one = cycles.sparkSession.range(1).drop("id")
    counts = F.struct(*[F.coalesce(F.col(f"state_refresh_summary.{c}"), F.lit(0)).alias(c) for c in REFRESHED])
    cycle = cycles.select(F.max_by(F.struct("cycle_id", "discovery_run_id", counts.alias("n")), F.struct("started_at", "cycle_id")).alias("c"))
    newest = runs.select(F.max_by("run_id", F.struct("started_at", "run_id")).alias("newest"))
    named = cycle.join(runs.select(F.col("run_id").alias("named")), F.col("c.discovery_run_id") == F.col("named"), "left")
    head = one.crossJoin(F.broadcast(named.limit(1))).crossJoin(F.broadcast(newest)).select("c", F.coalesce("named", "newest").alias("latest_run_id"))  # one row each
    failed = scans.where("NOT success").join(F.broadcast(head.select("latest_run_id")), F.col("run_id") == F.col("latest_run_id")).join(F.broadcast(catalogs.select("catalog_id", "catalog_path")), "catalog_id")
    shown = failed.orderBy(F.desc("fetched_at"), "catalog_path", "page_number").limit(limit)
    shown = shown.agg(F.collect_list(F.struct("catalog_path", "page_number", "response_status", "error_message")).alias("recent_scan_failures"))
    out = head.crossJoin(F.broadcast(shown)).withColumns({"latest_cycle_id": F.col("c.cycle_id"), "recent_scan_failure_count": F.size("recent_scan_failures"), **{c: F.coalesce(F.col(f"c.n.{c}"), F.lit(0)) for c in REFRESHED}})
    none = F.col("latest_run_id").isNull() & F.col("latest_cycle_id").isNull()
    degraded = (F.col("recent_scan_failure_count") > 0) | (F.col("degraded_probe_count") > 0)
    partial = F.col("inconclusive_probe_count") > 0
    out = out.withColumn("status", F.when(none, "unknown").when(degraded, "degraded").when(partial, "partial").otherwise("healthy"))
    is_so = lambda c: (F.col("status") == "degraded") & (F.col(c) > 0)
    reasons = F.array_compact(F.array(
        _reason(none, "nothing_recorded"), *[_reason(is_so(c), code, c) for c, code in (("recent_scan_failure_count", "failed_scans"), ("anti_bot_challenge_count", "anti_bot"), ("transport_error_count", "transport_errors"), ("http_error_count", "http_errors"))],
        _reason(F.col("status") == "partial", "inconclusive_probes", "inconclusive_probe_count"), _reason(F.col("status") == "healthy", "healthy"),
    ))
    return out.select("status", "latest_cycle_id", "latest_run_id", "recent_scan_failure_count", "recent_scan_failures", *REFRESHED, reasons.alias("reasons"))


def runtime_report(cycles: DataFrame, now, stale_seconds: int = 900) -> DataFrame:
    """Latest cycle of each lane and whether its heartbeat is stale."""
    w = Window.partitionBy("lane_name").orderBy(F.desc("started_at"), F.desc("cycle_id"))
    last = cycles.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    age = F.unix_seconds(F.lit(str(now)).cast("timestamp")) - F.unix_seconds(F.coalesce("finished_at", "started_at"))
    return last.withColumns({"heartbeat_age_seconds": age, "stale": age > stale_seconds})


def runtime_status(cycles: DataFrame, now, k: int = 8) -> dict[str, DataFrame]:
    """Each lane's latest cycle, the ``k`` latest cycles and failures of all, and totals by lane."""
    newest = [F.desc("started_at"), F.desc("cycle_id")]
    return {"latest": runtime_report(cycles, now), "recent": cycles.orderBy(*newest).limit(k), "failures": cycles.where("status = 'failed'").orderBy(*newest).limit(k), "totals": summarize_cycles(cycles)}


def lane_rollup(lanes: DataFrame) -> DataFrame:
    """The lane that decides the overall status (running, failed, scheduled, paused, idle), the soonest first."""
    rank = F.array_position(F.array(*map(F.lit, ("running", "failed", "scheduled", "paused", "idle"))), F.col("status"))
    return lanes.agg(F.min_by(F.struct("lane_name", "status"), F.struct(F.when(rank == 0, 99).otherwise(rank), "next_at", "lane_name")).alias("x"), F.count("*").alias("lanes")).select("lanes", "x.*")


def storage_growth(snap: DataFrame, *keys: str) -> DataFrame:
    first, last = F.min_by(F.struct("listing_count", "bytes"), "captured_at"), F.max_by(F.struct("listing_count", "bytes"), "captured_at")
    out = snap.groupBy(*keys).agg(first.alias("a"), last.alias("b"))
    return out.select(*keys, (F.col("b.listing_count") - F.col("a.listing_count")).alias("listing_growth"), (F.col("b.bytes") - F.col("a.bytes")).alias("byte_growth"))


def resource_summary(samples: DataFrame, *keys: str) -> DataFrame:
    """CPU and memory under any of the names and units that samplers use."""
    has = set(samples.columns)
    pick = lambda names: F.coalesce(*[F.col(n) * f for n, f in names if n in has], F.lit(None).cast("double"))
    cpu, mem = pick([("cpu_percent", 1), ("cpu", 1)]), pick([("rss_mb", 1), ("rss_bytes", 1 / 1048576)])
    return samples.groupBy(*keys).agg(F.avg(cpu).alias("mean_cpu"), F.max(cpu).alias("peak_cpu"), F.max(mem).alias("peak_rss_mb"))


def collapse_unique(c: str) -> Column:
    """A group's only value, or its values as a list in text, or null."""
    seen = F.sort_array(F.collect_set(c))
    return F.when(F.size(seen) == 1, F.get(seen, 0).cast("string")).when(F.size(seen) > 1, F.to_json(seen))


def scorecard(s: DataFrame, scans: DataFrame, probes: DataFrame, key: Column, start, end) -> DataFrame:
    """Per experiment arm in a window: hits, new listings, duplicate, challenge and degraded rates, new per hour."""
    hits = s.where(in_window("observed_at", start, end)).groupBy(key.alias("arm")).agg(F.count("*").alias("hits"), F.count_distinct("listing_id").alias("listings"))
    calls = scans.where(in_window("fetched_at", start, end)).groupBy(key.alias("arm")).agg(F.count("*").alias("scans"), F.count_if(scan_is_challenge("response_status", "error_message")).alias("challenged"))
    hours = (F.unix_seconds(F.lit(str(end)).cast("timestamp")) - F.unix_seconds(F.lit(str(start)).cast("timestamp"))) / 3600
    out = hits.join(calls, "arm", "left")
    return out.withColumns({"duplicate_ratio": safe_ratio(F.col("hits") - F.col("listings"), "hits"), "challenge_rate": safe_ratio("challenged", "scans"), "new_per_hour": F.col("listings") / hours})


def experiment_scorecard(runs: DataFrame, scans: DataFrame, cycles: DataFrame, storage: DataFrame, resources: DataFrame, hours: DataFrame) -> DataFrame:
    """Per experiment ``arm``: net new listings and by the hour, duplicates, challenges, degraded requests, bytes per new listing, resources.

    ``runs`` (raw_listing_hits, unique_listing_hits), ``scans`` (response_status, error_message), ``cycles`` (probed, anti_bot,
    degraded_probes, is_degraded), ``storage`` (captured_at, listing_count, bytes) and ``hours`` (a number per arm). New
    listings are the growth of the stored ones; without two states of the storage, the unique hits stand in.
    """
    hits = runs.groupBy("arm").agg(F.sum("raw_listing_hits").alias("raw_listing_hits"), F.sum("unique_listing_hits").alias("unique_listing_hits"))
    calls = scans.groupBy("arm").agg(F.count("*").alias("scans"), F.count_if(scan_is_challenge("response_status", "error_message")).alias("blocked"))
    turns = cycles.groupBy("arm").agg(F.sum("probed").alias("probed"), F.sum("anti_bot").alias("anti_bot"), (F.sum("degraded_probes") + F.count_if("is_degraded")).alias("degraded_count"))
    grown = storage_growth(storage, "arm").join(storage.groupBy("arm").agg(F.count("*").alias("states")), "arm").where("states > 1").drop("states")
    out = hours
    for part in (hits, calls, turns, grown, resource_summary(resources, "arm")):
        out = out.join(part, "arm", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    new = F.when(F.col("listing_growth").isNull(), zero("unique_listing_hits")).otherwise(F.greatest("listing_growth", F.lit(0)))
    out = out.withColumns({"net_new_source": F.when(F.col("listing_growth").isNull(), "unique_hits").otherwise("storage"), "net_new": new, "raw_listing_hits": zero("raw_listing_hits")})
    duplicates = F.greatest(F.col("raw_listing_hits") - F.col("net_new"), F.lit(0))
    out = out.withColumns({"duplicate_hits": duplicates, "challenge_count": zero("blocked") + zero("anti_bot"), "degraded_count": zero("degraded_count"), "requests": zero("scans") + zero("probed")})
    four = lambda a, b: F.round(safe_ratio(a, b), 4)
    return out.select(
        "arm", "net_new_source", "net_new", four("net_new", "hours").alias("new_per_hour"), "raw_listing_hits", "duplicate_hits", four("duplicate_hits", "raw_listing_hits").alias("duplicate_ratio"),
        "challenge_count", four("challenge_count", "requests").alias("challenge_rate"), "degraded_count", four("degraded_count", "requests").alias("degraded_rate"),
        F.when(F.col("net_new") > 0, four("byte_growth", "net_new")).alias("bytes_per_new_listing"), F.round("mean_cpu", 4).alias("mean_cpu"), "peak_cpu", "peak_rss_mb",
    )


def issue_examples(probes: DataFrame, cards: DataFrame, k: int = 5) -> DataFrame:
    """The listings with most degraded probes, with their cards; ties by id."""
    counts = probes.where(probe_is_degraded("reason", "error_message", "response_status")).groupBy("listing_id").agg(F.count("*").alias("degraded_probe_count"))
    top = counts.orderBy(F.desc("degraded_probe_count"), "listing_id").limit(k)
    return top.join(cards.select("listing_id", "title", "brand", "catalog_path"), "listing_id", "left").orderBy(F.desc("degraded_probe_count"), "listing_id")


def leaderboard(cards: DataFrame) -> DataFrame:
    """Arms by new listings an hour, then fewer duplicates, fewer challenges, name; with what the winner won by."""
    order = [F.desc_nulls_last("new_per_hour"), F.asc_nulls_last("duplicate_ratio"), F.asc_nulls_last("challenge_rate"), F.col("arm")]
    w = Window.orderBy(*order)  # one row per arm
    out = cards.withColumns({"rank": F.row_number().over(w), "next_rate": F.lead("new_per_hour").over(w), "next_dup": F.lead("duplicate_ratio").over(w)})
    why = F.when(F.col("rank") != 1, None).when(F.col("next_rate").isNull(), "only_arm").when(F.col("new_per_hour") > F.col("next_rate"), "new_per_hour").when(F.col("duplicate_ratio") < F.col("next_dup"), "duplicate_ratio").otherwise("tie_break")
    return out.withColumn("won_by", why).drop("next_rate", "next_dup")


def paired_mode_report(pages: DataFrame) -> DataFrame:
    """Bounded against unbounded mode on the same catalog and page: mean, median and signs of the difference, weighted ratio."""
    wide = pages.groupBy("catalog_id", "page_number").pivot("mode", ["bounded", "unbounded"]).agg(F.sum("accepted").alias("accepted"), F.sum("seen").alias("seen"))
    both = wide.where("bounded_seen IS NOT NULL AND unbounded_seen IS NOT NULL").withColumn("delta", F.col("bounded_accepted") - F.col("unbounded_accepted"))
    return both.groupBy("catalog_id").agg(F.count("*").alias("pairs"), F.sum("delta").alias("delta_sum"), F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"), F.count_if(F.col("delta") > 0).alias("better"), F.count_if(F.col("delta") < 0).alias("worse"), safe_ratio(F.sum("bounded_accepted"), F.sum("bounded_seen")).alias("bounded_ratio"), safe_ratio(F.sum("unbounded_accepted"), F.sum("unbounded_seen")).alias("unbounded_ratio"))


def audit_runtime(cycles: DataFrame) -> DataFrame:
    """Cycles by status, success rate among those that ended, mean seconds."""
    n = lambda status: F.count_if(F.col("status") == status)
    out = cycles.agg(F.count("*").alias("cycle_count"), *[n(x).alias(f"{x}_cycles") for x in ("completed", "failed", "interrupted", "running")], F.avg(F.unix_seconds("finished_at") - F.unix_seconds("started_at")).alias("seconds"))
    return out.withColumns({"success_rate": F.round(safe_ratio("completed_cycles", F.col("completed_cycles") + F.col("failed_cycles") + F.col("interrupted_cycles")), 3), "average_cycle_seconds": F.round("seconds", 2)}).drop("seconds")


def audit_discovery(runs: DataFrame, scanned: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Runs and their sums, leaf coverage, and whether coverage was narrow: every run capped and the same leaves again, or few leaves scanned over and over."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in ("scanned_leaf_catalogs", "successful_scans", "failed_scans", "unique_listing_hits")]
    out = runs.agg(F.count("*").alias("run_count"), F.count("max_leaf_categories").alias("capped_runs"), F.max("max_leaf_categories").alias("cap"), *sums)
    known = catalogs.agg(F.count_if("is_leaf").alias("leaf_catalogs_known"))
    out = out.crossJoin(known).crossJoin(scanned.agg(F.count_distinct("catalog_id").alias("leaf_catalogs_scanned")))  # one row each
    leaves, all_scans = F.col("leaf_catalogs_scanned"), F.col("sum_scanned_leaf_catalogs")
    judged = (F.col("run_count") >= 2) & (leaves > 0)
    same = judged & (F.col("capped_runs") == F.col("run_count")) & (leaves <= F.col("cap")) & (all_scans > leaves)
    few = judged & (leaves * 4 <= F.col("leaf_catalogs_known")) & (F.col("leaf_catalogs_known") > 0) & (all_scans * 2 >= leaves * 3)
    return out.withColumns({
        "coverage_ratio": F.round(safe_ratio(leaves, "leaf_catalogs_known"), 3), "repeated_scan_factor": F.round(safe_ratio(all_scans, leaves), 3), "average_hits_per_run": F.round(safe_ratio("sum_unique_listing_hits", "run_count"), 2),
        "same_leaves": F.coalesce(same, F.lit(False)), "few_leaves": few,
    }).drop("cap")


def audit_acquisition(cycles: DataFrame) -> DataFrame:
    """Cycles by the status of their state refresh, and the sums of what it counted."""
    status = F.coalesce("state_refresh_summary.status", F.lit("unknown"))
    return cycles.agg(*[F.count_if(status == x).alias(f"{x}_refreshes") for x in ("healthy", "partial", "degraded", "unknown")], *[F.coalesce(F.sum(f"state_refresh_summary.{c}"), F.lit(0)).alias(c) for c in REFRESHED])


def long_run_audit(cycles: DataFrame, runs: DataFrame, scans: DataFrame, catalogs: DataFrame, summary: DataFrame, since, healthy: bool = True, k: int = 5) -> DataFrame:
    """One row on the collection since a time: runtime, discovery, acquisition and freshness, findings, what to do, and a verdict.

    Cycles and runs count if they began or ended since then; leaves count as scanned in runs that began since. Findings and
    recommendations are codes with counts, in a fixed order. The verdict adds weights: two a failed cycle (at most 4), one an
    interrupted one (2), two a degraded refresh (4), one a partial one (2), two for any failed scan, two for narrow coverage, one each
    for many first passes and many stale listings; from 3 on it is ``caution``, from 6 ``degraded``. A database that is not
    healthy is ``critical``, and without cycles the verdict is ``caution``.
    """
    start = F.lit(str(since)).cast("timestamp")
    inside = (F.col("started_at") >= start) | F.coalesce(F.col("finished_at") >= start, F.lit(False))
    cycles, own = cycles.where(inside), runs.where(inside)
    scanned = scans.join(F.broadcast(runs.where(F.col("started_at") >= start).select("run_id")), "run_id", "left_semi") if runs.count() <= 100_000 else scans.join(runs.where(F.col("started_at") >= start).select("run_id"), "run_id", "left_semi")
    fresh = summary.agg(F.count("*").alias("tracked_listings"), F.count_if(F.col("freshness_bucket") == "first-pass-only").alias("first_pass_only"), F.count_if(F.col("freshness_bucket") == "stale-followup").alias("stale_followup"))
    phases = cycles.where("status IN ('failed', 'interrupted')").groupBy(F.concat_ws(":", "status", "phase").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(k)
    reasons = top_counts(cycles.select("state_refresh_summary.reason_counts"), "reason_counts", k)
    listed = lambda df, c, name: df.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(c).alias("name"), "n"))).alias(name))  # noqa: E731  (k rows)
    out = audit_runtime(cycles).crossJoin(audit_discovery(own, scanned, catalogs)).crossJoin(audit_acquisition(cycles)).crossJoin(fresh)  # one row each
    out = out.crossJoin(listed(phases, "label", "failure_phases")).crossJoin(listed(reasons, "reason", "top_reasons"))
    out = out.withColumns({c: F.transform(c, lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))) for c in ("failure_phases", "top_reasons")})
    more = lambda c: F.col(c) > 0
    first_pass = more("tracked_listings") & (F.col("first_pass_only") * 10 >= F.col("tracked_listings") * 7)
    stale = more("tracked_listings") & (F.col("stale_followup") * 5 >= F.col("tracked_listings"))
    none, narrow = F.col("cycle_count") == 0, F.col("same_leaves") | F.col("few_leaves")
    findings = F.array_compact(F.array(
        _reason(none, "no_cycles"), F.when(~none & (more("failed_cycles") | more("interrupted_cycles")), F.concat_ws("=", F.lit("failed_cycles"), F.concat_ws("+", F.col("failed_cycles").cast("string"), F.col("interrupted_cycles").cast("string")))),
        _reason(F.col("same_leaves"), "same_leaves"), _reason(F.col("few_leaves"), "few_leaves"), _reason(more("sum_failed_scans"), "failed_scans", "sum_failed_scans"),
        _reason(more("degraded_refreshes"), "degraded_refreshes", "degraded_refreshes"), _reason(~more("degraded_refreshes") & more("partial_refreshes"), "partial_refreshes", "partial_refreshes"),
        _reason(first_pass, "first_pass_heavy", "first_pass_only"), _reason(stale, "stale_backlog", "stale_followup"),
    ))
    advice = F.array_compact(F.array(
        _reason(none, "check_window"), _reason(more("failed_cycles"), "inspect_failures"), _reason(narrow, "widen_coverage"), _reason(more("sum_failed_scans"), "review_failing_catalogs"),
        F.when(more("anti_bot_challenge_count"), "relieve_anti_bot").when(more("degraded_probe_count"), "sample_degraded").when(more("inconclusive_probe_count"), "inspect_inconclusive"),
        _reason(first_pass, "revisit_more"), _reason(stale, "work_off_backlog"),
    ))
    upto = lambda c, most: F.least(c, F.lit(most))
    score = (
        upto(F.col("failed_cycles") * 2, 4) + upto(F.col("interrupted_cycles"), 2) + upto(F.col("degraded_refreshes") * 2, 4) + upto(F.col("partial_refreshes"), 2)
        + more("sum_failed_scans").cast("int") * 2 + narrow.cast("int") * 2 + first_pass.cast("int") + stale.cast("int")
    )
    verdict = F.when(F.lit(not healthy), "critical").when(none | ((F.col("score") >= 3) & (F.col("score") < 6)), "caution").when(F.col("score") >= 6, "degraded").otherwise("healthy")
    out = out.withColumns({"findings": findings, "recommendations": F.when(F.size(advice) == 0, F.array(F.lit("keep_validating"))).otherwise(advice), "score": score})
    return out.withColumns({"verdict": verdict, "summary": F.slice("findings", 1, 2)})

"""Column expressions: price bands, ages, freshness, signal, flags, text and money parsing, filters."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklot import constants as C


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def timestamp(now: datetime | str | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp")


def mapped(c: Column, values: dict, default=None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(F.lit(default))


def price_band(cents: Column | str, limits: tuple[int, int] = C.PRICE_BAND_CENTS) -> Column:
    c, (low, high) = col(cents), limits
    return F.when(c.isNull(), "unknown").when(c < low, "under").when(c < high, "middle").otherwise("over")


def price_band_label(cents: Column | str, limits: tuple[int, int] = C.PRICE_BAND_CENTS) -> Column:
    low, high = (x // 100 for x in limits)
    return mapped(price_band(cents, limits), {"under": f"< {low}", "middle": f"{low}-{high - 1}", "over": f">= {high}", "unknown": "no price"})


def price_band_order(cents: Column | str, limits: tuple[int, int] = C.PRICE_BAND_CENTS) -> Column:
    return mapped(price_band(cents, limits), {"under": 0, "middle": 1, "over": 2}, 3).cast("int")


def age_hours(seen: Column | str, now) -> Column:
    """Hours since ``seen``, at least 0, not rounded."""
    return F.greatest(F.lit(0.0), (F.unix_micros(timestamp(now)) - F.unix_micros(col(seen))) / F.lit(3.6e9))


def freshness(observations: Column | str, age: Column | str) -> Column:
    n, a = col(observations), col(age)
    return F.when(n <= 1, "first-pass-only").when(a <= C.FRESH_HOURS, "fresh-followup").when(a <= C.STALE_HOURS, "aging-followup").otherwise("stale-followup")


def signal_completeness(fields: Iterable[str] = C.SIGNAL_FIELDS) -> Column:
    total = F.lit(0)
    for f in fields:
        total = total + F.col(f).isNotNull().cast("int")
    return total


def confidence_label(score: Column | str) -> Column:
    s = col(score)
    return F.when(s >= C.HIGH_CONFIDENCE, "high").when(s >= C.MEDIUM_CONFIDENCE, "medium").otherwise("low")


def state_order(state: Column | str) -> Column:
    return mapped(col(state), {s: i for i, s in enumerate(C.STATES)}, len(C.STATES)).cast("int")


def state_label(state: Column | str) -> Column:
    return F.initcap(F.replace(col(state), F.lit("_"), F.lit(" ")))


def is_sold_like(state: Column | str) -> Column:
    return col(state).isin("sold_observed", "sold_probable")


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def nullable_equal(a: Column | str, b: Column | str) -> Column:
    return col(a).eqNullSafe(col(b))


def canonical_url(url: Column | str) -> Column:
    return F.regexp_replace(col(url), r"[?#].*$", "")


def parse_money(text: Column | str) -> Column:
    """Cents of texts like ``1.234,56 €`` or ``12.50``: the last separator before two digits is the decimal point."""
    t = F.regexp_replace(col(text), r"[\s\x{a0}\x{202f}]", "")
    number = F.regexp_extract(t, r"([0-9][0-9.,]*)", 1)
    european = F.replace(F.replace(number, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    english = F.replace(number, F.lit(","), F.lit(""))
    amount = F.when(number.rlike(r",[0-9]{1,2}$"), european).when(number.rlike(r"\.[0-9]{1,2}$"), english).otherwise(F.regexp_replace(number, "[.,]", ""))
    return F.when(number != "", F.round(amount.cast("double") * 100).cast("long"))


def currency_symbol(code: Column | str) -> Column:
    return F.coalesce(mapped(F.upper(col(code)), C.CURRENCY_SYMBOLS), col(code))


def price_to_cents(amount: Column | str) -> Column:
    """Cents of a decimal amount in text, comma or point, blanks between thousands left out; null if it is no number."""
    return F.round(F.translate(col(amount), ", ", ".").try_cast("double") * 100).cast("long")


def resolve_condition(status: Column | str, status_id: Column | str) -> Column:
    return F.coalesce(F.nullif(F.trim(col(status)), F.lit("")), mapped(col(status_id), C.CONDITIONS))


def split_subtitle(text: Column | str) -> Column:
    """(size, condition) of ``size · condition``."""
    parts = F.filter(F.split(F.regexp_replace(col(text), r"^[\s\x{a0}]+|[\s\x{a0}]+$", ""), r"[\s\x{a0}]*[·•|][\s\x{a0}]*"), lambda p: p != "")
    return F.struct(F.get(parts, 0).alias("size_label"), F.get(parts, 1).alias("condition_label"))


def named_value(text: Column | str, label: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(col(text), rf"(?i)\b{label}\s*:\s*([^,|]+)", 1)), F.lit(""))


def title_from(text: Column | str, url: Column | str) -> Column:
    """The text before the first comma, else the words of the URL's last part without its number."""
    head = F.nullif(F.trim(F.substring_index(col(text), ",", 1)), F.lit(""))
    slug = F.regexp_replace(F.regexp_extract(canonical_url(url), r"/[0-9]*-?([^/]*)$", 1), "-", " ")
    return F.coalesce(head, F.nullif(slug, F.lit("")))


def challenge_markers(html: Column | str) -> Column:
    return F.filter(F.array(*map(F.lit, C.CHALLENGE_MARKERS)), lambda m: F.contains(F.lower(col(html)), m))


def scan_is_challenge(status: Column | str, message: Column | str) -> Column:
    """A blocking status, or a message with a sign of a challenge."""
    text = F.lower(F.coalesce(col(message), F.lit("")))
    marker = F.lit(False)
    for m in C.SCAN_MARKERS:
        marker = marker | F.contains(text, F.lit(m))
    return F.coalesce(col(status).isin(403, 429), F.lit(False)) | marker


def probe_is_degraded(reason: Column | str, error: Column | str, status: Column | str) -> Column:
    """A challenge, an exception, any unexpected HTTP answer, an error message that is not empty, or a blocking or failing status."""
    why, s = F.coalesce(col(reason), F.lit("")), col(status)
    named = why.isin("anti_bot_challenge", "probe_exception") | why.startswith("unexpected_http_") | why.startswith("http_")
    return named | (F.coalesce(col(error), F.lit("")) != "") | F.coalesce(s.isin(403, 429) | (s >= 500), F.lit(False))


def in_window(ts: Column | str, start, end) -> Column:
    return col(ts).between(timestamp(start), timestamp(end))


def overlaps_window(first: Column | str, last: Column | str, start, end) -> Column:
    return (col(first) <= timestamp(end)) & (col(last) >= timestamp(start))


def needs_probe(df_probe: str = "probed_at", seen: str = "last_seen_at") -> Column:
    stale = F.col(df_probe).isNull() | (F.col(df_probe) < F.col(seen))
    return stale & ((F.col("follow_up_miss_count") > 0) | (F.col("observation_count") == 1))


def storage_segment(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(text))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def display_money(cents: Column | str, currency: Column | str) -> Column:
    """Two decimals and the currency, if any; a text of its own for no price."""
    return F.when(col(cents).isNotNull(), F.trim(F.concat(F.format_string("%.2f", col(cents) / 100.0), F.lit(" "), F.coalesce(col(currency), F.lit(""))))).otherwise("price n/a")


def banded(value: Column | str, limits: tuple[tuple[float, str], ...], least: str) -> Column:
    """The name of the first limit that the value reaches, else ``least``; null stays null."""
    v, out = col(value), None
    for limit, name in limits:
        out = F.when(v >= limit, name) if out is None else out.when(v >= limit, name)
    return F.when(v.isNotNull(), out.otherwise(least))


def score_band(score: Column | str) -> Column:
    return banded(score, C.SCORE_BANDS, "modest")


def percentile_band(percentile: Column | str) -> Column:
    return F.coalesce(banded(percentile, C.PERCENTILE_BANDS, "low"), F.lit("none"))


def tone(state: Column | str, basis: Column | str, confidence: Column | str) -> Column:
    """How firmly a state is shown."""
    s, low = col(state), col(confidence) == "low"
    lost = s.isin("deleted", "unknown")
    return F.when(lost & low, "danger").when(lost | (col(basis) == "inferred") | low, "warning").when(s.isin("active", "sold_observed"), "success").otherwise("info")


def filter_listings(df: DataFrame, **facets) -> DataFrame:
    """Rows equal to every facet given; ``unknown-brand`` and ``unknown-condition`` stand for null; an empty value is no filter."""
    sentinels = {"brand": "unknown-brand", "condition_label": "unknown-condition"}
    for name, value in facets.items():
        if value not in (None, "", "all"):
            df = df.where((F.coalesce(F.col(name), F.lit(sentinels[name])) if name in sentinels else F.col(name)) == value)
    return df


def search_listings(df: DataFrame, query: str | None, fields: tuple[str, ...] = ("listing_id", "title", "brand", "catalog_path", "user_login")) -> DataFrame:
    """Rows in which any field holds the query, letter case aside; ``%`` and ``_`` are ordinary characters."""
    needle = (query or "").strip().lower()
    if not needle:
        return df
    hit = F.lit(False)
    for f in fields:
        if f in df.columns:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), F.lit(needle))
    return df.where(hit)


def filter_mart(df: DataFrame, ids: list[int] | None = None, start: str | None = None, end: str | None = None, lens: str | None = None, date: str = "day") -> DataFrame:
    """Ids (none: all), an inclusive date range and a lens. A long id list is joined, not listed in the plan."""
    if ids:
        df = df.where(F.col("listing_id").isin(ids)) if len(ids) <= 200 else df.join(df.sparkSession.createDataFrame([(i,) for i in ids], "listing_id long"), "listing_id", "left_semi")
    if start:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df.where(F.col("lens") == lens) if lens else df


def accept_sightings(df: DataFrame, min_cents: int = 0, max_cents: int = 0, brands: Iterable[str] = ()) -> DataFrame:
    """Sightings at or over the floor, at or under the cap if it is set, of the brands if any are named."""
    wanted = sorted({b.strip().lower() for b in brands})
    if min_cents:
        df = df.where(F.col("price_amount_cents") >= min_cents)
    if max_cents > 0:
        df = df.where(F.col("price_amount_cents") <= max_cents)
    return df.where(F.lower(F.trim("brand")).isin(wanted)) if wanted else df


def select_leaf_catalogs(catalogs: DataFrame, roots: list[str] | None = None, ids: list[int] | None = None) -> DataFrame:
    out = catalogs.where("is_leaf")
    out = out.where(F.col("root_title").isin(roots)) if roots else out
    return out.where(F.col("catalog_id").isin(ids)) if ids else out

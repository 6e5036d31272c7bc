"""Parsing jobs over tables of raw pages: JSON and HTML catalog pages, probe pages, catalog trees."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklot.functions.columns import canonical_url, challenge_markers, currency_symbol, named_value, parse_money, price_to_cents, resolve_condition, split_subtitle
from tracklot.sources.scratch import materialize

_PRICE = "struct<amount: string, currency_code: string>"
API = f"struct<items: array<struct<id: string, title: string, url: string, brand_title: string, brand_dto: struct<title: string>, size_title: string, status: string, status_id: int, price: {_PRICE}, total_item_price: {_PRICE}, photo: struct<url: string, full_size_url: string>, photos: array<struct<url: string>>, favourite_count: long, view_count: long, user: struct<id: long, login: string>>>, pagination: struct<current_page: int, total_pages: int, per_page: int, total_entries: long>>"


def parse_api_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per item of JSON catalog pages; items without an integer id are left out. Other columns of ``pages`` stay."""
    rest = [c for c in pages.columns if c != body]
    rows = pages.withColumn("_p", F.from_json(body, API)).select(*rest, F.posexplode_outer("_p.items").alias("card_position", "i"))
    rows = rows.withColumn("listing_id", F.col("i.id").try_cast("long")).where("listing_id IS NOT NULL")
    return rows.select(
        *rest, "card_position", "listing_id", canonical_url("i.url").alias("canonical_url"), "i.title", F.coalesce("i.brand_title", "i.brand_dto.title").alias("brand"),
        F.col("i.size_title").alias("size_label"), resolve_condition("i.status", "i.status_id").alias("condition_label"),
        price_to_cents("i.price.amount").alias("price_amount_cents"), currency_symbol("i.price.currency_code").alias("price_currency"),
        price_to_cents("i.total_item_price.amount").alias("total_price_amount_cents"),
        F.coalesce("i.photo.url", "i.photo.full_size_url", F.get("i.photos", 0)["url"]).alias("image_url"),
        "i.favourite_count", "i.view_count", F.col("i.user.id").alias("user_id"), F.col("i.user.login").alias("user_login"),
    )


def parse_pagination(pages: DataFrame, body: str = "body") -> DataFrame:
    """Current, total and next page; the total falls back on entries over page size."""
    p = F.from_json(body, API)["pagination"]
    total = F.coalesce(p["total_pages"], F.ceil(p["total_entries"] / F.when(p["per_page"] > 0, p["per_page"])).cast("int"))
    out = pages.withColumns({"current_page": F.coalesce(p["current_page"], F.lit(1)), "total_pages": total})
    return out.withColumn("next_page", F.when(F.col("current_page") < F.col("total_pages"), F.col("current_page") + 1))


CARDS = "listing_id long, canonical_url string, alt string, subtitle string, price_text string"
HREF = r"href=[\"']([^\"']*/items/([0-9]+)[^\"']*)[\"']"
SUBTITLE = r"data-testid=[\"'][^\"']*subtitle[\"'][^>]*>([^<]*)<"
MONEY = "([0-9][0-9.,\u00a0\u202f ]*\\s?(?:€|£|\\$|zł))"
_LINK = re.compile(r"<a\b([^>]*)>(.*?)</a>", re.S)
_HREF = re.compile(HREF)
_TITLE = re.compile(r"title=(?:\"([^\"]*)\"|'([^']*)')")
_SUB = re.compile(SUBTITLE)
_MONEY = re.compile(MONEY)


def card_rows(html: str | None) -> Iterator[tuple]:
    """Cards of one HTML catalog page: id, link, title attribute, subtitle, first price text."""
    for m in _LINK.finditer(html or ""):
        if not (href := _HREF.search(m[1])):
            continue
        title = _TITLE.search(m[1])
        alt = (title[1] or title[2]) if title else None
        sub, money = _SUB.search(m[2]), _MONEY.search(m[2]) or _MONEY.search(alt or "")
        yield int(href[2]), re.sub(r"[?#].*$", "", href[1]), alt, sub[1] if sub else None, money[1].strip() if money else None


def parse_html_pages(pages: DataFrame, body: str = "html") -> DataFrame:
    """One row per card of HTML catalog pages, in the columns of the JSON parser as far as a card shows them.

    Links are cut out by the JVM's own patterns; ``ParseCards`` does the same for SQL, one page at a time.
    """
    links = pages.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(r"(?s)(<a\b[^>]*>.*?)</a>"), F.lit(1))).alias("link"))
    tag, inner = F.regexp_extract("link", r"(?s)^<a\b([^>]*)>", 1), F.regexp_extract("link", r"(?s)^<a\b[^>]*>(.*)", 1)
    rows = links.select(tag.alias("tag"), inner.alias("inner"), F.regexp_extract(tag, HREF, 1).alias("href"), F.regexp_extract(tag, HREF, 2).try_cast("long").alias("listing_id")).where("listing_id IS NOT NULL")
    title = F.regexp_extract("tag", r"""title=("[^"]*"|'[^']*')""", 1)
    alt = F.when(title != "", F.substring(title, F.lit(2), F.length(title) - 2))
    money = lambda c: F.nullif(F.trim(F.regexp_extract(c, MONEY, 1)), F.lit(""))
    rows = rows.withColumns({"alt": alt, "subtitle": F.nullif(F.regexp_extract("inner", SUBTITLE, 1), F.lit(""))}).withColumn("price_text", F.coalesce(money("inner"), money(F.coalesce("alt", F.lit("")))))
    sub = split_subtitle("subtitle")
    return rows.select("listing_id", canonical_url("href").alias("canonical_url"), F.trim(F.substring_index("alt", ",", 1)).alias("title"), named_value("alt", "(?:brand|marque)").alias("brand"), sub["size_label"].alias("size_label"), F.coalesce(sub["condition_label"], named_value("alt", "(?:condition|état)")).alias("condition_label"), parse_money("price_text").alias("price_amount_cents"))


@F.udtf(returnType=CARDS)
class ParseCards:
    """Table function over one page's HTML."""

    def eval(self, html: str):  # noqa: ANN201
        yield from card_rows(html)


#: The flags of a listing's own page, in the order in which it has them.
SIGNAL = r'(?s)"item_id":([0-9]+).*?"can_buy":(true|false).*?"is_closed":(true|false).*?"is_hidden":(true|false).*?"is_reserved":(true|false)'


def classify_probe_pages(pages: DataFrame, body: str = "html", status: str = "status", listing: str = "listing_id") -> DataFrame:
    """Outcome of a listing's own page, the reason, and challenge markers where they matter.

    The status code speaks first; of a page that came, the first buy signal does, if it is of this listing. A marker
    counts only where no buy signal is found, or the answer was an error. A null body is an empty page.
    """
    html = F.coalesce(F.col(body), F.lit(""))
    out = pages.withColumns({"_m": F.regexp_extract(F.replace(html, F.lit('\\"'), F.lit('"')), SIGNAL, 0), "_seen": challenge_markers(html)})
    part = lambda k: F.regexp_extract("_m", SIGNAL, k)
    found = F.when(F.col("_m") != "", F.struct(part(1).try_cast("long").alias("item_id"), *[(part(k) == "true").alias(n) for k, n in enumerate(("can_buy", "is_closed", "is_hidden", "is_reserved"), 2)]))
    out = out.withColumn("_f", found)
    s, flag = F.col(status), lambda n: F.col(f"_f.{n}")
    marked = F.size("_seen") > 0
    rules = [  # condition, outcome, reason
        (s.isin(404, 410), "deleted", F.concat(F.lit("http_"), s.cast("string"))),
        (s.isNull(), "unknown", F.lit("no_response_status")),
        (s >= 500, "unknown", F.concat(F.lit("http_"), s.cast("string"))),
        ((s >= 400) & (marked | s.isin(403, 429)), "unknown", F.lit("anti_bot_challenge")),
        (s >= 400, "unknown", F.concat(F.lit("unexpected_http_"), s.cast("string"))),
        (F.col("_f").isNull() & marked, "unknown", F.lit("anti_bot_challenge")),
        (F.col("_f").isNull(), "unknown", F.lit("buy_signal_not_found")),
        (~flag("item_id").eqNullSafe(F.col(listing)), "unknown", F.lit("item_id_mismatch")),
        (flag("can_buy") & ~flag("is_closed") & ~flag("is_hidden"), "active", F.lit("buy_signal_open")),
        (flag("is_closed") & ~flag("can_buy"), "sold", F.lit("buy_signal_closed")),
        (flag("is_hidden") | flag("is_reserved") | ~flag("can_buy"), "unavailable", F.lit("buy_signal_unavailable")),
        (F.lit(True), "unknown", F.lit("buy_signal_ambiguous")),
    ]
    chosen = None
    for condition, outcome, reason in rules:
        value = F.struct(F.lit(outcome).alias("probe_outcome"), reason.alias("reason"))
        chosen = F.when(condition, value) if chosen is None else chosen.when(condition, value)
    out = out.withColumn("_r", chosen)
    markers = F.when(F.col("_r.reason") == "anti_bot_challenge", F.col("_seen")).when(s.isNull() & marked, F.col("_seen"))
    return out.withColumns({"probe_outcome": F.col("_r.probe_outcome"), "reason": F.col("_r.reason"), "challenge_markers": markers}).drop("_m", "_seen", "_f", "_r")


NODE = "struct<id: long, title: string, code: string, url: string, catalogs: string>"


def flatten_catalog_tree(trees: DataFrame, body: str = "body") -> DataFrame:
    """Nested catalog JSON as rows with parent, root, path, depth and leaf flag; one explode per level, until a level is empty.

    Each level is written before the next one is cut from it, so the work does not grow with the square of the depth.
    """
    kids = f"array<{NODE}>"
    level = trees.select(F.inline_outer(F.from_json(body, kids))).where("id IS NOT NULL")
    level = level.select("id", F.lit(None).cast("long").alias("parent_id"), F.col("id").alias("root_id"), "title", "code", F.col("title").alias("path"), F.lit(0).alias("depth"), "catalogs")
    level = materialize(level, "level")
    out, k = level, 0
    while not level.where(F.size(F.from_json("catalogs", kids)) > 0).isEmpty():
        k += 1
        nxt = level.select(F.col("id").alias("parent_id"), "root_id", F.col("path").alias("up"), F.inline_outer(F.from_json("catalogs", kids)).alias("id", "title", "code", "url", "catalogs")).where("id IS NOT NULL")
        level = nxt.select("id", "parent_id", "root_id", "title", "code", F.concat_ws(" > ", "up", "title").alias("path"), F.lit(k).alias("depth"), "catalogs")
        level = materialize(level, "level")
        out = out.unionByName(level)
    return out.withColumn("is_leaf", F.coalesce(F.size(F.from_json("catalogs", kids)), F.lit(0)) <= 0).drop("catalogs")

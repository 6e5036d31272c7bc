"""Card evidence: the fragments that explain a card, as a JSON envelope, and card fields from any stored shape of it.

Stored evidence is read as VARIANT: its shape is told from its keys, and a field counts only with the type that it should have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklot.functions.columns import canonical_url, currency_symbol, parse_money, price_to_cents, resolve_condition, split_subtitle

# Version and sources of the envelope, and the keys that tell a shape.
VERSION = 1
HTML_KEYS = ("data_testid", "overlay_title", "image_alt", "description_title", "description_subtitle", "price_text", "total_price_text")
API_KEYS = ("title", "brand_title", "size_title", "status", "status_id", "price", "total_item_price", "brand")
CARD = "title string, brand string, size_label string, condition_label string, price_amount_cents bigint, price_currency string, total_price_amount_cents bigint, total_price_currency string"


def _clean(text: Column) -> Column:
    """White space, no-break spaces included, as single blanks; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"[\s\x{a0}\x{202f}]+", " ")), F.lit(""))


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text(v: Column, path: str) -> Column:
    """A field that is a text; of another type it is none."""
    return F.when(_is(_at(v, path), "STRING"), _clean(_at(v, path, "string")))


def _has_any(v: Column, keys: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for k in keys:
        found = found | _at(v, k).isNotNull()
    return found


def evidence_source(fragments: Column, named: Column) -> Column:
    """``html`` or ``api``: as named, else by the keys; without a telling key it is ``html``."""
    return F.when(named.isin("html", "api"), named).when(_has_any(fragments, HTML_KEYS), "html").when(_has_any(fragments, API_KEYS), "api").otherwise("html")


def _envelope(source: str, **fragments: Column) -> Column:
    return F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.lit(source).alias("evidence_source"), F.struct(*[c.alias(n) for n, c in fragments.items()]).alias("fragments")))


def html_evidence(**fields: Column) -> Column:
    """Envelope of an HTML card's visible texts (any of ``HTML_KEYS``); nulls and empty texts are left out."""
    if other := set(fields) - set(HTML_KEYS):
        raise ValueError(f"no fragments of a card: {', '.join(sorted(other))}")
    return _envelope("html", **{k: _clean(fields[k]) for k in HTML_KEYS if k in fields})


def api_evidence(item: Column) -> Column:
    """Envelope of one item of the API, given as JSON: only what explains its card; users, photos and the like are left out."""
    v = F.try_parse_json(item)

    def price(name: str) -> Column:
        p = _at(v, name)
        amount = F.nullif(F.trim(_at(p, "amount", "string")), F.lit(""))
        code = _text(p, "currency_code")
        return F.when(amount.isNotNull() | code.isNotNull(), F.struct(amount.alias("amount"), code.alias("currency_code")))

    return _envelope("api", title=_text(v, "title"), brand_title=F.coalesce(_text(v, "brand_title"), _text(v, "brand.title")), size_title=_text(v, "size_title"), status=_text(v, "status"), status_id=_at(v, "status_id", "int"), price=price("price"), total_item_price=price("total_item_price"))


def _named(text: Column, label: str) -> Column:
    return _clean(F.regexp_extract(text, rf"(?i){label}\s*:\s*([^,]+)", 1))


def _from_html(f: Column, url: Column) -> Column:
    overlay, alt = _text(f, "overlay_title"), _text(f, "image_alt")
    spoken = F.coalesce(overlay, alt)
    last = F.regexp_extract(canonical_url(url), r"([^/]*)/*$", 1)
    slug = F.nullif(F.when(F.contains(last, F.lit("-")), F.translate(F.regexp_extract(last, r"-(.*)$", 1), "-", " ")), F.lit(""))
    sub = split_subtitle(_text(f, "description_subtitle"))
    money = lambda k: (parse_money(_text(f, k)), F.nullif(F.regexp_extract(_text(f, k), r"(€|EUR|£|\$)", 1), F.lit("")))
    title = F.when(spoken.isNotNull(), F.nullif(F.trim(F.substring_index(spoken, ",", 1)), F.lit(""))).otherwise(slug)
    return F.struct(
        title.alias("title"), F.coalesce(_text(f, "description_title"), _named(spoken, "marque")).alias("brand"), F.coalesce(sub["size_label"], _named(spoken, "taille")).alias("size_label"),
        F.coalesce(sub["condition_label"], _named(spoken, "[éÉ]tat")).alias("condition_label"), *[c.alias(n) for c, n in zip((*money("price_text"), *money("total_price_text")), ("price_amount_cents", "price_currency", "total_price_amount_cents", "total_price_currency"), strict=True)],
    )


def _from_api(f: Column) -> Column:
    def money(name: str) -> tuple[Column, Column]:
        cents = price_to_cents(_at(f, f"{name}.amount", "string"))
        return cents, F.when(cents.isNotNull(), currency_symbol(_text(f, f"{name}.currency_code")))

    return F.struct(
        _text(f, "title").alias("title"), F.coalesce(_text(f, "brand_title"), _text(f, "brand.title")).alias("brand"), _text(f, "size_title").alias("size_label"), resolve_condition(_text(f, "status"), _at(f, "status_id", "int")).alias("condition_label"),
        *[c.alias(n) for c, n in zip((*money("price"), *money("total_item_price")), ("price_amount_cents", "price_currency", "total_price_amount_cents", "total_price_currency"), strict=True)],
    )


def read_evidence(df: DataFrame, raw: str = "raw_card_json", url: str = "source_url") -> DataFrame:
    """Add ``evidence_kind`` and ``evidence`` (the card's fields, ``CARD``) of stored evidence in any shape: envelope, flat HTML or flat API.

    What is no JSON object gives a null kind and null fields.
    """
    v = F.try_parse_json(raw)
    out = df.withColumn("_v", F.when(_is(v, "OBJECT"), v))
    inner = _at(F.col("_v"), "fragments")
    wrapped = F.coalesce(_at(F.col("_v"), "schema_version", "int") == VERSION, F.lit(False)) & _is(inner, "OBJECT")
    out = out.withColumns({"_f": F.when(wrapped, inner).otherwise(F.col("_v")), "_named": F.when(wrapped, _text(F.col("_v"), "evidence_source"))})
    out = out.withColumn("evidence_kind", F.when(F.col("_v").isNotNull(), evidence_source(F.col("_f"), F.col("_named"))))
    kind = f"struct<{', '.join(f.replace(' ', ': ') for f in CARD.split(', '))}>"
    card = F.when(F.col("evidence_kind") == "api", _from_api(F.col("_f")).cast(kind)).when(F.col("evidence_kind") == "html", _from_html(F.col("_f"), F.col(url)).cast(kind))
    return out.withColumn("evidence", card).drop("_v", "_f", "_named")


def normalize_cards(df: DataFrame, raw: str = "raw_card_json", url: str = "source_url") -> DataFrame:
    """Fill null card columns, or add them, from stored evidence; values that are there stay."""
    read = read_evidence(df, raw, url)
    fields = [f.split()[0] for f in CARD.split(", ")]
    return read.withColumns({c: F.coalesce(F.col(c), F.col(f"evidence.{c}")) if c in df.columns else F.col(f"evidence.{c}") for c in fields}).drop("evidence")

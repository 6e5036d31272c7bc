"""Deterministic ids, checksums, canonical JSON, redaction, path extraction; SQL registration."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the name space of derived ids.
NAMESPACE = uuid.UUID("7b5ca7b1-1ed1-4a2b-bd35-6e5e31b2b8b9")
SECRET_KEYS = "(?i)(password|passwd|secret|token|api_?key|cookie|authorization|credential)"


def canonical_json(**columns: Column | str) -> Column:
    """Compact JSON with keys in order; nulls stay."""
    fields = [(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in sorted(columns.items())]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """Version-5 UUID of a text under a name space (RFC 4122), without a Python worker."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    nibble = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(nibble, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def deterministic_uuid(label: str, **columns: Column | str) -> Column:
    return uuid5(F.concat(F.lit(label + ":"), canonical_json(**columns)))


def sha256_json(**columns: Column | str) -> Column:
    return F.sha2(canonical_json(**columns), 256)


def mask_userinfo(text: Column | str) -> Column:
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"://[^/@\s]+@", "://***@")


def redact(df: DataFrame) -> DataFrame:
    """Values under secret-looking names become ``***``; user info in URLs is masked in every other text."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            out[f.name] = F.when(F.col(f.name).isNotNull(), F.lit("***")) if re.search(SECRET_KEYS, f.name) else mask_userinfo(f.name)
        elif isinstance(f.dataType, T.MapType) and isinstance(f.dataType.valueType, T.StringType):
            out[f.name] = F.transform_values(f.name, lambda k, v: F.when(k.rlike(SECRET_KEYS), F.lit("***")).otherwise(mask_userinfo(v)))
    return df.withColumns(out) if out else df


def flatten_nested(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON text."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    return df.withColumns({n: F.to_json(n, {"ignoreNullFields": "false"}) for n in nested}) if nested else df


def decode_json_columns(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    return df.withColumns({n: F.from_json(n, s) for n, s in schemas.items()})


def extract_path(json: Column | str, path: str) -> Column:
    """Value at a dotted path, numbers being list places: ``a.b.0``."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(json, "$" + steps)


def register_functions(spark: SparkSession) -> None:
    """The scalar functions as SQL functions of the session, and ``parse_cards(html)`` as a table function."""
    for text in (
        "price_band(cents BIGINT) RETURNS STRING RETURN CASE WHEN cents IS NULL THEN 'unknown' WHEN cents < 2000 THEN 'under' WHEN cents < 4000 THEN 'middle' ELSE 'over' END",
        "freshness_bucket(n BIGINT, age DOUBLE) RETURNS STRING RETURN CASE WHEN n <= 1 THEN 'first-pass-only' WHEN age <= 24 THEN 'fresh-followup' WHEN age <= 72 THEN 'aging-followup' ELSE 'stale-followup' END",
        "canonical_url(url STRING) RETURNS STRING RETURN regexp_replace(url, '[?#].*$', '')",
        "signal_completeness(fields ARRAY<STRING>) RETURNS INT RETURN size(filter(fields, x -> x IS NOT NULL))",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    from tracklot.sources.parse import ParseCards

    spark.udtf.register("parse_cards", ParseCards)

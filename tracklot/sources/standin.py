"""The domain tables, derived by Spark from the driver's star-schema tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklot.sources.scratch import delete, folder

NOW = "2001-11-05 00:00:00"
#: Band limits under which all bands occur in these data.
BANDS = (139_500, 312_400)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; times without a zone are taken as the session's (UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = {n: F.col(n).cast("timestamp") for n, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(plain) if plain else df


def catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = read(spark, sf_dir, "part").select("p_type").distinct()
    return types.selectExpr(
        "CASE p_type WHEN 'ECONOMY' THEN 1001 WHEN 'LARGE' THEN 1002 WHEN 'MEDIUM' THEN 1003 WHEN 'PROMO' THEN 1004 WHEN 'SMALL' THEN 1005 ELSE 1006 END AS catalog_id",
        "p_type AS title",
    ).selectExpr("cast(catalog_id AS bigint) AS catalog_id", "title", "cast(IF(catalog_id <= 1003, 1, 2) AS bigint) AS root_catalog_id", "IF(catalog_id <= 1003, 'first', 'second') AS root_title", "concat(IF(catalog_id <= 1003, 'first', 'second'), ' > ', lower(title)) AS catalog_path", "true AS is_leaf")


#: What a sighting's ids are made of, and the ids: as columns they take less than half of the room.
ID_PARTS = {"order": "l_orderkey", "line": "l_linenumber", "part": "l_partkey", "supp": "l_suppkey", "at": "unix_seconds(l_shipdate)", "cents": "cast(round(l_extendedprice * 100) AS bigint)"}


def ids(order: str, line: str, part: str, supp: str, at: str, cents: str) -> tuple[str, str]:
    return f"{part} * 4 + {supp} % 4 AS listing_id", f"concat_ws('-', {order}, {line}, {part}, {supp}, {at}, {cents}) AS event_id"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))


def id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of all sightings' ids, for ``with_ids``."""
    return _lines(spark, sf_dir).selectExpr(*[f"{e} AS `{n}`" for n, e in ID_PARTS.items()])


def with_ids(parts: DataFrame) -> DataFrame:
    """(listing_id, event_id) of sightings."""
    return parts.selectExpr(*ids(*[f"`{n}`" for n in ID_PARTS]))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing_id, event_id = ids(*ID_PARTS.values())
    s = _lines(spark, sf_dir).selectExpr(
        listing_id,
        "date_format(l_shipdate, 'yyyy-MM') AS run_id",
        "l_shipdate AS observed_at",
        event_id,
        "cast(CASE p_type WHEN 'ECONOMY' THEN 1001 WHEN 'LARGE' THEN 1002 WHEN 'MEDIUM' THEN 1003 WHEN 'PROMO' THEN 1004 WHEN 'SMALL' THEN 1005 ELSE 1006 END AS bigint) AS catalog_id",
        "p_type",
        "p_name AS title",
        "IF(p_size % 7 = 0, NULL, p_brand) AS brand",
        "CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size < 17 THEN 'new' WHEN p_size < 34 THEN 'good' ELSE 'worn' END AS condition_label",
        "concat('S', p_size % 5) AS size_label",
        "IF(p_size % 5 = 0, NULL, concat('https://img.example/', l_partkey)) AS image_url",
        "IF(l_partkey % 13 = 0, NULL, cast(round(l_extendedprice / l_quantity * 100) AS bigint)) AS price_amount_cents",
        "cast(round(l_tax * 100) AS bigint) AS tax",
        "cast(l_quantity AS bigint) AS favourite_count",
        "IF(l_orderkey % 3 = 0, NULL, cast(l_linenumber * 10 AS bigint)) AS view_count",
        "l_suppkey AS user_id",
        "l_linenumber AS page_number",
        "l_orderkey % 96 AS card_position",
        "IF(l_orderkey % 4 = 0, NULL, unix_seconds(l_shipdate) - 86400 * l_linenumber) AS created_at_ts",
    )
    return s.selectExpr("*", "price_amount_cents + (price_amount_cents * tax) div 100 AS total_price_amount_cents", "IF(catalog_id <= 1003, 'first', 'second') AS root_title", "cast(IF(catalog_id <= 1003, 1, 2) AS bigint) AS root_catalog_id", "concat(IF(catalog_id <= 1003, 'first', 'second'), ' > ', lower(p_type)) AS catalog_path", "concat('m-', run_id) AS manifest_id").drop("tax", "p_type")


def scans(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    """One scan per catalog and run; those of one catalog failed. ``seen`` are the sightings, where they are at hand."""
    by = (sightings(spark, sf_dir) if seen is None else seen).groupBy("catalog_id", "run_id").agg(F.max("observed_at").alias("fetched_at"), F.count("*").alias("listing_count"))
    return by.selectExpr("catalog_id", "run_id", "1 AS page_number", "fetched_at", "catalog_id <> 1003 AS success", "IF(catalog_id <> 1003, 200, 403) AS response_status", "IF(catalog_id <> 1003, NULL, 'blocked by challenge') AS error_message", "listing_count")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS probe_id",
        "user_id * 4 AS listing_id",
        "CASE event_type WHEN 'purchase' THEN 'sold' WHEN 'view' THEN 'active' WHEN 'click' THEN 'active' WHEN 'signup' THEN 'unavailable' ELSE 'unknown' END AS probe_outcome",
        "timestamp_micros(unix_micros(ts) - (8100 + 30 * (user_id % 60)) * 86400000000) AS probed_at",
        "cast(CASE event_type WHEN 'error' THEN IF(event_id % 2 = 0, 403, 503) ELSE 200 END AS int) AS response_status",
        "IF(event_type = 'error', 'challenge_page', event_type) AS reason",
        "IF(event_type = 'error' AND event_id % 5 = 0, 'timeout', NULL) AS error_message",
        "props",
    )


#: Rows of a file of an arrival; an arrival has two files at least.
ARRIVAL_ROWS = 500_000


def arrivals(df: DataFrame, chunk: Column, path: str, chunks: int) -> DataFrame:
    """A stream over a table's rows as they arrive: those of chunk 0 first, then 1 and so on, one micro-batch each."""
    return next(arrivals_in_turns(df, chunk, path, (chunks,)))


def arrivals_in_turns(df: DataFrame, chunk: Column, path: str, turns: tuple[int, ...]) -> Iterator[DataFrame]:
    """``arrivals`` of which so many chunks come at a turn; each turn gives the stream as it is then.

    The rows are derived once and set aside by chunk; a chunk that has arrived is set aside no longer. All chunks have as many
    files as the largest asks for, since a micro-batch takes in so many; all but the last must have rows for them.
    """
    spark, staged, chunks = df.sparkSession, folder(df.sparkSession, "staged"), sum(turns)
    numbered = df.withColumn("_chunk", chunk.cast("int")).where(F.col("_chunk").between(0, chunks - 1))
    numbered.write.option("compression", "zstd").partitionBy("_chunk").parquet(staged)
    rows = spark.read.schema(numbered.schema).parquet(staged)
    sizes = {r[0]: r[1] for r in rows.groupBy("_chunk").count().collect()}  # a row per chunk
    files = max(2, -(-max(sizes.values(), default=0) // ARRIVAL_ROWS))
    for last, turn in zip(accumulate(turns), turns, strict=True):
        for i in range(last - turn, last):
            # by hash, which puts nothing in order first
            rows.where(F.col("_chunk") == i).drop("_chunk").repartition(files, *df.columns).write.mode("append").option("compression", "zstd").parquet(path)
            delete(spark, f"{staged}/_chunk={i}")
        yield spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


#: Years of the sightings; each arrives as one chunk.
FIRST_YEAR, YEARS = 1995, 7


def year_chunk(at: str, key: str) -> Column:
    """A row's year, counted from 0; one in eight of December's rows is late by a chunk."""
    late = (F.month(at) == 12) & (F.pmod(F.xxhash64(key), F.lit(8)) == 0)
    return F.greatest(F.lit(0), F.least(F.year(at) - FIRST_YEAR + late.cast("int"), F.lit(YEARS - 1)))

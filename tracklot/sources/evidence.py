"""Lookup of single rows in the lake, by an index that tells which files may hold them.

The index has each file's times and, per id column, Bloom filters of its values as bitmaps of 32,768 bits (64-bit words by
their number), as many as the file's values need. A lookup reads the index, opens the files that pass every filter, and no others.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklot.functions.columns import timestamp
from tracklot.sources.lake import read_lake, tasks_for

#: Bits of one bitmap (Spark's own size), bits wanted per value, and bits set by one.
BITS, PER_VALUE, HASHES = 32_768, 12, 5


def _bits(digest: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), digest), F.lit(BITS)) for k in range(HASHES)]


def _word(bit: Column) -> Column:
    return F.shiftright(bit, 6).cast("int")


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))


def index_lake(spark: SparkSession, root: str, event_type: str, ids: list[str], ts: str, version: int = 1) -> None:
    """Write the index of one event type: ``files`` (file, number, first_at, last_at, rows, values) and ``filters`` (id, file, pages, page, words).

    Ids are read as digests and go to the task of their file, as many tasks as the rows ask for; there their bits are put
    into words by an aggregate of longs, so that no task sorts a row per bit. ``values``, which the number of a filter's
    bitmaps depends on, is an estimate.
    """
    rows = read_lake(spark, root, event_type, version=version).select(F.col("_metadata.file_path").alias("file"), F.col(ts).alias("at"), *[F.xxhash64(F.col(c).cast("string")).alias(f"id{i}") for i, c in enumerate(ids)], *[F.col(c).isNotNull().alias(f"has{i}") for i, c in enumerate(ids)])
    values = F.array(*[F.approx_count_distinct(F.when(F.col(f"has{i}"), F.col(f"id{i}"))) for i in range(len(ids))])
    files = rows.groupBy("file").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("rows"), values.alias("values")).withColumn("number", F.monotonically_increasing_id())
    files.write.mode("overwrite").parquet(f"{root}/_index/{event_type}/files")
    files = F.broadcast(spark.read.parquet(f"{root}/_index/{event_type}/files").select("file", "number", "rows", "values"))  # a row per file
    tasks = tasks_for(rows, files.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    held = rows.drop("at").join(files.drop("rows"), "file").drop("file").repartition(tasks, "number")
    entries = [F.struct(F.lit(i).alias("n"), F.when(F.col(f"has{i}"), F.col(f"id{i}")).alias("digest"), F.greatest(F.lit(1).cast("long"), F.ceil(F.get("values", F.lit(i)) * PER_VALUE / BITS)).alias("pages")) for i in range(len(ids))]
    digests = held.select("number", F.inline(F.array(*entries))).where("digest IS NOT NULL").distinct()
    marked = digests.select("number", "n", "pages", F.pmod("digest", "pages").alias("page"), F.explode(F.array(*_bits(F.col("digest")))).alias("bit"))
    words = marked.groupBy("number", "n", "pages", "page", _word(F.col("bit")).alias("word")).agg(F.bit_or(_mask(F.col("bit"))).alias("bits"))
    filters = words.groupBy("number", "n", "pages", "page").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    filters = filters.join(files.select("file", "number"), "number").select(F.get(F.array(*map(F.lit, ids)), F.col("n")).alias("id"), "file", "pages", "page", "words")
    filters.write.mode("overwrite").partitionBy("id").parquet(f"{root}/_index/{event_type}/filters")


def candidate_files(spark: SparkSession, root: str, event_type: str, start=None, end=None, **ids) -> DataFrame:
    """Files that may hold a row with these ids in this time: none that holds one is left out."""
    files = spark.read.parquet(f"{root}/_index/{event_type}/files")
    files = files.where(F.col("last_at") >= timestamp(start)) if start is not None else files
    files = files.where(F.col("first_at") <= timestamp(end)) if end is not None else files
    filters = spark.read.parquet(f"{root}/_index/{event_type}/filters")
    for c, v in ids.items():
        digest = F.xxhash64(F.lit(str(v)))
        may = filters.where((F.col("id") == c) & (F.col("page") == F.pmod(digest, F.col("pages"))))
        for bit in _bits(digest):
            may = may.where(F.coalesce(F.element_at("words", _word(bit)), F.lit(0)).bitwiseAND(_mask(bit)) != 0)
        files = files.join(may.select("file"), "file", "left_semi")
    return files.select("file")


def lookup_evidence(spark: SparkSession, root: str, event_type: str, by: dict, where: dict | None = None, start=None, end=None, version: int = 1) -> DataFrame:
    """The one row whose indexed columns ``by`` and other columns ``where`` have these values; an error where none or several have them."""
    wanted = {**by, **(where or {})}
    files = [unquote(r.file) for r in candidate_files(spark, root, event_type, start, end, **by).collect()]
    if not files:
        raise LookupError(f"no row for {wanted}")
    found = spark.read.option("basePath", f"{root}/v{version}").parquet(*files)
    for c, v in wanted.items():
        found = found.where(F.col(c) == v)
    n = found.limit(2).count()
    if n != 1:
        raise LookupError(f"{'no row' if n == 0 else 'several rows'} for {wanted}")
    return found

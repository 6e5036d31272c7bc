"""The Parquet lake of evidence batches: layout, chunks, manifests, exports, idempotent appends, retention plans, salvage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklot.functions.identity import deterministic_uuid, flatten_nested
from tracklot.sources.scratch import is_whole, materialize

DATASETS = ("sightings", "observations", "probes", "cycles")


def write_lake(df: DataFrame, root: str, event_type: str, occurred: str, version: int = 1, producer: str = "tracklot") -> None:
    """Append a batch under ``v{n}/event_type=…/occurred_on=…``, nested values as JSON, zstd."""
    out = flatten_nested(df).withColumns({"event_type": F.lit(event_type), "occurred_on": F.to_date(occurred), "producer": F.lit(producer)})
    out.write.mode("append").partitionBy("event_type", "occurred_on").option("compression", "zstd").parquet(f"{root}/v{version}")


def read_lake(spark: SparkSession, root: str, event_type: str, start: str | None = None, end: str | None = None, version: int = 1) -> DataFrame:
    """Batches of a type and date range; both filters prune partitions."""
    df = spark.read.option("mergeSchema", "true").parquet(f"{root}/v{version}").where(F.col("event_type") == event_type)
    df = df.where(F.col("occurred_on") >= F.lit(start).cast("date")) if start else df
    return df.where(F.col("occurred_on") <= F.lit(end).cast("date")) if end else df


def choose_datasets(names: list[str] | None) -> list[str]:
    """``all`` or a subset, in fixed order; unknown names are refused."""
    wanted = {n.strip().lower() for n in names or ["all"]}
    if unknown := wanted - {*DATASETS, "all"}:
        raise ValueError(f"unknown datasets: {', '.join(sorted(unknown))}")
    return [d for d in DATASETS if "all" in wanted or d in wanted]


def export_sightings(sightings: DataFrame, cards: DataFrame, catalogs: DataFrame, scans: DataFrame) -> DataFrame:
    """One row per sighting with its scan and catalog; missing card fields come from the listing's card."""
    fields = ("title", "brand", "condition_label", "price_amount_cents")
    card = cards.select("listing_id", *[F.col(c).alias(f"card_{c}") for c in fields])
    leaf = catalogs.select("catalog_id", F.col("title").alias("catalog_title"))
    scan = scans.select("catalog_id", "run_id", "fetched_at", "success")
    out = sightings.join(card, "listing_id", "left").join(leaf, "catalog_id", "left").join(scan, ["catalog_id", "run_id"], "left")
    return out.withColumns({c: F.coalesce(c, f"card_{c}") for c in fields}).drop(*[f"card_{c}" for c in fields])


def export_observations(obs: DataFrame, cards: DataFrame) -> DataFrame:
    return obs.select("run_id", "listing_id", "observed_at", "sighting_count", "card_position").join(cards.select("listing_id", "title", "brand", "catalog_path"), "listing_id", "left")


def export_probes(probes: DataFrame, cards: DataFrame) -> DataFrame:
    return probes.join(cards.select("listing_id", "title", "catalog_id"), "listing_id", "left").withColumn("probed_on", F.to_date("probed_at"))


def export_cycles(cycles: DataFrame) -> DataFrame:
    return flatten_nested(cycles)


#: Rows of a task where rows are sorted.
TASK_ROWS = 250_000
#: Stretches of batches up to which their starts are broadcast.
BROADCAST_STRETCHES = 100_000


def tasks_for(df: DataFrame, rows: int) -> int:
    """As many tasks as a number of rows asks for, so that a task's share does not grow with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def assign_chunks(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """Batches of at most ``size`` rows in each group: chunk_index, chunk_count and row_index within the chunk.

    All rows are sorted by group and order in ranges, set aside and numbered within their range; a group that fills many
    ranges is in no task as a whole. A row per group and range tells at which number of its group a range begins.
    """
    by = [*[F.col(k) for k in keys], *order]
    ranged = df.repartitionByRange(tasks_for(df, df.count()), *by).sortWithinPartitions(*by)
    ranged = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranged").withColumn("_range", F.shiftright("_id", 33))
    names = [f"_key{i}" for i in range(len(keys))]
    starts = ranged.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_range").alias("_at")).agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    group = Window.partitionBy(*names)
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(starts.withColumns({"_start": before, "_n": F.sum("_rows").over(group)}), "starts")
    on = F.col("_range") == F.col("_at")
    for k, n in zip(keys, names):
        on &= F.col(k).eqNullSafe(F.col(n))
    out = ranged.join(F.broadcast(starts) if starts.count() <= BROADCAST_STRETCHES else starts, on).withColumn("_rn", F.col("_start") + F.col("_id") - F.col("_first"))
    out = out.withColumns({"chunk_index": F.floor(F.col("_rn") / size), "chunk_count": F.ceil(F.col("_n") / size), "row_index": F.col("_rn") % size})
    return out.drop("_id", "_range", "_at", "_first", "_rows", "_start", "_n", "_rn", *names)


def build_manifests(df: DataFrame, keys: list[str], ts: str, id_col: str) -> DataFrame:
    """One row per batch: time window, rows, a checksum of its ids in any order, and a deterministic manifest id.

    The checksum adds up two parts of each id's digest, so a batch of any size is summed before it meets in one row.
    """
    part = lambda at: F.sum(F.conv(F.substring(F.sha2(F.col(id_col).cast("string"), 256), at, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    rows = df.groupBy(*keys).agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count("*").alias("row_count"), F.concat_ws("-", part(1), part(16)).alias("checksum"))
    return rows.withColumn("manifest_id", deterministic_uuid("manifest", **{k: F.col(k).cast("string") for k in keys}))


def append_missing(df: DataFrame, target: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows to append: those whose id the target lacks, each id once."""
    return df.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def of_batches(target: DataFrame, lot: DataFrame, key: list[str]) -> DataFrame:
    """The target's rows of a lot's batches: those that a lot which comes again can meet. The lot's keys, few, go to the target, which does not move."""
    return target.join(F.broadcast(lot.select(*key).distinct()), key, "left_semi")


def existing(df: DataFrame, target: DataFrame, key: str = "event_id") -> DataFrame:
    return df.select(key).intersect(target.select(key))


def backfill(batches: DataFrame, ledger: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Batches not yet delivered, and counts of what a run would deliver or skip."""
    todo = batches.join(ledger.select(*key).distinct(), key, "left_anti")
    done = batches.join(ledger.select(*key).distinct(), key, "left_semi")
    counts = todo.agg(F.count("*").alias("to_deliver")).crossJoin(done.agg(F.count("*").alias("to_skip")))
    return todo, counts


def run_backfill(spark: SparkSession, rows: DataFrame, key: list[str], ledger: str, deliver: Callable[[DataFrame], None], batches: int = 50) -> int:
    """Deliver the batches (rows with equal ``key``) that the ledger lacks, some at a time, and enter each lot once it is delivered.

    A run that was cut off goes on with the lot that it was at; that lot comes again, so ``deliver`` must pass over rows
    that are there (``append_missing``). Returns the number of lots. The driver loops over lots, not over rows.
    """
    known = rows.select(*key).distinct()
    todo = known.join(spark.read.parquet(ledger).select(*key), key, "left_anti") if is_whole(spark, ledger) else known
    lot = F.floor((F.row_number().over(Window.orderBy(*key)) - 1) / batches)  # a row per batch
    todo = materialize(todo.withColumn("lot", lot), "backfill")
    lots = todo.agg(F.max("lot")).first()[0]
    for i in range(0 if lots is None else lots + 1):
        own = todo.where(F.col("lot") == i).drop("lot")
        deliver(rows.join(own, key, "left_semi"))
        own.write.mode("append").parquet(ledger)
    return 0 if lots is None else lots + 1


def plan_retention(df: DataFrame, ts: str, cutoff, protected: DataFrame, key: str) -> DataFrame:
    """Rows older than the cutoff, marked ``archive`` or ``protected``; apply by writing the former elsewhere first."""
    old = df.where(F.col(ts) < F.lit(str(cutoff)).cast("timestamp"))
    kept = protected.select(key).distinct().withColumn("_p", F.lit(True))
    return old.join(kept, key, "left").withColumn("action", F.when(F.col("_p"), "protected").otherwise("archive")).drop("_p")


def retention_report(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("matched"), F.count_if(F.col("action") == "archive").alias("archived"), F.count_if(F.col("action") == "protected").alias("protected"))


def table_health(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Per table: exists, rows, can be sampled, error. A loop over table names; rows stay on executors."""
    out = []
    for name, path in paths.items():
        try:
            df = spark.read.parquet(path)
            out.append((name, True, df.count(), bool(df.limit(1).collect()), None))
        except AnalysisException as error:
            out.append((name, False, None, False, str(error).splitlines()[0][:200]))
    return spark.createDataFrame(out, "name string, present boolean, row_count long, sampled boolean, error string")


def salvage_tables(spark: SparkSession, paths: dict[str, str], target: str) -> DataFrame:
    """Copy of every table what can be read, and report each file: its rows, and whether it was copied or skipped.

    Files that cannot be read are passed over by the reader and named here, since none of their rows came; a table of which
    nothing can be read has its files all skipped. The driver loops over table names.
    """
    report, same = None, lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select(same("path").alias("file"), "length")
        try:
            rows = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
            rows.write.mode("overwrite").parquet(f"{target}/{name}")
            counts = rows.select(same("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("rows"))
            files = files.join(counts, "file", "left")
        except AnalysisException:  # no file has a schema to read
            files = files.withColumn("rows", F.lit(None).cast("long"))
        found = files.select(F.lit(name).alias("name"), "file", "length", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("rows").isNull(), "skipped").otherwise("copied").alias("action"))
        report = found if report is None else report.unionByName(found)
    return report


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

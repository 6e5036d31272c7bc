"""Archive and prune: old rows go to an archive, are checked there, and only then leave the table. Every step may be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklot.sources.lake import plan_retention, retention_report
from tracklot.sources.scratch import delete, is_whole


def _sums(df: DataFrame) -> tuple:
    """Rows and the sum of their hashes, whatever their order and partitions."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first())


def apply_retention(spark: SparkSession, table: str, archive: str, ts: str, cutoff, protected: DataFrame, key: str, partition: str, run: str) -> DataFrame:
    """Move the rows of a partitioned table that are older than ``cutoff``, protected keys apart, to ``archive``; returns the run's report.

    Plan, archive, kept rows and report are folders of the run; each is written once and found again when a run that was
    cut off starts anew, so it goes on where it stopped. Only partitions that lose rows are written, from the kept rows that
    were set aside before; partitions that keep none are deleted. A run that has its report does nothing. Nothing else may
    write to those partitions meanwhile: if rows came before they were set aside, the run stops with an error.
    """
    work, target = f"{archive}/_runs/{run}", f"{archive}/rows/run={run}"
    report = f"{work}/report"
    if is_whole(spark, report):
        return spark.read.parquet(report)
    if not is_whole(spark, f"{work}/plan"):
        plan_retention(spark.read.parquet(table), ts, cutoff, protected, key).write.mode("overwrite").parquet(f"{work}/plan")
    plan = spark.read.parquet(f"{work}/plan")
    leaving = plan.where("action = 'archive'").drop("action")
    if not is_whole(spark, target):
        leaving.write.mode("overwrite").option("compression", "zstd").parquet(target)
    n = _sums(leaving)
    if _sums(spark.read.parquet(target).select(*leaving.columns)) != n:
        raise ValueError(f"the archive of run {run} is not what was planned")
    if n[0]:
        touched = leaving.select(partition).distinct()
        if not is_whole(spark, f"{work}/kept"):
            rows = spark.read.parquet(table)
            rows = rows.join(touched.withColumnRenamed(partition, "_p"), F.col(partition).eqNullSafe(F.col("_p")), "left_semi")
            flags = protected.select(F.col(key).alias("_k")).distinct()
            old = F.coalesce(F.col(ts) < F.lit(str(cutoff)).cast("timestamp"), F.lit(False))
            kept = rows.where(~old).unionByName(rows.where(old).join(flags, F.col(key) == F.col("_k"), "left_semi"))
            kept.write.mode("overwrite").parquet(f"{work}/kept")
            if rows.count() != n[0] + spark.read.parquet(f"{work}/kept").count():
                delete(spark, f"{work}/kept")
                raise ValueError(f"rows came to partitions of run {run} while it was planned")
        kept = spark.read.parquet(f"{work}/kept")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(table)
        # names of partitions, never rows
        for r in touched.join(kept.select(F.col(partition).alias("_p")).distinct(), F.col(partition).eqNullSafe(F.col("_p")), "left_anti").collect():
            delete(spark, f"{table}/{partition}={'__HIVE_DEFAULT_PARTITION__' if r[0] is None else r[0]}")
    retention_report(plan).withColumn("deleted", F.col("archived")).write.mode("overwrite").parquet(report)
    delete(spark, f"{work}/plan")
    delete(spark, f"{work}/kept")
    return spark.read.parquet(report)

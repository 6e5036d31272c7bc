"""Data-quality checks: reconciliation, parity, constraints, pipeline audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_window(df: DataFrame, ts: str, name: str) -> DataFrame:
    return df.agg(F.lit(name).alias("dataset"), F.count("*").alias("row_count"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Counts and windows of both stores by dataset, with a status each."""
    a = actual.select("dataset", *[F.col(c).alias(f"actual_{c}") for c in ("row_count", "first_at", "last_at")])
    both = expected.join(a, "dataset", "full")
    counts = F.col("row_count").eqNullSafe(F.col("actual_row_count"))
    windows = F.col("first_at").eqNullSafe(F.col("actual_first_at")) & F.col("last_at").eqNullSafe(F.col("actual_last_at"))
    status = F.when(F.col("actual_row_count").isNull() | F.col("row_count").isNull(), "missing").when(counts & windows, "match").otherwise("mismatch")
    return both.withColumns({"count_match": counts, "window_match": windows, "status": status})


def parity(a: DataFrame, b: DataFrame, drop_cols: tuple[str, ...] = ()) -> DataFrame:
    """Rows that one side has more often than the other, by hash of the row; the sums meet in one aggregate, not in a multiset join."""
    names = sorted(set(a.columns) - set(drop_cols))
    side = lambda df, n: df.select(F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256).alias("row_hash"), F.lit(n).alias("n"))
    return side(a, 1).unionAll(side(b, -1)).groupBy("row_hash").agg(F.sum("n").alias("surplus")).where("surplus <> 0")


def check_constraints(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break each check (a null counts as broken), in one pass."""
    row = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in checks])))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.where(F.col(key).isNotNull()).join(parent, key, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def pipeline_audit(health: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Consumers and datasets with a status each: healthy, lagging or failed."""
    consumers = health.select(F.col("consumer").alias("path"), F.when(F.col("status") == "failed", "failed").when(F.col("lag_seconds") > 300, "lagging").otherwise("healthy").alias("status"))
    sets = reconciled.select(F.col("dataset").alias("path"), F.when(F.col("status") == "match", "healthy").when(F.col("status") == "mismatch", "lagging").otherwise("failed").alias("status"))
    return consumers.unionByName(sets)

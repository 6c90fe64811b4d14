"""Writing by key: set-based upserts, counts, rejects, versions and partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(updates: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One row a key: the last by the order column, else any one of equal keys that sorts last as a whole."""
    by = [F.col(order).desc()] if order else [F.col(c).desc() for c in updates.columns if c not in keys]
    return updates.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_r = 1").drop("_r")


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """target with the updates' rows in place of those of equal keys. The target is only read by an anti join; columns that the updates lack are null in new rows."""
    new = latest_by_key(updates, keys, order)
    kept = target.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True).select(*target.columns, *[c for c in new.columns if c not in target.columns])


def valid_rows(updates: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with all required columns, rejects with the reason)."""
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    df = updates.withColumn("missing", missing)
    return df.filter("missing = ''").drop("missing"), df.filter("missing <> ''")


def upsert_counts(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """total, inserted, updated, errors of a bulk upsert, by key; rows without a key are errors."""
    good, bad = valid_rows(updates, keys)
    there = target.select(*keys).distinct().withColumn("_there", F.lit(1))
    rows = good.select(*keys).distinct().join(there, list(keys), "left").agg(F.count_if(F.col("_there").isNull()).alias("inserted"), F.count_if(F.col("_there") == 1).alias("updated"))
    counts = updates.agg(F.count("*").alias("total")).join(F.broadcast(bad.agg(F.count("*").alias("errors"))))
    return counts.join(F.broadcast(rows))


def write_partitions(df: DataFrame, path: str, by: Sequence[str] = ("season", "gameweek"), within: Sequence[str] = ("player_id",)) -> None:
    """Touched partitions are replaced as a whole, the others stay. df must not be read from the same path; upsert into a new version for that."""
    df.repartition(*by).sortWithinPartitions(*by, *within).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_partitions(target_path: str, updates: DataFrame, staging_path: str, keys: Sequence[str] = ("player_id", "season", "gameweek"), by: Sequence[str] = ("season", "gameweek")) -> None:
    """Upsert into a partitioned table, reading and replacing only the partitions that the updates touch. The merged rows are staged first, so nothing is read and overwritten in one plan."""
    spark = updates.sparkSession
    touched = updates.select(*by).distinct()
    target = spark.read.parquet(target_path).join(touched, list(by), "left_semi")
    upsert(target, updates, keys).write.mode("overwrite").parquet(staging_path)
    write_partitions(spark.read.parquet(staging_path), target_path, by)


def backfilled(df: DataFrame, key: str, lookup: DataFrame, on: str, value: str) -> DataFrame:
    """Nulls of a key column filled from another table."""
    look = lookup.select(F.col(on).alias("_on"), F.col(value).alias("_value")).dropDuplicates(["_on"])
    return df.join(look, df[on] == F.col("_on"), "left").withColumn(key, F.coalesce(F.col(key), F.col("_value"))).drop("_on", "_value")


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed where they exist and the new name is free."""
    for old, new in names.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def save_summary(stored: DataFrame, metrics: DataFrame, model_version: str) -> DataFrame:
    """Stored backtest summaries with these metrics in place of the version's earlier ones."""
    return upsert(stored, metrics.withColumn("model_version", F.lit(model_version)), ["model_version"])


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)

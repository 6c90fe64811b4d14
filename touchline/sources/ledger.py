"""Landed files into a store of facts, each file once: a ledger of files taken (path, size, time) is joined before anything is read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.upsert import latest_by_key, upsert_partitions, write_partitions

FILE = "path string, length long, modificationTime timestamp"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def taken_files(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(FILE).parquet(ledger) if _there(spark, ledger) else spark.createDataFrame([], FILE)


def new_files(spark: SparkSession, folder: str, ledger: str, glob: str = "*.parquet") -> DataFrame:
    """Files below the folder that the ledger lacks, or knows with another size or time. Only the listing is read, no content."""
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    except AnalysisException:
        if _there(spark, folder):
            raise
        return spark.createDataFrame([], FILE)
    return listed.select("path", "length", "modificationTime").join(taken_files(spark, ledger), ["path", "length", "modificationTime"], "left_anti")


def sync(spark: SparkSession, folder: str, store: str, ledger: str, staging: str, facts_of: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("player_id", "season", "gameweek"), by: Sequence[str] = ("season", "gameweek")) -> int:
    """New files through facts_of into the store by key; the number of files taken.

    The ledger is written last: a run that ends before takes the same files again and, as facts go in by key, stores the same. What comes to the driver is the names of new files,
    as a reader's listing does. Of equal keys in one run the row that sorts last is kept.
    """
    fresh = new_files(spark, folder, ledger).collect()
    if not fresh:
        return 0
    facts = facts_of(spark.read.parquet(*[r["path"] for r in fresh]))
    if _there(spark, store):
        upsert_partitions(store, facts, staging, keys, by)
    else:
        write_partitions(latest_by_key(facts, keys), store, by)
    spark.createDataFrame(fresh, FILE).write.mode("append").parquet(ledger)
    return len(fresh)

"""Tables written once to the shared folder, where lineage ends and lost executors do no harm."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and all runs in one process (tests), below a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{shared}/touchline-{uuid.uuid4().hex}"


def stage_in(spark: SparkSession, base: str | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a frame under a label and reads it back."""
    folder = f"{base}/touchline-{uuid.uuid4().hex}" if base else shared_folder(spark)

    def stage(df: DataFrame, label: str) -> DataFrame:
        path = f"{folder}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return stage

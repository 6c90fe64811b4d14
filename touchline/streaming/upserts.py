"""Upserts from a stream, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from touchline.sources.upsert import latest_by_key, upsert_partitions


def stream_upserts(updates: DataFrame, table_path: str, work_path: str, keys: Sequence[str] = ("player_id", "season", "gameweek"), by: Sequence[str] = ("season", "gameweek")) -> StreamingQuery:
    """Starts a query that merges each micro-batch into the partitioned table. A batch that is run again after a failure gives the same table."""

    def merge(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            upsert_partitions(table_path, latest_by_key(batch, keys), f"{work_path}/staging/{number}", keys, by)

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", f"{work_path}/checkpoint").trigger(availableNow=True).start()

"""Incremental ingestion: each micro-batch adds what the catalog does not have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plinth.sources.store import changed


def ingest(facts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append new (path, fingerprint) rows of a stream to the Parquet table at ``path``; a batch that runs again after
    a failure adds nothing twice, because its rows are in the table already."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.schema(batch.schema).parquet(path)
            fresh = changed(batch.dropDuplicates(["path", "fingerprint"]), known.select("path", "fingerprint"))
        except Exception as error:  # noqa: BLE001  only a table that is not there yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            fresh = batch.dropDuplicates(["path", "fingerprint"])
        fresh.write.mode("append").parquet(path)

    return facts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

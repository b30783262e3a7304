"""Streaming ingest of crawl results with restart safety."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from rankloom.sources.scans import read_stored


def ingest(stream: DataFrame, target: str, checkpoint: str) -> DataStreamWriter:
    """Append each micro-batch's new (query, url) rows to ``target``.

    Keys seen so far are the state of the stream's own deduplication: it is
    partitioned by key, kept in the checkpoint and read only for the keys of a
    batch, so a batch's work follows its own rows and not what is stored (use
    the RocksDB state store where keys outgrow memory). Every batch writes its
    own folder, so a batch replayed after a failure overwrites what it wrote
    before; state and files then agree again.
    """
    keyed = stream.filter(F.trim("url") != "").dropDuplicates(["query", "url"])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return keyed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_ingested(spark, target: str) -> DataFrame | None:
    return read_stored(spark, target)

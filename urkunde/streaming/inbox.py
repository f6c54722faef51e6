"""An inbox of text records, extracted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import metadata


def extracted(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string") -> DataFrame:
    """Metadata of the Parquet files in a folder, as a stream."""
    return metadata(spark.readStream.schema(schema).parquet(folder))


def drain(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived as Parquet and ends."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

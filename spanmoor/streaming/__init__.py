"""Streams of documents with model output: extraction keeps no state, so a
stream's rows go through the plan of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.run import extract


def read_outputs(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, raw string") -> DataFrame:
    """A stream of JSON lines as they arrive in a folder."""
    return spark.readStream.schema(schema).json(folder)


def extract_stream(outputs: DataFrame, path: str, checkpoint: str, threshold: float = 0.75) -> StreamingQuery:
    """Writes the spans of each batch as Parquet, once each."""
    spans = extract(outputs, threshold=threshold)
    return spans.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

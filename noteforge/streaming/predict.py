"""Prediction on streams: each document alone, so no state, no watermark and no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from noteforge.plans.pipeline import Deidentifier


def document_stream(spark: SparkSession, folder: str, schema, files_at_once: int | None = None) -> DataFrame:
    """Documents of parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(folder)


def predict_stream(pipeline: Deidentifier, docs: DataFrame, target: str, checkpoint: str, routing: str | float | None = None) -> StreamingQuery:
    """Entities of streamed documents appended to parquet files, each exactly once; what is there is worked off, then the query ends."""
    found = pipeline.predict(docs, routing)
    return found.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

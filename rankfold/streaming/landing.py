"""Stateless stages over newly landed files.

Every run of the engine starts from empty state, so nothing here keeps any:
parsing, title gate and date tests are projections and filters that accept a
streaming DataFrame as they are.  A stream appends canonical postings to a
table; keep-first, cap and ranking then run in batch over that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rankfold.sources.landed import LANDED_SCHEMAS


def stream_landed(spark: SparkSession, table: str, path: str, file_format: str = "parquet",
                  files_per_trigger: int | None = None) -> DataFrame:
    """A landed folder as a stream: only files not seen before are read."""
    reader = spark.readStream.format(file_format).schema(LANDED_SCHEMAS[table])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def append_postings(postings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends parsed postings to a Parquet table, once per landed file.

    Handles what is there and stops, so it can be scheduled like a batch job.
    ``checkpoint`` remembers what was read: the same folder in every run.
    """
    return (
        postings.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )

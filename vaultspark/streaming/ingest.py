"""Structured Streaming over a growing vault: new notes as they appear, tag counts and chunks of them.

A file stream sees files that are new, not edits nor losses; those are what `plans.index` compares
hashes for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.outline import headings
from ..operators.tasks import extract


def note_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """NOTES of the Markdown files that appear below `path`; names beginning with `_` or `.` are not seen."""
    found = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", files_per_trigger).load(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return found.select(F.col("_metadata.file_path").alias("path"), F.url_decode(name).alias("file_name"), F.col("value").alias("content"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"))


def tag_counts(notes: DataFrame, watermark: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """(window, tag, n) of inline tags by the time of the file; late files are taken until the watermark."""
    tags = notes.withWatermark("mtime", watermark).select("mtime", F.explode(F.regexp_extract_all("content", F.lit(r"(?U)#(\w+)"), F.lit(1))).alias("tag"))
    return tags.groupBy(F.window("mtime", window), "tag").agg(F.count("*").alias("n"))


def task_stream(notes: DataFrame) -> DataFrame:
    return extract(notes)


def heading_stream(notes: DataFrame) -> DataFrame:
    return headings(notes)


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there to Parquet, once, and stop; started again it goes on where it ended."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()

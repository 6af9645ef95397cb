"""Incremental mode as a stream: new and changed source files come in, and their nodes are appended.

The file source keeps its own log of what it has seen in the checkpoint folder, so a restarted query goes on where it was,
and availableNow handles what has arrived and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions.text import annotations
from loomgraph.sources.files import language

BINARY = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, language, at) of files as they appear under root."""
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(root)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"), language(F.col("path")).alias("language"), F.col("modificationTime").alias("at"))


def annotation_stream(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the annotations of new files to `out` and ends when all that is there has been read."""
    notes = annotations(file_stream(spark, root).filter("language IS NOT NULL"))
    return notes.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n) of events(ts, event_type) in tumbling windows, events later than `late` left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

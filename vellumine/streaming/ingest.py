"""Streams: folders of PDF files as they arrive, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.operators import pdf as P

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def arriving(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """(doc_id, content, seen): PDF files as they come into a folder, a bounded number a trigger."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", per_trigger).load(path)
    return files.select(F.col("path").alias("doc_id"), "content", F.col("modificationTime").alias("seen"))


def text_stream(files: DataFrame, **options) -> DataFrame:
    """Pages' text of a stream of files: a relation is a map over rows, so it streams as it is."""
    return P.relation(files, "text", **options)


def once(files: DataFrame, within: str = "1 hour") -> DataFrame:
    """Files whose bytes weren't seen within a time: state is bounded by the watermark."""
    return files.withColumn("digest", F.sha2("content", 256)).withWatermark("seen", within).dropDuplicatesWithinWatermark(["digest"])


def windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours", ts: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums of events by tumbling windows; the same plan for a table or a stream."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.window(ts, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")

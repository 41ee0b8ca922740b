"""Payload streams (S5, R1, R2): file source, validation, flush trigger, duplicates."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from keystride import schema as S
from keystride.sources.payloads import CORRUPT, IDENTITY, accept, explode_events


def payload_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(f"{S.PAYLOAD}, {CORRUPT} string")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )


def text_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Request bodies as text, for streams that quarantine what is not a payload."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
        .withColumnRenamed("value", "raw")
    )


def accepted_events(texts: DataFrame) -> DataFrame:
    return explode_events(accept(texts)[0])


def store_rejected(
    texts: DataFrame, path: str, checkpoint: str, continuous: bool = False
) -> StreamingQuery:
    """Append request bodies that are not payloads to a text table, as they came."""
    rejected = accept(texts)[1]
    return start(
        rejected.writeStream.format("parquet").option("path", path), checkpoint, continuous
    )


def distinct_events(events: DataFrame, delay: str) -> DataFrame:
    """Events of a stream without resent copies.

    A copy counts as one while it arrives within `delay` of the first; the state kept is one
    key per event of that span, spread over all tasks.
    """
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(IDENTITY)


def start(writer: DataStreamWriter, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Run on the client's flush interval, or over everything there is and then stop."""
    writer = writer.option("checkpointLocation", checkpoint)
    if continuous:
        return writer.trigger(processingTime=S.FLUSH_INTERVAL).start()
    return writer.trigger(availableNow=True).start()


def store_events(
    events: DataFrame, path: str, checkpoint: str, continuous: bool = False
) -> StreamingQuery:
    """Append events to a Parquet table partitioned by day."""
    dated = events.withColumn("event_date", F.to_date("event_time"))
    return start(
        dated.writeStream.format("parquet").partitionBy("event_date").option("path", path),
        checkpoint, continuous,
    )

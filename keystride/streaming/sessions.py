"""Session features and scores on streams."""

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystride.plans import registry
from keystride.session import discard, materialise, rocksdb_state
from keystride.streaming.ingest import start


def closed_sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions that ended: no event for `gap`, and the watermark has passed the end.

    With the setting of `session.build`, rows merge before the shuffle, so a busy session sends
    one row per task and batch.
    """
    return (
        events.withWatermark("event_time", delay)
        .groupBy("session_id", F.session_window("event_time", gap).alias("s"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("lane") == "key").alias("key_events"),
            F.count_if(F.col("lane") == "click").alias("clicks"),
            F.min("event_time").alias("session_start"),
            F.max("event_time").alias("last_event"),
        )
        .select("session_id", "session_start", "last_event", "events", "key_events", "clicks")
    )


def features_of_closed(
    closed: DataFrame,
    stored: Callable[[], DataFrame],
    features: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    continuous: bool = False,
) -> StreamingQuery:
    """Order-dependent features of each session once it has closed.

    The stream only decides *which* sessions are complete. Their events come from the stored
    event table, read for the days in question, and go through the batch operators - with
    their handling of oversized sessions - instead of growing a state per session. The table
    is filled by `store_events` from the same intake. Sessions whose events are not all there yet wait in a
    table below `path` and are looked at again with the next batch, so a lagging intake delays features and
    fails nothing. Every micro-batch owns its folders and overwrites them, so a replayed batch changes nothing;
    what it wrote for itself is deleted at its end.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, ["session_id", "session_start", "last_event", "events"]
        fresh = batch.select(*columns)
        before = _waiting(spark, path, batch_id)
        # Written once: every further read of a stateful batch would run its state again.
        ended = materialise(fresh if before is None else fresh.unionByName(before), "closed")
        days = ended.agg(
            F.to_date(F.min("session_start")), F.to_date(F.max("last_event"))
        ).first()
        if days[0] is None:
            return discard(ended)
        events = stored().filter(F.col("event_date").between(days[0], days[1]))
        named = F.concat_ws("@", F.col("e.session_id"), F.unix_micros("s.session_start"))
        members = (
            events.alias("e")
            .join(
                ended.alias("s"),
                (F.col("e.session_id") == F.col("s.session_id"))
                & F.col("e.event_time").between(F.col("s.session_start"), F.col("s.last_event")),
            )
            .select("e.*", named.alias("window_id"))
            .withColumn("session_id", F.col("window_id"))
            .drop("window_id")
        )
        # Written as well: the count below and the features must see the same table.
        members = materialise(members, "closed-events")
        held = members.groupBy("session_id").agg(F.count(F.lit(1)).alias("held"))
        name = F.concat_ws("@", "session_id", F.unix_micros("session_start"))
        # Late events that the watermark left out of the count may be in the table, and then count.
        judged = ended.withColumn("name", name).join(held.withColumnRenamed("session_id", "name"), "name", "left")
        judged = materialise(judged.withColumn("whole", F.coalesce("held", F.lit(0)) >= F.col("events")), "judged")
        judged.where(~F.col("whole")).select(*columns).write.mode("overwrite").parquet(f"{path}/_waiting/{batch_id}")
        whole = judged.where("whole").select(F.col("name").alias("session_id"))
        started = F.regexp_extract("session_id", "@(\\d+)$", 1).cast("long")
        (
            features(members.join(whole, "session_id", "left_semi"))
            .withColumn("session_start", F.timestamp_micros(started))
            .withColumn("session_id", F.regexp_replace("session_id", "@\\d+$", ""))
            .write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        )
        for table in (ended, members, judged):
            discard(table)

    return start(closed.writeStream.foreachBatch(process), checkpoint, continuous)


def _waiting(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Sessions left waiting by the last batch before this one; a batch without rows leaves no table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_waiting")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    known = [int(f.getPath().getName()) for f in files.listStatus(folder)]
    last = max((n for n in known if n < batch_id), default=None)
    return None if last is None else spark.read.parquet(f"{path}/_waiting/{last}")


def score_stream(
    rows: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    continuous: bool = False,
) -> StreamingQuery:
    """Score arriving feature rows with a fitted model into a risk table."""

    def process(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with rocksdb_state(rows.sparkSession):
        return start(rows.writeStream.foreachBatch(process), checkpoint, continuous)


def score_with_current(
    rows: DataFrame,
    root: str,
    load: Callable[[SparkSession, str], Any],
    score: Callable[[Any, DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    continuous: bool = False,
) -> StreamingQuery:
    """Score arriving feature rows with the saved model that is in use when their batch starts.

    A promotion takes effect with the next batch, without a restart. The version of a batch is noted
    before it is scored, so a replayed batch gets the model it had; without a model the stream stops
    and goes on from there once one is promoted. `score` must need its rows once only.
    """
    loaded: dict[str, Any] = {}

    def process(batch: DataFrame, batch_id: int) -> None:
        spark, note = batch.sparkSession, f"{path}/_versions/{batch_id}"
        version = registry.get_text(spark, note) or registry.current(spark, root)
        if version is None:
            raise RuntimeError(f"no model is in use below {root}")
        registry.put_text(spark, note, version)
        if version not in loaded:
            loaded.clear()
            loaded[version] = load(spark, registry.version_path(root, version))
        scored = score(loaded[version], batch).withColumn("model_version", F.lit(version))
        scored.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with rocksdb_state(rows.sparkSession):
        return start(rows.writeStream.foreachBatch(process), checkpoint, continuous)

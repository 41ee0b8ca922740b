"""Session payloads: read, write, validate, take apart and put together."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystride import schema as S
from keystride.functions.scalars import iso_timestamp
from keystride.operators.slicing import SLICE, per_group, position

CORRUPT = "_corrupt_record"
# Indented documents span lines, so a file of many needs another separator: the record
# separator of JSON text sequences (RFC 7464).
RECORD_SEPARATOR = "\x1e"
# About the year 9999; microseconds beyond it leave the range of a timestamp.
MOST_SECONDS = 253_402_300_799
# Elements without a position get one from the payload time and their index.
POSITIONS_PER_MILLI = 1_000_000
PAYLOADS_PER_MILLI = 10_000
# The client flushes on this clock, and at 50 events: its documents hold no more.
FLUSH_SECONDS = 5
BLOCK = 50
# Why a request body is refused.
NO_FIELDS = "Missing required fields"
NO_OBJECT = "Not a JSON object"
LOSSY = "A field or time cannot be read"
# Fields that make two events the same event.
IDENTITY = ["session_id", "lane", "kind", "key_code", "x", "y", "button", "t"]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines, one payload per line; unreadable lines keep their text in a column."""
    return (
        spark.read.schema(f"{S.PAYLOAD}, {CORRUPT} string")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stored event table, partitioned by day."""
    return spark.read.schema(f"{S.EVENT}, event_date date").parquet(path)


def append_log(payloads: DataFrame, path: str) -> None:
    payloads.write.mode("append").json(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Indented documents, one per file."""
    return spark.read.schema(S.PAYLOAD).option("multiLine", True).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Indented documents, many per file; files stay splittable."""
    return (
        spark.read.option("lineSep", RECORD_SEPARATOR).text(path)
        .filter(F.trim("value") != "")
        .select(F.from_json("value", S.PAYLOAD).alias("payload"))
        .select("payload.*")
    )


def write_documents(payloads: DataFrame, path: str) -> None:
    (
        payloads.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))
        .write.option("lineSep", RECORD_SEPARATOR).text(path)
    )


def write_document(payload: DataFrame, path: str) -> None:
    """One indented document per file, for the export of a single session."""
    (
        payload.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))
        .write.option("maxRecordsPerFile", 1).text(path)
    )


def validate(texts: DataFrame, raw: str = "raw") -> DataFrame:
    """Add `is_valid`: the text is a JSON object that has every required key.

    Presence counts, not the value: a null session_id passes.
    """
    keys = F.json_object_keys(F.col(raw))
    present = F.lit(True)
    for field in S.REQUIRED_FIELDS:
        present = present & F.array_contains(keys, field)
    return texts.withColumn("is_valid", F.coalesce(present, F.lit(False)))


def accept(texts: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Parsed payloads, and the texts to quarantine, with the reason: those that are no payload, and
    those of which a field or a time would be lost in parsing."""
    checked = validate(texts, raw).withColumn("payload", F.from_json(
        F.col(raw), f"{S.PAYLOAD}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}
    ))
    # A field of the wrong type would parse to NULL and its events vanish; so would a time
    # that no timestamp holds.
    times = [F.col(f"payload.{f}.timestamp") for f in ("keystroke_data", "mouse_data")]
    late = [F.coalesce(F.exists(t, lambda x: F.abs(x) > MOST_SECONDS), F.lit(False)) for t in times]
    whole = F.col("is_valid") & F.col(f"payload.{CORRUPT}").isNull() & ~late[0] & ~late[1]
    checked = checked.withColumn("is_whole", F.coalesce(whole, F.lit(False)))
    parsed = checked.filter("is_whole").select("payload.*").drop(CORRUPT)
    reason = F.when(F.col("is_valid"), LOSSY).when(F.json_object_keys(F.col(raw)).isNull(), NO_OBJECT).otherwise(NO_FIELDS)
    refused = checked.filter(~F.col("is_whole")).withColumn("reason", reason)
    return parsed, refused.drop("is_valid", "is_whole", "payload")


def explode_events(payloads: DataFrame) -> DataFrame:
    """Key and mouse elements of all payloads as event rows, in one pass over the payloads."""
    # A payload whose time does not parse counts as sent with its first event.
    earliest = [F.array_min(F.transform(c, lambda e: e["timestamp"])) for c in ("keystroke_data", "mouse_data")]
    begun = F.try_multiply(F.least(*earliest), F.lit(1000.0)).try_cast("long")
    sent = F.coalesce(F.unix_millis(F.col("timestamp").try_cast("timestamp")), begun, F.lit(0))
    # Payloads of one millisecond are told apart by what they hold, with nothing the client would have to send.
    told = F.pmod(F.xxhash64("session_id", "timestamp", "keystroke_data", "mouse_data"), F.lit(PAYLOADS_PER_MILLI))
    first = F.coalesce(F.try_add(F.try_multiply(sent, F.lit(POSITIONS_PER_MILLI)), told * (POSITIONS_PER_MILLI // PAYLOADS_PER_MILLI)), F.lit(0))
    # Mouse elements count on after the key elements of their payload.
    keys_before = F.greatest(F.coalesce(F.size("keystroke_data"), F.lit(0)), F.lit(0))

    def event(e: Column, i: Column, lane: Column, **fields: Column) -> Column:
        absent = {"key_code": "int", "x": "double", "y": "double", "button": "string"}
        return F.struct(
            F.coalesce(e["pos"], first + i).alias("pos"),
            F.timestamp_micros(F.round(e["timestamp"] * 1e6).try_cast("long")).alias("event_time"),
            e["timestamp"].alias("t"),
            lane.alias("lane"),
            fields["kind"].alias("kind"),
            *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in absent.items()],
        )

    keys = F.transform("keystroke_data", lambda e, i: event(
        e, i, F.lit("key"), kind=e["event_type"], key_code=e["key_code"]
    ))
    mouse = F.transform("mouse_data", lambda e, i: event(
        e, i + keys_before, e["type"], kind=e["type"], x=e["x"], y=e["y"], button=e["button"]
    ))
    present = F.filter(F.array(keys, mouse), lambda a: a.isNotNull())
    return payloads.select(
        "session_id",
        F.explode(F.flatten(present)).alias("e"),
        F.col("device_info.screen_resolution").alias("screen_resolution"),
    ).select("session_id", "e.*", "screen_resolution")


def session_records(payloads: DataFrame) -> DataFrame:
    """One row per session: the longest duration and the device last reported."""
    return (
        payloads.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            F.coalesce(F.max("session_duration"), F.lit(0.0)).alias("session_duration"),
            F.max_by("device_info", F.struct(
                F.col("timestamp").try_cast("timestamp"), "session_duration"
            )).alias("device_info"),
        )
    )


def _batches(events: DataFrame, block: int, max_rows: int | None) -> DataFrame:
    """Add (flush, part): the flush interval, and the run of `block` events in it."""
    rows = events.withColumn("flush", F.floor(F.col("t") / FLUSH_SECONDS))

    def placed(part: DataFrame) -> DataFrame:
        # One exchange by session, or by slice of a session, serves the ranks as well.
        part = part.repartition(*[c for c in ("session_id", SLICE) if c in part.columns])
        return position(part, "place", ["session_id", "flush"])

    return per_group(rows, placed, max_rows=max_rows).withColumn(
        "part", F.floor(F.col("place") / block)
    )


def documents(
    events: DataFrame, sessions: DataFrame, block: int = BLOCK, max_rows: int | None = None
) -> DataFrame:
    """Payload documents from event rows: runs of `block` events of each flush interval.

    The rule is the same at every size, so no task collects a whole session; the documents of
    a session add up to it, as the client's flushes do. A session without a record starts with
    its first event and has no device.
    """
    elements = _batches(events.filter(F.col("session_id").isNotNull()), block, max_rows).select(
        "session_id",
        "flush",
        "part",
        "event_time",
        "t",
        F.when(
            F.col("lane") == "key",
            F.struct(
                "pos", F.col("kind").alias("event_type"), "key_code",
                F.col("t").alias("timestamp"),
            ),
        ).alias("key_event"),
        F.when(
            F.col("lane") != "key",
            F.struct(
                "pos", F.col("kind").alias("type"), "x", "y", "button",
                F.col("t").alias("timestamp"),
            ),
        ).alias("mouse_event"),
    )
    batches = elements.groupBy("session_id", "flush", "part").agg(
        F.max("event_time").alias("sent"),
        F.max("t").alias("until"),
        F.array_sort(F.collect_list("key_event")).alias("keys"),
        F.array_sort(F.collect_list("mouse_event")).alias("mice"),
    )
    first = elements.groupBy("session_id").agg(F.min("t").alias("first_event"))
    known = first.join(sessions, "session_id", "left")
    return batches.join(known, "session_id").select(
        "session_id",
        iso_timestamp(F.col("sent")).alias("timestamp"),
        (F.col("until") - F.coalesce("session_start", "first_event")).alias("session_duration"),
        F.transform("keys", lambda e: F.struct(
            e["event_type"].alias("event_type"), e["key_code"].alias("key_code"),
            e["timestamp"].alias("timestamp"), e["pos"].alias("pos"),
        )).alias("keystroke_data"),
        F.transform("mice", lambda e: F.struct(
            e["type"].alias("type"), e["x"].alias("x"), e["y"].alias("y"),
            e["button"].alias("button"), e["timestamp"].alias("timestamp"),
            e["pos"].alias("pos"),
        )).alias("mouse_data"),
        "device_info",
    )


def deduplicate(events: DataFrame) -> DataFrame:
    """Events sent twice, kept once as first sent.

    Copies meet on the whole event, so they spread over all tasks, and each task reduces
    its own copies before the shuffle.
    """
    others = [c for c in events.columns if c not in (*IDENTITY, "pos")]
    return events.groupBy(*IDENTITY).agg(
        F.min("pos").alias("pos"), *[F.min_by(c, "pos").alias(c) for c in others]
    ).select(*events.columns)


def with_data(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Analysis requests that name a session we hold events for."""
    return named_requests(requests).join(_known(events), "session_id", "left_semi")


def without_data(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Analysis requests that name a session without events."""
    return named_requests(requests).join(_known(events), "session_id", "left_anti")


def named_requests(requests: DataFrame) -> DataFrame:
    """Requests with a session id; a null or empty one is refused."""
    return requests.filter(F.col("session_id").isNotNull() & (F.col("session_id") != ""))


def _known(events: DataFrame) -> DataFrame:
    return events.select("session_id").distinct()

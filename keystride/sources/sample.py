"""The driver's tables read as interaction data.

`events` carries one row per user action; user, type, value and props become session, kind,
position and key code, and time is compressed so that the two-second rule has both outcomes.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: how event types and numbers map to interaction fields ------------------
KEY_TYPES = ["view", "click"]
MOUSE_TYPES = ["error", "signup", "purchase"]
MICROS_PER_SECOND = 8e10
RESOLUTIONS = ["1920x1080", "1366x768", "390x844", "768x1024"]
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64)",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7)",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X)",
    "Mozilla/5.0 (X11; Linux x86_64)",
    "Mozilla/5.0 (Linux; ANDROID 14; Pixel 8)",
    "Opera/9.80 (J2ME; Opera mobi; U; en) mobile",
]
ERROR_SHARE = 0.24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(index: Column, options: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), index.cast("int") + 1)


def _prop() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def events(spark: SparkSession, sf_dir: str, types: list[str] | None = None) -> DataFrame:
    """Interaction events; `types` filters on the stored column, so it reaches the scan."""
    rows = table(spark, sf_dir, "events")
    if types:
        rows = rows.filter(F.col("event_type").isin(types))
    return _as_events(rows)


def _as_events(rows: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "view", "keydown")
        .when(F.col("event_type") == "click", "keyup")
        .when(F.col("event_type") == "error", "click")
        .otherwise("movement")
    )
    lane = F.when(F.col("event_type").isin(KEY_TYPES), "key").otherwise(kind)
    is_key = F.col("event_type").isin(KEY_TYPES)
    k = _prop()
    return rows.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").alias("pos"),
        F.col("ts").cast("timestamp").alias("event_time"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(MICROS_PER_SECOND)).alias("t"),
        lane.alias("lane"),
        kind.alias("kind"),
        F.when(is_key, 65 + k % 5).alias("key_code"),
        F.when(~is_key, (k * 37 % 1920).cast("double")).alias("x"),
        F.when(~is_key, (F.floor("value") % 1080).cast("double")).alias("y"),
        F.when(kind == "click", (k % 3).cast("string")).alias("button"),
        _choice(k % 4, RESOLUTIONS).alias("screen_resolution"),
    )


def device_info() -> Column:
    """The device of a session, a function of its id."""
    user = F.col("session_id").cast("long")
    return F.struct(
        _choice(user % 4, RESOLUTIONS).alias("screen_resolution"),
        F.lit("en-US").alias("browser_language"),
        ((user % 25 - 12) * 60).cast("int").alias("timezone_offset"),
        F.lit("sample").alias("platform"),
        (user % 4 == 2).alias("is_mobile"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session: start, duration, device, and the label used in training."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(MICROS_PER_SECOND)).alias("t"),
        "event_type",
    )
    return (
        rows.groupBy("session_id")
        .agg(
            F.min("t").alias("session_start"),
            (F.max("t") - F.min("t")).alias("session_duration"),
            (F.count_if(F.col("event_type") == "error") / F.count(F.lit(1)) > ERROR_SHARE)
            .cast("int").alias("label"),
        )
        .withColumn("device_info", device_info())
    )


def listener_rows(spark: SparkSession, sf_dir: str, types: list[str]) -> DataFrame:
    """Events as browser listeners see them: typed character, pixel, milliseconds."""
    k = _prop()
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin(types)).select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "view", "keydown")
        .when(F.col("event_type") == "click", "keyup")
        .when(F.col("event_type") == "error", "click")
        .otherwise("mousemove").alias("type"),
        F.char(65 + k % 5).alias("key"),
        (65 + k % 5).alias("keyCode"),
        (k * 37 % 1920).cast("double").alias("clientX"),
        (F.floor("value") % 1080).cast("double").alias("clientY"),
        (k % 3).alias("button"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at"),
    )


def client_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen, locale and user agent per event."""
    k = _prop()
    size = F.split(_choice(k % 4, RESOLUTIONS), "x")
    return table(spark, sf_dir, "events").select(
        "event_id",
        size[0].cast("int").alias("width"),
        size[1].cast("int").alias("height"),
        F.lit("en-US").alias("language"),
        ((F.col("user_id") % 25 - 12) * 60).alias("offset"),
        F.lit("sample").alias("platform"),
        _choice(F.col("event_id") % 6, USER_AGENTS).alias("user_agent"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        (F.col("label") == 0).cast("int").alias("label"),
    )


def payload_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request body per event: complete, partial, null-valued and broken ones."""
    user = F.col("user_id").cast("string")
    time = F.col("ts").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.when(
            F.col("event_type") == "view",
            F.concat(F.lit('{"session_id":"'), user, F.lit('","timestamp":"'), time,
                     F.lit('","props":'), F.col("props"), F.lit("}")),
        )
        .when(
            F.col("event_type") == "click",
            F.concat(F.lit('{"session_id":null,"timestamp":"'), time, F.lit('"}')),
        )
        .when(
            F.col("event_type") == "error",
            F.concat(F.lit('{"timestamp":"'), time, F.lit('"}')),
        )
        .when(F.col("event_type") == "signup", F.concat(F.lit("not json "), user))
        .otherwise(F.concat(F.lit('["session_id","timestamp",'), user, F.lit("]")))
        .alias("raw"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A risk score, a label and the scores of both models per event."""
    k = _prop()
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("session_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
        (k / F.lit(100.0)).alias("risk_score"),
        (F.col("event_id") % 1000 / F.lit(1000.0)).alias("confidence"),
        (-(k + 1) / F.lit(101.0)).alias("raw_score"),
        F.try_divide(F.col("value"), F.col("value") + 50).alias("normality"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a score from their length and, where known, a label."""
    return (
        table(spark, sf_dir, "documents").select("doc_id", "n_chars")
        .join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
        .select(
            "doc_id", "n_chars",
            (F.col("n_chars") % 1000 / F.lit(1000.0)).alias("risk_score"),
            F.col("toxic").alias("label"),
        )
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis requests: one per customer, some without a session id."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("request_id"),
        F.when(key % 10 == 9, "").when(key % 10 == 8, F.lit(None))
        .otherwise(key.cast("string")).alias("session_id"),
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events as a stream."""
    shape = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(
        sf_dir
    )
    return _as_events(rows)

"""Browser listener rows to events and device records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystride.functions.scalars import is_mobile_agent, millis_to_seconds, resolution_text


def keystrokes(rows: DataFrame) -> DataFrame:
    """Key listener rows: kind, code and time. What was typed is never selected."""
    return rows.select(
        "session_id", "pos", F.col("type").alias("kind"), F.col("keyCode").alias("key_code"),
        millis_to_seconds(F.col("at")).alias("t"),
    )


def mouse(rows: DataFrame) -> DataFrame:
    """Mouse listener rows: position and time, and for clicks the button as text."""
    click = F.col("type") == "click"
    return rows.select(
        "session_id", "pos",
        F.when(click, "click").otherwise("movement").alias("kind"),
        F.col("clientX").alias("x"), F.col("clientY").alias("y"),
        F.when(click, F.col("button").cast("string")).alias("button"),
        millis_to_seconds(F.col("at")).alias("t"),
    )


def device_info(rows: DataFrame, *keep: str) -> DataFrame:
    """Screen, language, offset, platform and user agent as the payload's device record."""
    return rows.select(
        *keep,
        F.struct(
            resolution_text(F.col("width"), F.col("height")).alias("screen_resolution"),
            F.col("language").alias("browser_language"),
            F.col("offset").cast("int").alias("timezone_offset"),
            F.col("platform").alias("platform"),
            is_mobile_agent(F.col("user_agent")).alias("is_mobile"),
        ).alias("device_info"),
    )

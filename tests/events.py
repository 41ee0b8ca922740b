"""Small hand-made event tables."""

from collections import namedtuple

from pyspark.sql import functions as F

from keystride import schema as S

Event = namedtuple(
    "Event", "session pos time t lane kind code x y button resolution",
    defaults=[None, None, None, None, "1920x1080"],
)


def key(session, pos, t, kind, code=65):
    return Event(session, pos, None, float(t), "key", kind, code)


def move(session, pos, t, x=0.0, y=0.0):
    return Event(session, pos, None, float(t), "movement", "movement", x=float(x), y=float(y))


def click(session, pos, t, x=0.0, y=0.0, button="0"):
    return Event(session, pos, None, float(t), "click", "click", None, float(x), float(y), button)


def table(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], S.EVENT).withColumn(
        "event_time", F.timestamp_micros((F.col("t") * 1e6).cast("long"))
    )

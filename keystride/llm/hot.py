"""Lookups whose keys may be anything between unique and one for a third of all rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystride.session import materialise

#: A key with more than this share of the rows is looked up by broadcast, so at most 1/SHARE are.
SHARE = 1 / 512


def lookup(rows: DataFrame, values: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    """`rows`, a written table, joined with `values`, which has at most one row for each key.

    Rows of frequent keys meet their value by a broadcast of at most 1/SHARE rows, all others by a
    shuffle. A null in the key finds no value.
    """
    least = max(rows.count() * SHARE, 1)
    frequent = rows.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(*key)
    frequent = F.broadcast(materialise(values.join(F.broadcast(materialise(frequent, "frequent")), key, "left_semi"), "values"))
    often = rows.join(frequent, key)
    rest = rows.join(F.broadcast(frequent.select(*key)), key, "left_anti").join(values, key, how)
    return often.unionByName(rest)

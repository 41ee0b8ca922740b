"""Connected components of an edge table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystride.session import materialise

MOST_ROUNDS = 60


def stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct `edges` (a, b), a < b, is either in the place of a, or once in that of b:
    then each a is the least node of its component, and all others hang on it."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("below")), F.struct(F.col("b").alias("node"), F.lit(1).alias("below")))
    places = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    return places.where(F.col("below") > F.col("least")).isEmpty()


def components(edges: DataFrame, kind: str = "long") -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the least node that it reaches.

    Every round writes its edges to the shared folder, and joins by a shuffle also where a broadcast would fit: many
    rounds of broadcasts fill the driver, and so do scans and jobs that only count. One look at the edges tells
    whether they are done, before the first round too. A node's neighbours are only aggregated to
    their least, so no group of neighbours meets in one task.
    """
    edges = materialise(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    both_ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    for _ in range(MOST_ROUNDS):
        if stars(edges):
            break
        # Large star: every larger neighbour of a node goes to the least of node and neighbours.
        both = edges.select(F.inline(both_ways))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: smaller neighbours and the node itself go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least.hint("merge"), "a").select(F.col("b").alias("from"), "m").where("from <> m")
        small = moved.select(F.col("m").alias("a"), F.col("from").alias("b")).union(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        edges = materialise(small, "edges")
    else:
        raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    return materialise(
        nodes.join(edges.select(F.col("b").alias("node"), F.col("a").alias("root")).hint("merge"), "node", "left")
        .select("node", F.coalesce("root", "node").alias("root")), "components",
    )

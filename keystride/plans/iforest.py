"""Isolation forest (M6-M8) after Liu, Ting and Zhou (2008), fitted and applied on executors.

Fitting draws `maxSamples` rows per tree by hashing the row id, so the draw repeats under any
partitioning, and builds each tree in its own task from that many rows. What is random in a tree
is a digest of seed, tree and node, so the same rows give the same forest in any engine. The fitted
forest is a table of nodes with a size fixed by the parameters, so it can be broadcast for scoring.
"""

from collections.abc import Iterator
from hashlib import md5
from math import ceil, log, log2

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import (
    HasFeaturesCol, HasPredictionCol, HasSeed, Param, Params, TypeConverters,
)
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
    MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystride import schema as S
from keystride.session import materialise

EULER_GAMMA = 0.5772156649015329
NODES = "tree int, node int, feature int, split double, lo int, hi int, size int, depth int"
LEAF = -1
# Hexadecimal digits of a digest that make a random number: 52 bits, exact in a double.
DIGITS = 13
# Expected rows drawn per row needed, before the exact trim.
OVERDRAW = 3
# Rows that walk the trees together; small enough for their state to stay in cache.
CHUNK = 1024
# Quantiles of at most this many scores are computed in one aggregate buffer.
EXACT_ROWS = 1_000_000
RANK_ACCURACY = 100_000


def mean_path(n: float) -> float:
    """Average path length of an unsuccessful search among `n` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the given columns only."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def uniform_of(*parts: object) -> float:
    """The same number for plain values."""
    return int(md5(":".join(map(str, parts)).encode()).hexdigest()[:DIGITS], 16) / 16**DIGITS


def sample_per_tree(
    rows: DataFrame, row_id: str, trees: int, wanted: int, seed: int, count: int
) -> DataFrame:
    """`wanted` rows for each tree, without replacement.

    One hash per row first thins the data to a pool of a size that does not depend on
    `count`; the trees draw from the pool.
    """
    pool_share = min(1.0, 2.0 * OVERDRAW * trees * wanted / count)
    share = min(1.0, OVERDRAW * wanted / (count * pool_share))
    pool = rows.filter(uniform(F.lit(seed), F.lit("pool"), F.col(row_id)) < pool_share)

    def draw(tree: Column) -> Column:
        return uniform(F.lit(seed), tree, F.col(row_id))

    drawn = pool.withColumn(
        "tree",
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < share)),
    )
    order = Window.partitionBy("tree").orderBy(draw(F.col("tree")), row_id)
    return (
        drawn.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= wanted)
    )


def _grow(x: np.ndarray, tree: int, seed: int, limit: int) -> list[tuple]:
    """Nodes of one tree over the rows of `x`, split at random until alone or too deep.

    The root is node 0, the nodes below and above the split of node n are 2n + 1 and 2n + 2.
    """
    nodes = []
    open_nodes = [(0, 0, np.arange(len(x)))]
    while open_nodes:
        node, depth, members = open_nodes.pop()
        low, high = x[members].min(axis=0), x[members].max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(varying) == 0:
            nodes.append((tree, node, LEAF, 0.0, LEAF, LEAF, len(members), depth))
            continue
        feature = int(varying[int(uniform_of(seed, tree, node, "feature") * len(varying))])
        lowest, highest = float(low[feature]), float(high[feature])
        split = lowest + uniform_of(seed, tree, node, "split") * (highest - lowest)
        if split >= highest:  # neighbouring floats can round up; both sides need rows
            split = lowest
        below = x[members, feature] <= split
        lo, hi = 2 * node + 1, 2 * node + 2
        nodes.append((tree, node, feature, split, lo, hi, len(members), depth))
        open_nodes += [(lo, depth + 1, members[below]), (hi, depth + 1, members[~below])]
    return nodes


def grow_trees(sampled: DataFrame, seed: int, wanted: int) -> DataFrame:
    limit = ceil(log2(max(wanted, 2)))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("place")
        x = np.stack(ordered["x"].to_numpy())
        nodes = _grow(x, int(ordered["tree"].iloc[0]), seed, limit)
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODES.split(", ")])

    return sampled.groupBy("tree").applyInPandas(build, NODES)


def exact_quantile(scores: DataFrame, column: str, q: float, count: int) -> float:
    """Linearly interpolated quantile, as if all values were sorted in one place.

    While there are too many values for one aggregate buffer, a band around the wanted rank
    is cut out with approximate percentiles, and the values below it are counted.
    """
    value = F.col(column)
    rank = q * (count - 1)
    band, below, within = scores, 0, count
    margin = 2.0 / RANK_ACCURACY
    while within > EXACT_ROWS:
        place = (rank - below) / (within - 1)
        low, high = band.agg(F.percentile_approx(
            value, [max(place - margin, 0.0), min(place + margin, 1.0)], RANK_ACCURACY
        )).first()[0]
        inside = value.between(low, high)
        under, kept = band.agg(F.count_if(value < low), F.count_if(inside)).first()
        if not below + under <= rank <= below + under + kept - 1:
            margin *= 2
            continue
        band, below = band.filter(inside), below + under
        if low == high:
            return low
        if kept == within:
            break
        within = kept
    place = (rank - below) / max(within - 1, 1)
    return band.agg(F.percentile(value, min(max(place, 0.0), 1.0))).first()[0]


class _ForestParams(HasFeaturesCol, HasPredictionCol, HasSeed):
    idCol = Param(Params._dummy(), "idCol", "unique row id, used for sampling",
                  TypeConverters.toString)
    scoreCol = Param(Params._dummy(), "scoreCol", "raw score, -1 (anomalous) to 0",
                     TypeConverters.toString)
    anomalyCol = Param(Params._dummy(), "anomalyCol", "score below the threshold",
                       TypeConverters.toString)
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxSamples = Param(Params._dummy(), "maxSamples", "rows per tree", TypeConverters.toInt)
    contamination = Param(Params._dummy(), "contamination", "share of anomalies expected",
                          TypeConverters.toFloat)

    def _defaults(self):
        self._setDefault(
            featuresCol="features", predictionCol="iforest_prediction", seed=S.SEED,
            idCol="session_id", scoreCol="iforest_score", anomalyCol="iforest_anomaly",
            numTrees=S.NUM_TREES, maxSamples=S.MAX_SAMPLES, contamination=S.CONTAMINATION,
        )


class IsolationForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fitting reads the rows three times: to count, to sample and to score them.

    Hand it a written table rather than a long plan (see session.materialise).
    """

    @keyword_only
    def __init__(self, *, featuresCol=None, predictionCol=None, idCol=None, scoreCol=None,
                 anomalyCol=None, numTrees=None, maxSamples=None, contamination=None, seed=None):
        super().__init__()
        self._defaults()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "IsolationForestModel":
        row_id, seed = self.getOrDefault("idCol"), self.getSeed()
        rows = dataset.select(row_id, vector_to_array(self.getFeaturesCol()).alias("x"))
        count = rows.count()
        if count == 0:
            raise ValueError("no training rows")
        wanted = min(self.getOrDefault("maxSamples"), count)
        sampled = sample_per_tree(
            rows, row_id, self.getOrDefault("numTrees"), wanted, seed, count
        )
        nodes = materialise(grow_trees(sampled, seed, wanted), "forest")
        model = self._copyValues(IsolationForestModel(nodes, wanted))
        scores = materialise(
            model.transform(dataset).select(self.getOrDefault("scoreCol")), "scores"
        )
        model.offset = exact_quantile(
            scores, self.getOrDefault("scoreCol"), self.getOrDefault("contamination"), count
        )
        return model


class IsolationForestModel(Model, _ForestParams, MLReadable, MLWritable):
    """Adds the raw score, the normality `1 + score`, and the anomaly flag."""

    def __init__(self, nodes: DataFrame | None = None, samples: int = 0,
                 offset: float | None = None):
        super().__init__()
        self._defaults()
        self.nodes, self.samples, self.offset = nodes, samples, offset
        self._arrays = None

    def _forest(self):
        """Flat node arrays; at most numTrees x (2 maxSamples - 1) entries.

        Leaves lead back to themselves, so all rows can take the same number of steps.
        `child` holds two entries per node: the next node above and below the split.
        """
        if self._arrays is None:
            table = self.nodes.toPandas().sort_values(["tree", "node"], ignore_index=True)
            root = (table["node"] == 0).to_numpy().nonzero()[0]
            leaf = (table["feature"] == LEAF).to_numpy()
            first = table["tree"].to_numpy(np.int64) * (int(table["node"].max()) + 1)
            places = first + table["node"].to_numpy()

            def towards(side: str) -> np.ndarray:
                return np.where(leaf, table.index, np.searchsorted(places, first + table[side].to_numpy()))

            context = self.nodes.sparkSession.sparkContext
            self._arrays = context.broadcast((
                root[:, None],
                np.where(leaf, 0, table["feature"]),
                np.where(leaf, np.inf, table["split"]),
                np.stack([towards("hi"), towards("lo")], axis=1).ravel(),
                (table["depth"] + table["size"].map(mean_path)).to_numpy(),
                int(table["depth"].max()),
            ))
        return self._arrays

    def _transform(self, dataset: DataFrame) -> DataFrame:
        forest, typical = self._forest(), mean_path(self.samples) or 1.0

        @F.pandas_udf("double")
        def raw_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            root, feature, split, child, length, depth = forest.value

            def mean_lengths(x: np.ndarray) -> np.ndarray:
                flat = x.ravel()
                start = np.arange(len(x))[None, :] * x.shape[1]
                node = np.broadcast_to(root, (len(root), len(x)))
                for _ in range(depth):
                    below = flat.take(start + feature.take(node)) <= split.take(node)
                    node = child.take(2 * node + below)
                return length.take(node).mean(axis=0)

            for batch in batches:
                parts = [
                    mean_lengths(np.stack(batch.iloc[i:i + CHUNK].to_numpy()))
                    for i in range(0, len(batch), CHUNK)
                ]
                lengths = np.concatenate(parts) if parts else np.empty(0)
                yield pd.Series(-np.power(2.0, -lengths / typical))

        score, prediction = self.getOrDefault("scoreCol"), self.getPredictionCol()
        scored = dataset.withColumn(score, raw_score(vector_to_array(self.getFeaturesCol())))
        scored = scored.withColumn(prediction, 1 + F.col(score))
        if self.offset is None:
            return scored
        return scored.withColumn(self.getOrDefault("anomalyCol"), F.col(score) < self.offset)

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: IsolationForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        if self.model.offset is None:
            raise RuntimeError("the forest is not fitted")
        DefaultParamsWriter.saveMetadata(
            self.model, path, self.sparkSession,
            extraMetadata={"samples": self.model.samples, "offset": self.model.offset},
        )
        self.model.nodes.write.parquet(f"{path}/nodes")


class _ForestReader(MLReader):
    def load(self, path: str) -> IsolationForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = IsolationForestModel(
            self.sparkSession.read.parquet(f"{path}/nodes"),
            metadata["samples"], metadata["offset"],
        )
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model

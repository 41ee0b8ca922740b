"""The pointer to the model in use, retraining, and streams that follow the pointer."""

import pytest
from pyspark.sql import functions as F

from keystride.plans import registry, retraining
from keystride.session import new_path
from keystride.streaming import sessions


class Model:
    """Scores by a column; saved as its name."""

    def __init__(self, spark, column):
        self.spark, self.column = spark, column

    def save(self, path):
        registry.put_text(self.spark, f"{path}/column", self.column)

    @classmethod
    def load(cls, spark, path):
        return cls(spark, registry.get_text(spark, f"{path}/column"))

    def score(self, rows):
        return rows.withColumn("risk_score", F.col(self.column))


@pytest.fixture
def root(spark):
    return new_path(spark, "models")


def test_pointer_is_replaced_whole(spark, root):
    assert registry.current(spark, root) is None
    for version in ("a", "b", "a-longer-name", "c"):
        registry.promote(spark, root, version)
        assert registry.current(spark, root) == version


ROWS = [(i, i / 10, (7 * i % 10) / 10, int(i > 4)) for i in range(10)]


@pytest.fixture
def held(spark):
    return spark.createDataFrame(ROWS + [(99, 0.5, 0.5, None)], "id int, good double, bad double, label int")


def run(spark, root, held, version, column, drift=0.5):
    return retraining.retrain(
        spark, root, version, drift, lambda: Model(spark, column), Model.load, lambda m, rows: m.score(rows), held
    ).first()


def test_challenger_must_beat_the_champion(spark, root, held):
    first = run(spark, root, held, "1", "bad", drift=0.0)
    assert (first.champion, first.promoted, first.in_use) == (None, True, "1")
    calm = run(spark, root, held, "2", "good", drift=0.2)
    assert (calm.challenger, calm.promoted, calm.in_use) == (None, False, "1")
    assert run(spark, root, held, "2", "good", drift=None).in_use == "1"
    better = run(spark, root, held, "2", "good")
    assert (better.champion, better.challenger_auc, better.promoted, better.in_use) == ("1", 1.0, True, "2")
    assert better.champion_auc < 1.0
    worse = run(spark, root, held, "3", "bad")
    assert (worse.champion, worse.promoted, worse.in_use) == ("2", False, "2")
    # An equal one does not replace the champion either.
    assert not run(spark, root, held, "4", "good").promoted


def test_a_crash_before_promotion_leaves_the_champion(spark, root, held, monkeypatch):
    run(spark, root, held, "1", "bad")

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(registry, "promote", crash)
        with pytest.raises(OSError):
            run(spark, root, held, "2", "good")
    assert Model.load(spark, registry.version_path(root, "2")).column == "good"
    assert registry.current(spark, root) == "1"
    assert run(spark, root, held, "2", "good").in_use == "2"


def test_held_out_rows_are_told_by_id(spark):
    rows = spark.range(4000).withColumn("out", retraining.held_out("id"))
    share = rows.where("out").count() / 4000
    assert 0.2 < share < 0.3
    assert rows.repartition(7).where("out").exceptAll(rows.where("out")).isEmpty()


def test_a_stream_follows_the_pointer_and_replays_keep_their_model(spark, root, held):
    path, out, checkpoint = new_path(spark, "in"), new_path(spark, "o"), new_path(spark, "c")

    def stream(at=checkpoint):
        rows = spark.readStream.schema(held.schema).parquet(path)
        sessions.score_with_current(rows, root, Model.load, lambda m, b: m.score(b), out, at).awaitTermination()
        return sorted((r.id, r.risk_score, r.model_version) for r in spark.read.parquet(out).collect())

    part = {n: held.where(c) for n, c in (("low", "id < 5"), ("high", "id between 5 and 9"))}
    part["low"].coalesce(1).write.parquet(path)
    with pytest.raises(Exception, match="no model"):
        stream()
    for version, column in (("1", "bad"), ("2", "good")):
        Model(spark, column).save(registry.version_path(root, version))
    registry.promote(spark, root, "1")
    low = [(i, b, "1") for i, _, b, _ in ROWS if i < 5]
    assert stream() == low
    registry.promote(spark, root, "2")
    part["high"].coalesce(1).write.mode("append").parquet(path)
    both = low + [(i, g, "2") for i, g, _, _ in ROWS if i >= 5]
    assert stream() == both
    # The same batches again, as after a lost checkpoint commit: batch 0 is scored by the model it had.
    again = stream(new_path(spark, "c"))
    assert {r[2] for r in again if r[0] < 5} == {"1"} and len(again) >= 10

"""The whole way on the driver's events: intake stream to risk records."""

from pyspark.sql import functions as F

from keystride import queries
from keystride import schema as S
from keystride.plans import risk, training
from keystride.plans.detector import SessionDetector
from keystride.plans.session_features import session_features
from keystride.session import materialise, new_path
from keystride.sources import payloads
from keystride.streaming import ingest, sessions


def test_from_request_bodies_to_risk(spark, sf):
    inbox = queries._payload_folder(spark, sf, copies=2)
    table = new_path(spark, "events")
    texts = ingest.text_stream(spark, inbox)
    ingest.store_events(
        ingest.distinct_events(ingest.accepted_events(texts), "1 hour"),
        table, new_path(spark, "c"),
    ).awaitTermination()

    events = payloads.read_events(spark, table)
    records = payloads.session_records(payloads.read_log(spark, inbox))
    features = materialise(session_features(events, records), "features")
    direct = queries._session_features(spark, sf)
    rounded = [queries.rounded(df) for df in (features, direct)]
    assert rounded[0].exceptAll(rounded[1]).isEmpty()
    assert rounded[0].count() == rounded[1].count() == 15

    fitted = SessionDetector(names=S.SESSION_FEATURES).fit(features)
    assert fitted.predict(features).count() == 15

    rows = risk.model_rows(features)
    model = training.fit_ensemble(rows, trees=10)
    batch = materialise(training.score(model, rows).select("session_id", "risk_score"), "batch")
    arrivals, out = new_path(spark, "arrivals"), new_path(spark, "risk")
    rows.write.parquet(arrivals)
    sessions.score_stream(
        spark.readStream.schema(rows.schema).parquet(arrivals),
        lambda part: training.score(model, part).select("session_id", "risk_score"),
        out, new_path(spark, "c"),
    ).awaitTermination()
    streamed = spark.read.parquet(out).select("session_id", "risk_score")
    assert streamed.exceptAll(batch).isEmpty() and streamed.count() == 15

    risks = materialise(risk.risk_table(rows, model), "risks")
    requests = spark.createDataFrame([("3",), ("nobody",)], "session_id string")
    answer = risk.assess(requests, risks, F.lit("2024-02-01").cast("timestamp")).collect()
    assert [r["session_id"] for r in answer] == ["3"] and len(answer[0]["factors"]) == 3

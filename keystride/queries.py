"""Every operator as a query over the driver's tables."""

from collections.abc import Callable
from functools import wraps

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystride import schema as S
from keystride.functions import scalars
from keystride.operators.sessions import gap_sessions
from keystride.operators.timings import interactions, timed_rows
from keystride.plans import (
    detector, feature_build, iforest, monitoring, refresh, registry, retraining, risk, scoring, training, vectors,
)
from keystride.plans import session_features as features
from keystride.session import materialise, new_path, rocksdb_state
from keystride.sources import browser, feature_store, payloads, sample
from keystride.streaming import ingest
from keystride.streaming import sessions as session_streams
from keystride.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6
LARGE = 1e6
LARGE_DIGITS = 2
VERSION = "20240131_000000"
OLDER_VERSION = "20240101_000000"
RETENTION_AS_OF = "2024-04-14 00:00:00"
HALF_TIME = "2024-01-16 00:00:00"
# Six hours and one hour in the payloads' compressed time.
PAYLOAD_GAP, PAYLOAD_DELAY = 0.27, "45 milliseconds"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, large ones to two: two engines add in different orders."""

    def trim(name: str) -> Column:
        return (
            F.when(F.abs(name) < LARGE, F.round(name, DIGITS))
            .otherwise(F.round(name, LARGE_DIGITS)).alias(name)
        )

    return df.select(*[
        trim(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return rounded(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return run


# ---- events and their timings -------------------------------------------------------------

def _keys(spark, sf_dir):
    return sample.events(spark, sf_dir, sample.KEY_TYPES)


def _mouse(spark, sf_dir):
    return sample.events(spark, sf_dir, sample.MOUSE_TYPES)


@query
def keystroke_events(spark, sf_dir):
    return browser.keystrokes(sample.listener_rows(spark, sf_dir, sample.KEY_TYPES))


@query
def mouse_events(spark, sf_dir):
    return browser.mouse(sample.listener_rows(spark, sf_dir, sample.MOUSE_TYPES))


@query
def device_record(spark, sf_dir):
    return browser.device_info(sample.client_rows(spark, sf_dir), "event_id").select(
        "event_id", "device_info.*"
    )


@query
def keystroke_hold(spark, sf_dir):
    return (
        timed_rows(_keys(spark, sf_dir)).filter(F.col("hold").isNotNull())
        .select("session_id", "pos", "key_code", "hold")
    )


@query
def keystroke_interkey(spark, sf_dir):
    return (
        timed_rows(_keys(spark, sf_dir)).filter(F.col("interkey").isNotNull())
        .select("session_id", "pos", "interkey")
    )


@query
def mouse_velocity(spark, sf_dir):
    return (
        timed_rows(_mouse(spark, sf_dir)).filter(F.col("velocity").isNotNull())
        .select("session_id", "pos", "velocity")
    )


@query
def mouse_acceleration(spark, sf_dir):
    return (
        timed_rows(_mouse(spark, sf_dir)).filter(F.col("acceleration").isNotNull())
        .select("session_id", "pos", "acceleration")
    )


@query
def raw_behavioral(spark, sf_dir):
    return interactions(timed_rows(sample.events(spark, sf_dir))).withColumn(
        "timestamp", F.unix_micros("timestamp")
    )


# ---- session features ---------------------------------------------------------------------

def _session_features(spark, sf_dir):
    return features.session_features(
        sample.events(spark, sf_dir), sample.sessions(spark, sf_dir)
    )


@query
def keystroke_features(spark, sf_dir):
    return features.keystroke_features(_keys(spark, sf_dir))


@query
def mouse_features(spark, sf_dir):
    return features.mouse_features(_mouse(spark, sf_dir))


@query
def device_features(spark, sf_dir):
    return features.device_features(sample.sessions(spark, sf_dir))


@query
def session_features(spark, sf_dir):
    return _session_features(spark, sf_dir)


@query
def align_features(spark, sf_dir):
    names = ["device_battery", *reversed(S.SESSION_FEATURES[:-2])]
    return features.align(_session_features(spark, sf_dir), names)


def _activity(spark, sf_dir):
    return features.session_activity(sample.events(spark, sf_dir))


def _joined_sets(activity: DataFrame) -> DataFrame:
    """The set columns as text, which every engine compares alike."""
    return activity.withColumns({
        c: F.array_join(c, ";")
        for c in ("device_orientation_changes", "screen_resolution_changes")
    })


@query
def session_sql_features(spark, sf_dir):
    return _joined_sets(_activity(spark, sf_dir))


@query
def sql_view_features(spark, sf_dir):
    """The activity features by a SQL statement over the interaction rows."""
    return _joined_sets(feature_build.sql_features(interactions(timed_rows(sample.events(spark, sf_dir)))))


@query
def hourly_features(spark, sf_dir):
    raw = interactions(timed_rows(sample.events(spark, sf_dir)))
    hourly = raw.withColumn("hour", F.window("timestamp", S.FEATURE_REFRESH)["start"])
    activity = features.activity_features(hourly, ("session_id", "hour"))
    return _joined_sets(activity).withColumn("hour", F.unix_micros("hour"))


@query
def hourly_refresh(spark, sf_dir):
    """Hourly features after a full build without two days' late events, and a refresh of those days with them."""
    events = sample.events(spark, sf_dir).withColumn(refresh.DAY, F.to_date("event_time"))
    late = (F.col("pos") % 5 == 2) & F.dayofmonth("event_time").isin(10, 11)
    path, root = new_path(spark, "events"), new_path(spark, "state")
    events.where(~late).write.partitionBy(refresh.DAY).parquet(path)
    refresh.refresh(spark, path, root, refresh.touched_days(events.where(~late)))
    events.where(late).write.mode("append").partitionBy(refresh.DAY).parquet(path)
    refresh.refresh(spark, path, root, refresh.touched_days(events.where(late)))
    return _joined_sets(refresh.features_from_state(spark, root)).withColumn("hour", F.unix_micros("hour"))


@query
def session_span(spark, sf_dir):
    rows = sample.events(spark, sf_dir).groupBy("session_id").agg(
        F.min("event_time").alias("start"), F.max("event_time").alias("end")
    )
    return rows.select(
        "session_id",
        F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("started"),
        scalars.seconds_between(F.col("start"), F.col("end")).alias("seconds"),
        scalars.millis_to_seconds(F.unix_millis("end")).alias("end_seconds"),
    )


@query
def session_key(spark, sf_dir):
    seed = F.concat_ws(":", "session_id", F.unix_micros("event_time").cast("string"))
    return sample.events(spark, sf_dir).select(
        "pos", scalars.session_key(seed).alias("session_key")
    )


@query
def session_window_batch(spark, sf_dir):
    found = gap_sessions(sample.events(spark, sf_dir), "session_id", "event_time", 6 * 3600)
    return found.select(
        "session_id", F.unix_micros("session_start").alias("session_start"),
        F.unix_micros("last_event").alias("last_event"), "events",
    )


@query
def mobile_user_agent(spark, sf_dir):
    return sample.client_rows(spark, sf_dir).select(
        "event_id", scalars.is_mobile_agent(F.col("user_agent")).alias("is_mobile")
    )


# ---- payloads -----------------------------------------------------------------------------

def _documents(spark, sf_dir):
    return payloads.documents(sample.events(spark, sf_dir), sample.sessions(spark, sf_dir))


def _plain_events(events: DataFrame) -> DataFrame:
    return events.select(
        "session_id", "pos", "lane", "kind", "key_code", "x", "y", "button", "t"
    )


@query
def payload_validation(spark, sf_dir):
    return payloads.validate(sample.payload_texts(spark, sf_dir)).select("event_id", "is_valid")


@query
def session_document(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return docs.select(
        "session_id", "timestamp", "session_duration",
        F.size("keystroke_data").alias("keys"), F.size("mouse_data").alias("mouse"),
        F.try_element_at("keystroke_data", F.lit(1))["pos"].alias("first_key_pos"),
        F.try_element_at("mouse_data", F.lit(-1))["pos"].alias("last_mouse_pos"),
        F.col("device_info.screen_resolution").alias("screen_resolution"),
    )


@query
def explode_events(spark, sf_dir):
    return _plain_events(payloads.explode_events(_documents(spark, sf_dir)))


@query
def assigned_positions(spark, sf_dir):
    """Events of payloads as clients send them, without positions: each gets one of its own."""
    def bare(column):
        return F.transform(column, lambda e: e.withField("pos", F.lit(None).cast("long")))

    docs = _documents(spark, sf_dir).withColumns({c: bare(c) for c in ("keystroke_data", "mouse_data")})
    return payloads.explode_events(docs).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("pos").alias("positions"), F.count_if(F.col("lane") == "key").alias("keys")
    )


@query
def read_session_log(spark, sf_dir):
    path = new_path(spark, "log")
    payloads.append_log(_documents(spark, sf_dir), path)
    return _plain_events(payloads.explode_events(payloads.read_log(spark, path)))


@query
def read_session_doc(spark, sf_dir):
    path = new_path(spark, "documents")
    payloads.write_documents(_documents(spark, sf_dir), path)
    return _plain_events(payloads.explode_events(payloads.read_documents(spark, path)))


@query
def merge_payloads(spark, sf_dir):
    path = new_path(spark, "log")
    # Two flushes per session: the log of the first half, then the second appended to it.
    docs = materialise(_documents(spark, sf_dir), "flushes")
    early = F.col("timestamp") < HALF_TIME.replace(" ", "T")
    payloads.append_log(docs.filter(early), path)
    payloads.append_log(docs.filter(~early), path)
    log = payloads.read_log(spark, path)
    counts = payloads.explode_events(log).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"), F.min("t").alias("first_t"), F.max("t").alias("last_t")
    )
    return payloads.session_records(log).join(counts, "session_id").select(
        "session_id", "session_duration",
        F.col("device_info.screen_resolution").alias("screen_resolution"),
        "events", "first_t", "last_t",
    )


@query
def dedup_events(spark, sf_dir):
    path = new_path(spark, "log")
    docs = materialise(_documents(spark, sf_dir), "flushes")
    payloads.append_log(docs, path)
    payloads.append_log(docs, path)
    events = payloads.explode_events(payloads.read_log(spark, path))
    return _plain_events(payloads.deduplicate(events))


@query
def sessions_with_data(spark, sf_dir):
    return payloads.with_data(sample.requests(spark, sf_dir), sample.events(spark, sf_dir))


@query
def sessions_without_data(spark, sf_dir):
    return payloads.without_data(sample.requests(spark, sf_dir), sample.events(spark, sf_dir))


# ---- vectors ------------------------------------------------------------------------------

def _aligned_activity(spark, sf_dir):
    return features.align(_activity(spark, sf_dir), S.ACTIVITY_VECTOR)


@query
def feature_vector(spark, sf_dir):
    rows = vectors.assembler(S.ACTIVITY_VECTOR).transform(_aligned_activity(spark, sf_dir))
    return vectors.long_rows(rows, "features", S.ACTIVITY_VECTOR)


@query
def scaled_features(spark, sf_dir):
    table = materialise(_aligned_activity(spark, sf_dir), "activity")
    rows = vectors.assembler(S.ACTIVITY_VECTOR).transform(table)
    scaled = vectors.standard_scaler().fit(rows).transform(rows)
    return vectors.long_rows(scaled, "scaled_features", S.ACTIVITY_VECTOR)


@query
def pca_features(spark, sf_dir):
    built = feature_build.vectorise(_activity(spark, sf_dir))
    return vectors.long_rows(
        built.features, "pca_features", [f"pc{i + 1}" for i in range(S.PCA_COMPONENTS)]
    )


@query
def feature_stages(spark, sf_dir):
    built = feature_build.vectorise(_activity(spark, sf_dir))
    return built.features.select(
        "session_id", *S.ACTIVITY_VECTOR,
        *[F.size(vector_to_array(c)).alias(f"{c}_size")
          for c in ("features", "scaled_features", "pca_features")],
    )


def _scaled_sessions(spark, sf_dir):
    table = materialise(
        features.align(_session_features(spark, sf_dir), S.SESSION_FEATURES), "sessions"
    )
    stats = vectors.population_stats(table, S.SESSION_FEATURES)
    return vectors.population_scale(table, stats)


@query
def detector_scale(spark, sf_dir):
    return _scaled_sessions(spark, sf_dir)


# ---- models -------------------------------------------------------------------------------

def _embedding_forest(spark, sf_dir):
    rows = sample.embeddings(spark, sf_dir)
    return rows, iforest.IsolationForest(idCol="vec_id").fit(rows)


@query
def iforest_fit(spark, sf_dir):
    return _embedding_forest(spark, sf_dir)[1].nodes


@query
def iforest_trees(spark, sf_dir):
    """Rows each tree was grown from, and where they ended up."""
    nodes = _embedding_forest(spark, sf_dir)[1].nodes
    leaf = F.col("feature") == iforest.LEAF
    return nodes.groupBy("tree").agg(
        F.max(F.when(F.col("node") == 0, F.col("size"))).alias("drawn"),
        F.sum(F.when(leaf, F.col("size"))).alias("in_leaves"),
        (F.count_if(leaf) - F.count_if(~leaf)).alias("leaves_over_splits"),
    )


@query
def iforest_score(spark, sf_dir):
    rows, model = _embedding_forest(spark, sf_dir)
    return model.transform(rows).select("vec_id", "iforest_score", "iforest_prediction")


@query
def iforest_flag(spark, sf_dir):
    rows, model = _embedding_forest(spark, sf_dir)
    return model.transform(rows).select("vec_id", "iforest_anomaly")


@query
def rf_fit_predict(spark, sf_dir):
    rows = sample.embeddings(spark, sf_dir)
    model = training.fit_ensemble(rows, features="features", key="vec_id")
    return training.score(model, rows).select(
        "vec_id", "label", "rf_prediction",
        vector_to_array("rf_probability")[1].alias("rf_probability"), "risk_score",
    )


def _model_rows(spark, sf_dir):
    return risk.model_rows(_session_features(spark, sf_dir), sample.sessions(spark, sf_dir))


@query
def train_model(spark, sf_dir):
    rows, unseen = _model_rows(spark, sf_dir), retraining.held_out("session_id")
    run = training.train(rows.where(~unseen), VERSION, validation=rows.where(unseen), root=new_path(spark, "training"))
    return run.record.drop("model_path")


@query
def model_roundtrip(spark, sf_dir):
    rows = materialise(_session_features(spark, sf_dir), "sessions")
    fitted = detector.SessionDetector(names=S.SESSION_FEATURES).fit(rows)
    path = new_path(spark, "detector")
    fitted.save(path)
    loaded = detector.SessionDetector.load(spark, path)
    before = fitted.predict(rows).select("session_id", F.col("raw_score").alias("fitted"))
    after = loaded.predict(rows).select("session_id", F.col("raw_score").alias("loaded"))
    return before.join(after, "session_id").select(
        "session_id", (F.col("fitted") == F.col("loaded")).alias("same_score")
    )


@query
def detector_predict(spark, sf_dir):
    rows = materialise(_session_features(spark, sf_dir), "sessions")
    fitted = detector.SessionDetector(names=S.SESSION_FEATURES).fit(rows)
    return fitted.predict(rows).select(
        "session_id", "is_anomaly", "risk_score", "confidence", "raw_score",
        F.element_at("feature_importance", "session_duration").alias("duration_importance"),
    )


def _risks(spark, sf_dir):
    return risk.risk_table(_model_rows(spark, sf_dir)).withColumn(
        "factors", F.array_join("factors", "; ")
    )


@query
def session_risk(spark, sf_dir):
    """Features, both models, risk, tier and the leading factors of every session."""
    return _risks(spark, sf_dir)


@query
def risk_assessment(spark, sf_dir):
    at = F.lit(HALF_TIME).cast("timestamp")
    return risk.assess(sample.requests(spark, sf_dir), _risks(spark, sf_dir), at)


@query
def request_outcomes(spark, sf_dir):
    """Each request of a stream, answered from stored risks: refused, without data, or scored."""
    rows = materialise(_session_features(spark, sf_dir), "sessions")
    fitted = detector.SessionDetector(names=S.SESSION_FEATURES).fit(rows)
    known = sample.events(spark, sf_dir).select("session_id").distinct()
    risks = materialise(fitted.predict(rows).join(known, "session_id", "left_semi").select(
        "session_id", "risk_score", "confidence", scalars.risk_tier(F.col("risk_score")).alias("tier")
    ), "risks")
    asked, out = new_path(spark, "requests"), new_path(spark, "answers")
    sample.requests(spark, sf_dir).write.parquet(asked)
    stream = spark.readStream.schema("request_id long, session_id string").parquet(asked)
    found = risk.answers(stream, risks, F.lit(HALF_TIME).cast("timestamp"))
    ingest.start(found.writeStream.format("parquet").option("path", out), new_path(spark, "stream")).awaitTermination()
    return spark.read.parquet(out)


# ---- scores -------------------------------------------------------------------------------

@query
def risk_tier(spark, sf_dir):
    return sample.scored(spark, sf_dir).select(
        "event_id", "risk_score", scalars.risk_tier(F.col("risk_score")).alias("tier")
    )


@query
def risk_report(spark, sf_dir):
    return scoring.report(sample.scored(spark, sf_dir)).select(
        "event_id", "tier", "message", "icon", "risk_text", "confidence_text"
    )


@query
def detector_risk(spark, sf_dir):
    return scoring.detector_risk(sample.scored(spark, sf_dir)).select(
        "event_id", "risk_score", "confidence"
    )


@query
def ensemble_risk(spark, sf_dir):
    both = scoring.ensemble_risk(F.col("normality"), F.col("risk_score"))
    return sample.scored(spark, sf_dir).select(
        "event_id", both.alias("risk"),
        scoring.ensemble_risk(F.col("normality")).alias("isolation_only"),
    )


@query
def feature_contributions(spark, sf_dir):
    return scoring.contribution_rows(_scaled_sessions(spark, sf_dir), S.SESSION_FEATURES)


@query
def top_factors(spark, sf_dir):
    """Factors for a given risk: the session number over 100."""
    given = F.col("session_id").cast("long") % 100 / F.lit(100.0)
    factors = scoring.factor_list(S.SESSION_FEATURES, scalars.risk_tier(given))
    shares = scoring.contributions(_scaled_sessions(spark, sf_dir), S.SESSION_FEATURES)
    return shares.select("session_id", F.posexplode(factors).alias("place", "factor"))


@query
def auc_roc(spark, sf_dir):
    rows = sample.scored_documents(spark, sf_dir).filter(F.col("label").isNotNull())
    area = training.area_under_roc(rows, "n_chars")
    return spark.createDataFrame([(area,)], "auc double")


# ---- monitoring ---------------------------------------------------------------------------

@query
def model_monitor(spark, sf_dir):
    record = monitoring.metrics(sample.scored_documents(spark, sf_dir))
    root = new_path(spark, "monitoring")
    monitoring.append_metrics(record, root, VERSION, "2024-01-31T00:00:00")
    return spark.read.schema(record.schema).json(f"{root}/metrics/{VERSION}")


@query
def metrics_by_window(spark, sf_dir):
    rows = monitoring.metrics_by_window(sample.scored(spark, sf_dir), "event_time")
    return rows.withColumn("window_start", F.unix_micros("window_start"))


@query
def auc_by_window(spark, sf_dir):
    """Exact area under ROC of every day."""
    day = F.unix_micros(F.window("event_time", "1 day")["start"])
    return monitoring.area_by_group(sample.scored(spark, sf_dir), day)


def _halves(spark, sf_dir):
    rows = sample.scored(spark, sf_dir)
    early = F.col("event_time") < F.lit(HALF_TIME).cast("timestamp")
    return rows.filter(early), rows.filter(~early)


@query
def risk_drift(spark, sf_dir):
    return monitoring.drift_bins(*_halves(spark, sf_dir))


@query
def alert_rules(spark, sf_dir):
    before, now = _halves(spark, sf_dir)
    change = training.area_under_roc(before, "risk_score") - training.area_under_roc(
        now, "risk_score"
    )
    drift = monitoring.drift_index(before, now).first()["drift"]
    observed = monitoring.metrics(now).select(
        "false_positive_rate", F.lit(drift).alias("model_drift"),
        F.lit(change).alias("performance_degradation"),
    )
    return monitoring.alerts(observed)


# ---- feature store ------------------------------------------------------------------------

@query
def feature_store_write(spark, sf_dir):
    root = new_path(spark, "store")
    feature_store.write_version(_session_features(spark, sf_dir), root, VERSION, "now")
    return feature_store.read_version(spark, root, VERSION)


@query
def feature_store_metadata(spark, sf_dir):
    root = new_path(spark, "store")
    feature_build.build_and_store(
        _activity(spark, sf_dir), root, VERSION, "2024-01-31T00:00:00"
    )
    return feature_store.metadata(spark, root)


@query
def feature_store_latest(spark, sf_dir):
    root = new_path(spark, "store")
    keys = features.keystroke_features(_keys(spark, sf_dir))
    mouse = features.mouse_features(_mouse(spark, sf_dir))
    feature_store.write_version(mouse, root, OLDER_VERSION, "then")
    feature_store.write_version(keys, root, VERSION, "now")
    return feature_store.read_latest(spark, root)


@query
def retention_versions(spark, sf_dir):
    known = sample.events(spark, sf_dir).select(
        scalars.version_of(F.date_trunc("hour", "event_time")).alias("version")
    ).distinct()
    return feature_store.retention(known, RETENTION_AS_OF)


# ---- streams ------------------------------------------------------------------------------

def _payload_folder(spark, sf_dir, copies: int = 1) -> str:
    path = new_path(spark, "inbox")
    docs = materialise(_documents(spark, sf_dir), "flushes")
    for _ in range(copies):
        payloads.append_log(docs, path)
    return path


@query
def stream_ingest(spark, sf_dir):
    texts = ingest.text_stream(spark, _payload_folder(spark, sf_dir))
    out = new_path(spark, "events")
    ingest.store_events(
        ingest.accepted_events(texts), out, new_path(spark, "stream")
    ).awaitTermination()
    return _plain_events(payloads.read_events(spark, out))


@query
def stream_rejected(spark, sf_dir):
    inbox, out = new_path(spark, "inbox"), new_path(spark, "rejected")
    sample.payload_texts(spark, sf_dir).select("raw").write.text(inbox)
    ingest.store_rejected(
        ingest.text_stream(spark, inbox), out, new_path(spark, "stream")
    ).awaitTermination()
    return spark.read.parquet(out)


@query
def stream_dedup(spark, sf_dir):
    texts = ingest.text_stream(spark, _payload_folder(spark, sf_dir, copies=2))
    events = ingest.distinct_events(ingest.accepted_events(texts), "1 hour")
    out = new_path(spark, "events")
    ingest.store_events(events, out, new_path(spark, "stream")).awaitTermination()
    return _plain_events(spark.read.parquet(out))


@query
def stream_session_features(spark, sf_dir):
    closed = session_streams.closed_sessions(
        sample.event_stream(spark, sf_dir), "6 hours", "1 hour"
    )
    out = new_path(spark, "closed")

    def stored():
        return sample.events(spark, sf_dir).withColumn("event_date", F.to_date("event_time"))

    session_streams.features_of_closed(
        closed, stored, features.keystroke_features, out, new_path(spark, "stream")
    ).awaitTermination()
    return spark.read.parquet(out).select(
        "session_id", F.unix_micros("session_start").alias("session_start"),
        *S.KEYSTROKE_FEATURES,
    )


@query
def stream_state_features(spark, sf_dir):
    """Key and mouse features of closed sessions, from the stream's own state."""
    out = new_path(spark, "closed")
    found = stateful.session_state_features(sample.event_stream(spark, sf_dir), 6 * 3600, "1 hour")
    with rocksdb_state(spark):
        running = ingest.start(found.writeStream.format("parquet").option("path", out), new_path(spark, "stream"))
    running.awaitTermination()
    return spark.read.schema(stateful.CLOSED).parquet(out).withColumns({
        "session_start": F.unix_micros("session_start"), "last_event": F.unix_micros("last_event")
    })


def _behaviour(events: DataFrame, sessions: DataFrame) -> DataFrame:
    return features.session_features(events, sessions).select("session_id", *stateful.FEATURES)


def _windows_scored(model: detector.SessionDetector, closed: DataFrame) -> DataFrame:
    """Risk of closed sessions; a session that closes twice is two rows."""
    named = closed.withColumn("session_id", F.concat_ws("@", "session_id", F.unix_micros("session_start")))
    return model.predict(named).select(
        F.regexp_replace("session_id", "@\\d+$", "").alias("session_id"),
        F.regexp_extract("session_id", "@(\\d+)$", 1).cast("long").alias("session_start"), "risk_score", "confidence",
    )


@query
def stream_scoring(spark, sf_dir):
    """From payloads on a stream to risks: events, features when a session closes, the promoted detector."""
    root = new_path(spark, "models")
    rows = materialise(_behaviour(sample.events(spark, sf_dir), sample.sessions(spark, sf_dir)), "sessions")
    detector.SessionDetector(names=stateful.FEATURES).fit(rows).save(registry.version_path(root, VERSION))
    registry.promote(spark, root, VERSION)
    events = ingest.accepted_events(ingest.text_stream(spark, _payload_folder(spark, sf_dir)))
    out = new_path(spark, "risk")
    session_streams.score_with_current(
        stateful.session_state_features(events, PAYLOAD_GAP, PAYLOAD_DELAY), root, detector.SessionDetector.load,
        _windows_scored, out, new_path(spark, "stream"),
    ).awaitTermination()
    return spark.read.parquet(out).select("session_id", "session_start", "risk_score", "confidence", "model_version")


@query
def retrain_decision(spark, sf_dir):
    """A detector of the first half of the time against one of the second, on sessions neither has seen."""
    events, sessions = sample.events(spark, sf_dir), sample.sessions(spark, sf_dir)
    half = F.lit(HALF_TIME).cast("timestamp")
    early, late = (
        materialise(_behaviour(events.where(side), sessions), "sessions")
        for side in (F.col("event_time") < half, F.col("event_time") >= half)
    )
    root, names, unseen = new_path(spark, "models"), stateful.FEATURES, retraining.held_out("session_id")
    detector.SessionDetector(names=names).fit(early.where(~unseen)).save(registry.version_path(root, OLDER_VERSION))
    registry.promote(spark, root, OLDER_VERSION)
    labels = sessions.select(F.col("session_id").alias("id"), "label")

    def scored(model, rows):
        return model.predict(rows).join(labels, F.col("session_id") == F.col("id"))

    return retraining.retrain(
        spark, root, VERSION, monitoring.drift_index(*_halves(spark, sf_dir)).first()["drift"],
        lambda: detector.SessionDetector(names=names).fit(late.where(~unseen)), detector.SessionDetector.load, scored,
        late.where(unseen).join(labels, F.col("session_id") == F.col("id")).drop("id"), threshold=0.0,
    )

"""Activity features from events to stored vectors (M4): what a feature refresh runs."""

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from keystride import schema as S
from keystride.plans.session_features import activity_features
from keystride.plans.vectors import fit_features
from keystride.session import materialise
from keystride.sources.feature_store import write_version

RAW_VIEW = "raw_behavioral_data"


@dataclass
class FeatureBuild:
    model: PipelineModel
    features: DataFrame


def vectorise(activity: DataFrame, names: list[str] | None = None) -> FeatureBuild:
    """Fit the vector stages on `activity` and apply them to it.

    The aggregate is read by both fits and by the result, so it is written once. Sessions too
    short for a deviation get 0.0 there, because the assembler refuses NULL.
    """
    names = names or S.ACTIVITY_VECTOR
    table = materialise(activity.fillna(0.0, names), "activity")
    model = fit_features(table, names)
    return FeatureBuild(model, model.transform(table).drop("signless_features"))


def register_raw(raw: DataFrame) -> str:
    """Make interaction rows readable in SQL; returns the view's name."""
    raw.createOrReplaceTempView(RAW_VIEW)
    return RAW_VIEW


ACTIVITY_SQL = """
    select session_id,
           avg(time_between_keystrokes) as avg_typing_speed,
           stddev_samp(time_between_keystrokes) as typing_rhythm_consistency,
           percentile_approx(time_between_keystrokes, :burst) as typing_burst_speed,
           avg(mouse_velocity) as avg_mouse_speed,
           stddev_samp(mouse_movement_angle) as mouse_direction_entropy,
           count(distinct mouse_click_position) as distinct_click_positions,
           array_sort(collect_set(device_orientation)) as device_orientation_changes,
           array_sort(collect_set(screen_resolution)) as screen_resolution_changes,
           count(*) as total_interactions,
           count_if(hour(`timestamp`) between :night_from and :night_to) as late_night_activity
    from {raw} group by session_id"""
ACTIVITY_SETTINGS = {"burst": 0.9, "night_from": 0, "night_to": 5}


def sql_features(raw: DataFrame, statement: str = ACTIVITY_SQL, settings: dict | None = None, **tables: DataFrame) -> DataFrame:
    """The result of a SQL statement over interaction rows, which it names {raw}.

    `settings` fill its :markers, further DataFrames its {names}. The names exist for this statement only:
    no view is left in the session, and two builds at a time do not meet.
    """
    return raw.sparkSession.sql(statement, args=settings if settings is not None else ACTIVITY_SETTINGS, raw=raw, **tables)


def process_raw(raw: DataFrame, root: str, version: str, written_at: str) -> FeatureBuild:
    """From interaction rows (schema.RAW) to a stored feature version."""
    return build_and_store(activity_features(raw), root, version, written_at)


def build_and_store(
    activity: DataFrame, root: str, version: str, written_at: str
) -> FeatureBuild:
    built = vectorise(activity)
    write_version(built.features, root, version, written_at)
    return built

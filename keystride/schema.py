"""Schemas, column orders and settings shared by every job."""

# ---- fixed values: field names and types of the client payload ----------------------------
# `pos` inside an element is optional; clients leave it out (see sources.payloads).
PAYLOAD = """
    session_id string,
    timestamp string,
    session_duration double,
    keystroke_data array<struct<event_type: string, key_code: int, timestamp: double, pos: bigint>>,
    mouse_data array<struct<type: string, x: double, y: double, button: string, timestamp: double,
                            pos: bigint>>,
    device_info struct<screen_resolution: string, browser_language: string, timezone_offset: int,
                       platform: string, is_mobile: boolean>
"""

REQUIRED_FIELDS = ["session_id", "timestamp"]

# One row per key or mouse event. `lane` is key, movement or click: the sequence the event
# belongs to inside its session. `pos` is unique within a session and breaks ties on `t`.
EVENT = """
    session_id string,
    pos bigint,
    event_time timestamp,
    t double,
    lane string,
    kind string,
    key_code int,
    x double,
    y double,
    button string,
    screen_resolution string
"""

# Input of the activity aggregate.
RAW = """
    session_id string,
    timestamp timestamp,
    time_between_keystrokes double,
    mouse_velocity double,
    mouse_movement_angle double,
    mouse_click_position string,
    device_orientation string,
    screen_resolution string
"""

# ---- fixed values: feature names and their order ------------------------------------------
KEYSTROKE_FEATURES = [
    "mean_hold_time", "std_hold_time", "mean_interkey_time", "std_interkey_time", "typing_speed",
]
MOUSE_FEATURES = [
    "mean_velocity", "std_velocity", "mean_acceleration", "std_acceleration",
    "click_frequency", "movement_smoothness",
]
DEVICE_FEATURES = [
    "screen_width", "screen_height", "screen_ratio", "is_mobile", "timezone_offset",
]
SESSION_FEATURES = (
    [f"keystroke_{name}" for name in KEYSTROKE_FEATURES]
    + [f"mouse_{name}" for name in MOUSE_FEATURES]
    + [f"device_{name}" for name in DEVICE_FEATURES]
    + ["session_duration"]
)
ACTIVITY_VECTOR = [
    "avg_typing_speed", "typing_rhythm_consistency", "typing_burst_speed",
    "avg_mouse_speed", "mouse_direction_entropy", "distinct_click_positions",
    "total_interactions", "late_night_activity",
]

# ---- fixed values: thresholds and model settings ------------------------------------------
LONG_PAUSE_SECONDS = 2.0
HIGH_RISK = 0.7
MEDIUM_RISK = 0.3
IFOREST_WEIGHT = 0.7
RF_WEIGHT = 0.3
NUM_TREES = 100
MAX_DEPTH = 10
CONTAMINATION = 0.1
SEED = 42
PCA_COMPONENTS = 5
MAX_SAMPLES = 256
ALERT_FALSE_POSITIVE_RATE = 0.1
ALERT_DRIFT = 0.2
ALERT_DEGRADATION = 0.15
METRICS_WINDOW = "5 minutes"
FEATURE_REFRESH = "1 hour"
RETENTION_DAYS = 90
FLUSH_INTERVAL = "5 seconds"
VERSION_FORMAT = "yyyyMMdd_HHmmss"

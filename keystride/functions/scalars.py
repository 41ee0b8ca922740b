"""Column expressions: device fields, keys, risk tiers and report text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystride import schema as S

# ---- fixed values: mobile user agents, report texts ---------------------------------------
MOBILE_PATTERN = "(?i)Mobile|Android|iPhone"
RESOLUTION_PATTERN = r"^\s*([+-]?\d+)\s*x\s*([+-]?\d+)\s*$"
TIER_MESSAGES = {
    "high": "High Risk: Suspicious behavior detected!",
    "medium": "Medium Risk: Some unusual patterns detected.",
    "low": "Low Risk: Your behavior appears normal.",
}
TIER_ICONS = {"high": "⚠", "medium": "⚠", "low": "✓"}


def screen_size(resolution: Column) -> tuple[Column, Column]:
    """Width and height of a WxH text; both NULL where it is anything else."""
    return tuple(
        F.regexp_extract(resolution, RESOLUTION_PATTERN, side).try_cast("int")
        for side in (1, 2)
    )


def resolution_text(width: Column, height: Column) -> Column:
    return F.concat_ws("x", width.cast("string"), height.cast("string"))


def is_mobile_agent(user_agent: Column) -> Column:
    return user_agent.rlike(MOBILE_PATTERN)


def session_key(seed_text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a time text."""
    return F.substring(F.sha2(seed_text, 256), 1, 16)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def millis_to_seconds(millis: Column) -> Column:
    return millis / F.lit(1000.0)


def iso_timestamp(ts: Column) -> Column:
    """UTC, whatever the session's zone."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def version_of(ts: Column) -> Column:
    return F.date_format(ts, S.VERSION_FORMAT)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def risk_tier(risk: Column) -> Column:
    """Both bounds are strict: exactly 0.7 is medium and exactly 0.3 is low."""
    return (
        F.when(risk > S.HIGH_RISK, "high").when(risk > S.MEDIUM_RISK, "medium")
        .when(risk.isNotNull(), "low")
    )


def percent_text(share: Column) -> Column:
    return F.format_string("%.1f%%", (share * 100).cast("double"))


def _choose(tier: Column, texts: dict[str, str]) -> Column:
    return (
        F.when(tier == "high", texts["high"]).when(tier == "medium", texts["medium"])
        .when(tier == "low", texts["low"])
    )


def tier_message(tier: Column) -> Column:
    return _choose(tier, TIER_MESSAGES)


def tier_icon(tier: Column) -> Column:
    return _choose(tier, TIER_ICONS)

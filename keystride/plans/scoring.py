"""Risk scores and their explanation (M9, M10, M12, M13, T2, P16, P17) as expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystride import schema as S
from keystride.functions.scalars import (
    percent_text, risk_tier, sigmoid, tier_icon, tier_message,
)

# ---- fixed values: phrases shown for a session --------------------------------------------
UNUSUAL = {
    "rhythm": "irregular typing rhythm",
    "mouse": "unusual mouse movement patterns",
    "device": "unexpected device characteristics",
    "timing": "abnormal input timing",
    "behaviour": "suspicious behavioral patterns",
}
NORMAL = {
    "rhythm": "consistent typing pattern",
    "mouse": "smooth mouse movements",
    "device": "expected device profile",
    "timing": "natural input timing",
    "behaviour": "typical user behavior",
}
# Which features speak for which phrase.
FAMILIES = {
    "rhythm": ["keystroke_mean_interkey_time", "keystroke_std_interkey_time",
               "keystroke_typing_speed"],
    "mouse": [f"mouse_{n}" for n in S.MOUSE_FEATURES],
    "device": [f"device_{n}" for n in S.DEVICE_FEATURES],
    "timing": ["keystroke_mean_hold_time", "keystroke_std_hold_time"],
    "behaviour": ["session_duration"],
}
FACTORS = 3


def detector_risk(scored: DataFrame, raw: str = "raw_score") -> DataFrame:
    """Risk and confidence from a raw isolation score in [-1, 0)."""
    normal = sigmoid(F.col(raw))
    return scored.withColumn("risk_score", 1 - normal).withColumn(
        "confidence", confidence_of("risk_score")
    )


def confidence_of(risk: str) -> Column:
    """Distance from an undecided score, scaled to [0, 1]."""
    return F.abs(F.col(risk) - 0.5) * 2


def ensemble_risk(iforest: Column, forest: Column | None = None) -> Column:
    """Weighted risk from the normality `iforest` and the class-1 probability `forest`.

    Without a supervised model the isolation forest decides alone.
    """
    isolation = 1 - iforest
    if forest is None:
        return isolation
    return S.IFOREST_WEIGHT * isolation + S.RF_WEIGHT * forest


def contributions(scaled: DataFrame, names: list[str]) -> DataFrame:
    """Replace each scaled feature by its share of the absolute sum.

    When the sum is 0 every share stays 0.
    """
    total = sum((F.abs(n) for n in names), F.lit(0.0))
    return scaled.withColumn("total", total).withColumns({
        n: F.when(F.col("total") > 0, F.abs(n) / F.col("total")).otherwise(F.abs(n))
        for n in names
    }).drop("total")


def contribution_map(names: list[str]) -> Column:
    return F.create_map(*[c for n in names for c in (F.lit(n), F.col(n))])


def contribution_rows(scaled: DataFrame, names: list[str]) -> DataFrame:
    return contributions(scaled, names).select(
        "session_id", F.explode(contribution_map(names)).alias("feature", "contribution")
    )


def factor_list(names: list[str], tier: Column) -> Column:
    """The three families that contribute most, worded by tier, as an array.

    Expects the columns `names` to hold contributions. High risk words all three as unusual,
    medium only the first, low none. Ranking inside an array of five needs no shuffle.
    """
    def share(members: list[str]) -> Column:
        return F.round(sum((F.col(n) for n in members if n in names), F.lit(0.0)), 9)

    # Ascending by the negated share, then by name.
    families = F.sort_array(F.array(*[
        F.struct((-share(members)).alias("order"), F.lit(name).alias("family"))
        for name, members in FAMILIES.items()
    ]))
    unusual_count = F.when(tier == "high", FACTORS).when(tier == "medium", 1).otherwise(0)
    unusual = F.create_map(*[F.lit(x) for pair in UNUSUAL.items() for x in pair])
    normal = F.create_map(*[F.lit(x) for pair in NORMAL.items() for x in pair])

    def words(place: int) -> Column:
        family = F.get(families, F.lit(place))["family"]
        return F.when(F.lit(place) < unusual_count, unusual[family]).otherwise(normal[family])

    return F.array(*[words(place) for place in range(FACTORS)])


def report(scored: DataFrame) -> DataFrame:
    """The texts shown for a scored session."""
    tier = risk_tier(F.col("risk_score"))
    return scored.withColumns({
        "tier": tier,
        "message": tier_message(tier),
        "icon": tier_icon(tier),
        "risk_text": percent_text(F.col("risk_score")),
        "confidence_text": percent_text(F.col("confidence")),
    })

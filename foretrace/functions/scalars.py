"""Small column rules shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published thresholds and labels.
CONFIDENCE_TIERS = [(0.60, "Strong Pick"), (0.55, "Lean"), (0.00, "Toss-Up")]
CALIBRATION_EDGES = [0.0, 0.40, 0.45, 0.50, 0.55, 0.60, 1.0]
CALIBRATION_LABELS = ["<40%", "40-45%", "45-50%", "50-55%", "55-60%", ">60%"]
EDGE_EDGES = [-1.0, -0.05, -0.02, 0.02, 0.05, 1.0]
EDGE_LABELS = ["< -5%", "-5..-2%", "-2..+2%", "+2..+5%", "> +5%"]
PREGAME_STATES = ["FUT", "PRE"]
FINAL_STATES = ["OFF", "FINAL", "OVER"]
RATIO_EPSILON = 1e-9
MIN_FEATURE_COVERAGE = 0.70


def mmss_seconds(text: Column) -> Column:
    """'MM:SS' to seconds; blank or malformed is zero."""
    parts = F.split(text, ":")
    value = F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")
    return F.coalesce(value.cast("double"), F.lit(0.0))


def situation(shooting: Column, defending: Column) -> Column:
    """Manpower class seen from the shooting side."""
    return (
        F.when(shooting > defending, "PP")
        .when(shooting < defending, "PK")
        .when((shooting == 5) & (defending == 5), "5v5")
        .otherwise("other")
    )


def share(own: Column, other: Column) -> Column:
    """Own part of a total, guarded by a tiny constant instead of a null."""
    return own / (own + other + RATIO_EPSILON)


def confidence_tier(prob_favourite: Column) -> Column:
    """Label of the first threshold the favoured side's probability reaches."""
    label = F.lit(None).cast("string")
    for threshold, name in reversed(CONFIDENCE_TIERS):
        label = F.when(prob_favourite >= threshold, name).otherwise(label)
    return F.when(prob_favourite.isNotNull(), F.coalesce(label, F.lit(CONFIDENCE_TIERS[-1][1])))


def right_closed(value: Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Bucket label for bins ``(a, b]``; outside every bin is null."""
    low_ok = value >= edges[0] if include_lowest else value > edges[0]
    label = None
    for upper, name in zip(edges[1:], labels):
        label = F.when(low_ok & (value <= upper), name) if label is None else label.when(low_ok & (value <= upper), name)
    return label


def squared_error(prob: Column, actual: Column) -> Column:
    return F.pow(prob - actual, F.lit(2.0))


def pick_correct(prob: Column, actual: Column) -> Column:
    """Whether the pick was right; null until the result is known."""
    return F.when(actual.isNotNull(), (prob >= 0.5) == (actual == 1.0))


def effective_date(game_date: Column, predicted_at: Column) -> Column:
    """Stored game date, else the date part of the prediction stamp."""
    return F.coalesce(game_date.cast("string"), F.substring(predicted_at.cast("string"), 1, 10))


def pair_key(a: Column, b: Column) -> Column:
    """Same text for (a, b) and (b, a)."""
    return F.concat_ws("_", F.least(a, b), F.greatest(a, b))


def coverage(columns: Sequence[str], present: Sequence[str]) -> Column:
    """Populated fraction of ``columns``; one that is absent counts as null."""
    known = set(present)
    filled = [F.col(c).isNotNull().cast("int") for c in columns if c in known]
    total = sum(filled[1:], filled[0]) if filled else F.lit(0)
    return total / F.lit(float(len(columns)))


def started(state: Column) -> Column:
    """Past its pre-game states; an unknown state counts as not started."""
    return F.coalesce(~state.isin(PREGAME_STATES), F.lit(False))


def rate_per_hour(amount: Column, seconds: Column) -> Column:
    """``amount`` per hour; null when no time was played."""
    return F.try_divide(amount.cast("double"), F.try_divide(seconds.cast("double"), F.lit(3600.0)))


def elo_expected(rating: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - rating) / 400))


def elo_actual(win: Column, overtime: Column, overtime_value: float) -> Column:
    """Score credited to the home side; an overtime result is discounted."""
    return F.when(F.coalesce(overtime.cast("double"), F.lit(0.0)) == 0.0, win).when(
        win == 1.0, F.lit(overtime_value)
    ).when(win.isNotNull(), F.lit(1.0 - overtime_value))

"""Prices and probabilities: moneylines, margins, edges."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def parse_american(text: Column) -> Column:
    """Integer moneyline, null where the text is not an integer."""
    return text.try_cast("int")


def implied_prob(moneyline: Column, digits: int | None = None) -> Column:
    """Implied probability of an American moneyline, margin included."""
    ml = moneyline.cast("double")
    raw = F.when(ml > 0, 100 / (ml + 100)).when(ml <= 0, F.abs(ml) / (F.abs(ml) + 100))
    return raw if digits is None else F.bround(raw, digits)


def fair_pair(home_ml: Column, away_ml: Column, round_first: bool = False, digits: int | None = None):
    """No-margin probabilities of both sides.

    ``round_first`` rounds the raw probabilities to four places before they
    are normalised, as one of the two feeds does.
    """
    raw_digits = 4 if round_first else None
    home, away = implied_prob(home_ml, raw_digits), implied_prob(away_ml, raw_digits)
    total = home + away
    pair = (home / total, away / total)
    return pair if digits is None else tuple(F.bround(p, digits) for p in pair)


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``ml_to_prob`` callable from SQL, inlined by the optimizer."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION ml_to_prob(ml INT) RETURNS DOUBLE RETURN "
        "CASE WHEN ml > 0 THEN round(100.0D / (ml + 100), 4) "
        "WHEN ml <= 0 THEN round(abs(ml) / CAST(abs(ml) + 100 AS DOUBLE), 4) END"
    )


def favoured(prob_home: Column, price_home: Column) -> dict[str, Column]:
    """Pick, model probability, market probability and edge of the favoured side."""
    home = prob_home >= 0.5
    return {
        "picked_home": home,
        "model_p": F.when(home, prob_home).otherwise(1 - prob_home),
        "market_p": F.when(home, price_home).otherwise(1 - price_home),
        "edge": F.when(home, prob_home - price_home).otherwise(price_home - prob_home),
    }


def mean_half_even(value: Column, digits: int) -> Column:
    """Mean of values that have ``digits`` places, rounded half-even to as many.

    An aggregate over whole units: sums of integers are exact in any order, so
    a tie is a tie on every run and every partitioning.
    """
    unit = 10**digits
    total = F.sum(F.round(value * unit).cast("bigint"))
    n = F.count(value)
    low = F.floor(total / n)
    low = low - (low * n > total).cast("bigint")
    twice = 2 * (total - low * n)
    up = (twice > n) | ((twice == n) & (low % 2 != 0))
    return F.when(n > 0, (low + up.cast("bigint")) / unit)

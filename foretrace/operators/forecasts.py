"""Scores of count forecasts and the factors that correct them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.functions.counts import over_probability
from foretrace.session import bounded

MIN_IN_SEASON_SAMPLE = 100


def count_errors(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and bias of ``pred`` against ``y``."""
    gap = F.col("y") - F.col("pred")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"), (F.avg("pred") - F.avg("y")).alias("bias"))


def count_scoring(rows: DataFrame, lines: Sequence[float], by: Sequence[str] = (), dispersion: float = 0.0,
                  reference: DataFrame | None = None) -> DataFrame:
    """Per line: Brier of P(over), climatology Brier, accuracy and majority share.

    All lines come from one aggregate; the rows are not multiplied. The
    climatology rate is that of ``reference`` (training rows), by default of
    the scored rows themselves. It only enters through moments, so a second
    pass over the rows is not needed: mean((r - a)^2) = r^2 - 2 r a + a.
    """
    y = F.col("y")

    def parts(line: float):
        over = (y > line).cast("double")
        prob = over_probability(F.col("pred"), line, dispersion)
        return F.struct(
            F.lit(line).alias("line"), F.count("*").alias("n"),
            F.avg(F.pow(prob - over, F.lit(2))).alias("brier"),
            F.avg(((prob > 0.5) == (over == 1.0)).cast("double")).alias("accuracy"),
            F.avg(over).alias("over_rate"))

    scored = rows.groupBy(*by).agg(F.array(*[parts(x) for x in lines]).alias("p")).select(*by, F.inline("p"))
    if reference is None:
        scored = scored.withColumn("rate", F.col("over_rate"))
    else:
        base = reference.groupBy(*by).agg(F.array(*[
            F.struct(F.lit(x).alias("line"), F.avg((y > x).cast("double")).alias("rate")) for x in lines
        ]).alias("p")).select(*by, F.inline("p"))
        scored = scored.join(base, [*by, "line"])
    a, rate = F.col("over_rate"), F.col("rate")
    return scored.select(
        *by, "line", "n", "brier", (rate * rate - 2 * rate * a + a).alias("brier_base"), "accuracy",
        F.greatest(a, 1 - a).alias("acc_base"), "over_rate")


def line_skill(scores: DataFrame) -> DataFrame:
    """Line scores averaged over folds, and the Brier skill they give."""
    cols = ["brier", "brier_base", "accuracy", "acc_base", "over_rate"]
    mean = scores.groupBy("line").agg(*[F.avg(c).alias(c) for c in cols])
    return mean.withColumn("skill", 1 - F.try_divide(F.col("brier"), F.col("brier_base")))


def nb_dispersion(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Method-of-moments dispersion, never below zero."""
    y, mu = F.col("y"), F.col("pred")
    extra = F.avg(F.pow(y - mu, F.lit(2)) - mu)
    return rows.groupBy(*by).agg(
        F.coalesce(F.greatest(F.try_divide(extra, F.avg(mu * mu)), F.lit(0.0)), F.lit(0.0)).alias("dispersion"))


def drift_factor(rows: DataFrame, by: Sequence[str] = (), min_sample: int = 0) -> DataFrame:
    """Actual over predicted mean; one below ``min_sample`` or without a forecast."""
    mean = F.avg("pred")
    usable = (F.count("*") >= min_sample) & (mean > 0)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.when(usable, F.try_divide(F.avg("y"), mean)).otherwise(1.0).alias("factor"))


def apply_factor(rows: DataFrame, factors: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scale each forecast by its group's factor (an intercept shift under a log link).

    The factor table has one row per group; where there is none it is one.
    """
    joined = rows.join(bounded(factors.select(*by, "factor")), list(by), "left")
    return joined.withColumn("pred", F.col("pred") * F.coalesce("factor", F.lit(1.0))).drop("factor")

"""Column statistics, logistic fits and permuted scores against Spark's own steps."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from foretrace.operators import models as M
from foretrace.operators import trials as T

COLUMNS = ["form", "rating", "gap", "rare", "same"]


@pytest.fixture(scope="module")
def games(spark):
    """Correlated, rare, constant and empty features; some results are not known yet."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        form, rating = float(rng.normal(3, 2)), float(rng.normal(1500, 50))
        target = float(rng.random() < 1 / (1 + np.exp(-0.5 * (form - 3) - (rating - 1500) / 60)))
        rows.append((i, form, rating, form - rating, float(rng.random()) if i % 3 else None, 7.0, None, target if i % 20 else None))
    return spark.createDataFrame(rows, "game_id bigint, form double, rating double, gap double, rare double, same double, none double, target double")


def test_logistic_fit_is_the_minimum_that_spark_looks_for(spark, games):
    fit = M.fit_classifier(games, [*COLUMNS, "none"])
    known, filled = games.where("target IS NOT NULL"), [f"_f_{c}" for c in COLUMNS]
    theirs = Pipeline(stages=[
        Imputer(strategy="mean", inputCols=COLUMNS, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_vector"),
        StandardScaler(withMean=True, withStd=True, inputCol="_vector", outputCol="features"),
        M.classifier("logistic", known.count(), tol=1e-14, maxIter=2000)]).fit(known)
    assert fit.columns == COLUMNS
    assert np.allclose(fit.model.stages[2].std, theirs.stages[2].std, rtol=1e-12) and np.allclose(fit.model.stages[2].mean, theirs.stages[2].mean, rtol=1e-12)
    assert np.allclose(fit.model.stages[-1].coefficients, theirs.stages[-1].coefficients, atol=1e-6)
    both = fit.score(games).select("game_id", "prob").join(M.Fit(theirs, COLUMNS, "logistic").score(games).select("game_id", F.col("prob").alias("other")), "game_id")
    assert both.agg(F.max(F.abs(F.col("prob") - F.col("other")))).first()[0] < 1e-6


def test_logistic_fit_takes_few_jobs(spark, games):
    spark.sparkContext.setJobGroup("few-passes", "")
    try:
        M.fit_classifier(games, COLUMNS)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-passes")) < 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_logistic_fit_of_one_label_is_left_to_spark(spark, games):
    fit = M.fit_classifier(games.withColumn("target", F.lit(1.0)), COLUMNS)
    assert fit.score(games).agg(F.min("prob")).first()[0] == 1.0


def test_permuted_logistic_scores_equal_those_of_scored_rows(spark, games):
    fit = M.fit_classifier(games, COLUMNS)
    rows = [([float(x) for x in np.random.default_rng(i).normal(size=10)], float(i % 2)) for i in range(50)]
    mixed = spark.createDataFrame([(y, x[:5], x[5:]) for x, y in rows], "target double, _own array<double>, _theirs array<double>")
    by_sums, by_rows = ({r["_place"]: (r["n"], r["brier"]) for r in found.collect()} for found in (
        T._errors_by_sums(mixed, "target", fit.model.stages[-1], [0, 2, 4]), T._errors_by_rows(mixed, "target", fit, [0, 2, 4])))
    assert set(by_sums) == {-1, 0, 2, 4}
    assert all(by_sums[k] == pytest.approx(by_rows[k], abs=1e-12) for k in by_rows)

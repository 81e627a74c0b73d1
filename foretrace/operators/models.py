"""Model tables, walk-forward folds and ``pyspark.ml`` fits.

Fits run on Spark: the driver loops over folds, model kinds or parameter sets
(all short lists) and sees metrics, never rows. A fold is chosen by a filter on
the season, so its rows are not copied.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretrace.functions.counts import recency_weight
from foretrace.operators import logistic as N
from foretrace.operators.history import games_before, with_history
from foretrace.session import bounded, pin, stored

# Identifiers and targets that are never features.
NOT_FEATURES = ["game_id", "season", "game_date", "game_num", "game_type", "league", "home_id", "away_id", "target",
                "home_win", "team_id", "player_id", "goalie_id"]
# How far a season has come says nothing about strength.
EXCLUDED = ["home_games_played", "away_games_played", "diff_games_played"]
FOREST = {"numTrees": 200, "maxDepth": 6, "minInstancesPerNode": 20, "featureSubsetStrategy": "sqrt", "seed": 42}
BOOST_DEPTH_FIRST = {"maxIter": 60, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.8, "seed": 42}
BOOST_SHALLOW = {"maxIter": 80, "maxDepth": 2, "stepSize": 0.05, "subsamplingRate": 0.8, "seed": 42}
ISOTONIC_MIN, PLATT_MIN, CALIBRATION_SHARE = 400, 50, 0.15
MIN_TRAIN, MIN_TEST = 100, 50
ISOTONIC_DIGITS = 5
POISSON_ALPHA = 0.1


def season_ages(rows: DataFrame) -> DataFrame:
    """Age of each season counted from the newest, as (season, age).

    The window runs over the distinct seasons only, a handful of rows.
    """
    return rows.select("season").distinct().select(
        "season", (F.row_number().over(Window.orderBy(F.desc("season"))) - 1).cast("bigint").alias("age"))


def feature_columns(df: DataFrame, exclude: Sequence[str] = EXCLUDED) -> list[str]:
    """Numeric columns that are neither identifiers, targets nor excluded."""
    numeric = {"double", "float", "int", "bigint", "smallint"}
    skip = {*NOT_FEATURES, *exclude}
    return [c for c, t in df.dtypes if t in numeric and c not in skip]


# ---- folds and chunks -------------------------------------------------------

def walk_forward(rows: DataFrame) -> DataFrame:
    """Every row with each fold it takes part in and its role there.

    Fold k tests on season k and trains on all earlier ones. The fold table has
    one row per season pair; rows join it on the season, so the expansion is
    the number of folds and no more.
    """
    seasons = rows.select("season").distinct()
    line = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.collect_list("season").over(line)
    table = seasons.select(F.col("season").alias("test_season"), upto.alias("used")).where(F.size("used") > 1)
    table = table.select(
        (F.size("used") - 1).cast("bigint").alias("fold"), "test_season", F.explode("used").alias("season"))
    role = F.when(F.col("season") == F.col("test_season"), "test").otherwise("train")
    return rows.join(bounded(table.withColumn("role", role)), "season")


def folds_of(rows: DataFrame) -> list[tuple[list, object]]:
    """(training seasons, test season) pairs; only season labels reach the driver."""
    seasons = sorted(r[0] for r in rows.select("season").where("season IS NOT NULL").distinct().collect())
    return [(seasons[:i], seasons[i]) for i in range(1, len(seasons))]


def chronological_rank(rows: DataFrame, order: Sequence[str], row_bound: int | None = None) -> DataFrame:
    """Add ``position`` (0-based) and ``of`` over all rows.

    A rank over everything is one history; beyond the split size it is ranked
    chunk by chunk, never in one task.
    """
    total = rows.count()
    keyed = rows.withColumn("_all", F.lit(0))
    ranked = with_history(keyed, ["_all"], order, [games_before("position")], total if row_bound is None else row_bound)
    return ranked.drop("_all").withColumn("of", F.lit(total))


def cut_at(rows: DataFrame, order: Sequence[str], cuts: Callable[[int], Sequence[int]], name: str, row_bound: int | None = None) -> DataFrame:
    """Add ``name``: how many of the positions ``cuts(number of rows)`` lie at or before a row in ``order``.

    Only the columns of the order are ranked; rows are then compared with the
    keys found at the cuts, so wide rows are neither sorted nor brought into
    one task. Where a cut falls between rows of one key, those rows alone are
    numbered among themselves.
    """
    ranked = pin(chronological_rank(rows.select(*order), order, row_bound))
    found = ranked.limit(1).first()
    if found is None:
        return rows.withColumn(name, F.lit(0).cast("bigint"))
    wanted = sorted(c for c in cuts(found["of"]) if c < found["of"])
    types = dict(rows.dtypes)

    def key(row) -> Column:
        return F.struct(*[F.lit(row[c]).cast(types[c]).alias(c) for c in order])

    def is_at(row) -> Column:
        return F.struct(*order).eqNullSafe(key(row))

    at = {r["position"]: r for r in ranked.where(F.col("position").isin(wanted)).collect()}
    def passed(is_past: Callable[[int], Column]) -> Column:
        return sum((is_past(c).cast("bigint") for c in wanted), F.lit(0).cast("bigint"))

    out = rows.withColumn(name, passed(lambda c: F.struct(*order) >= key(at[c])))
    split = {}
    for cut in wanted:
        first = ranked.where(is_at(at[cut])).agg(F.min("position")).first()[0]
        if first < cut:
            split[first] = at[cut]
    for first, row in split.items():
        place = F.row_number().over(Window.partitionBy(*order).orderBy(*order)) + (first - 1)
        tied = rows.where(is_at(row)).withColumn("_place", place)
        tied = tied.withColumn(name, passed(lambda c: F.col("_place") >= c)).drop("_place")
        out = out.where(~is_at(row)).unionByName(tied)
    return out


def oof_chunks(rows: DataFrame, order: Sequence[str], chunks: int = 3, row_bound: int | None = None) -> DataFrame:
    """Contiguous out-of-fold chunks; the remainder falls to the last one."""
    return cut_at(rows, order, lambda of: [i * max(of // chunks, 1) for i in range(1, chunks)], "chunk", row_bound)


def ensemble_mean(parts: Sequence[DataFrame], key: str = "game_id", value: str = "prob") -> DataFrame:
    """Mean probability over several models' predictions of the same rows."""
    union = parts[0].select(key, value)
    for part in parts[1:]:
        union = union.unionByName(part.select(key, value))
    return union.groupBy(key).agg(F.avg(value).alias(value), F.count("*").alias("n_models"))


def impute_means(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Column means of the training rows, one row per group."""
    return rows.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


# ---- classifiers ------------------------------------------------------------

@dataclass
class Fit:
    """A fitted classifier with its columns and optional calibration."""

    model: PipelineModel
    columns: list[str]
    kind: str
    calibration: object | None = None
    method: str = "none"
    metadata: dict = field(default_factory=dict)

    def score(self, rows: DataFrame) -> DataFrame:
        """Add ``prob``; rows keep their own columns."""
        ready = with_columns_present(rows, self.columns)
        return self.probabilities(self.model.transform(ready)).select(*rows.columns, "prob")

    def probabilities(self, out: DataFrame) -> DataFrame:
        """Add ``prob`` to rows that the model has transformed."""
        out = out.withColumn("_raw", vector_to_array("probability")[1])
        if self.method == "isotonic":
            out = self.calibration.transform(out).withColumn("prob", F.col("_iso"))
        elif self.method == "platt":
            out = self.calibration.transform(out.drop("probability", "rawPrediction", "prediction"))
            out = out.withColumn("prob", vector_to_array("probability")[1])
        else:
            out = out.withColumn("prob", F.col("_raw"))
        return out


def with_columns_present(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Features as doubles; an absent one becomes a null column."""
    have = set(rows.columns)
    extra = [F.lit(None).cast("double").alias(c) for c in columns if c not in have]
    own = [F.col(c).cast("double").alias(c) if c in set(columns) else F.col(c) for c in rows.columns]
    return rows.select(*own, *extra)


def usable_columns(rows: DataFrame, columns: Sequence[str]) -> tuple[list[str], int]:
    """Columns with at least one value (the imputer cannot mean an empty one) and the row count, in one pass."""
    filled = rows.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if filled[c] > 0], filled["_rows"]


def classifier(kind: str, n_rows: int, label: str = "target", **params):
    if kind == "logistic":
        # An L2 penalty of C = 1 on a summed loss is 1 / n on Spark's mean loss.
        return LogisticRegression(labelCol=label, **{"regParam": 1.0 / max(n_rows, 1), "maxIter": 200, **params})
    if kind == "forest":
        return RandomForestClassifier(labelCol=label, **{**FOREST, **params})
    if kind == "boost":
        return GBTClassifier(labelCol=label, **{**BOOST_DEPTH_FIRST, **params})
    if kind == "boost_shallow":
        return GBTClassifier(labelCol=label, **{**BOOST_SHALLOW, **params})
    raise ValueError(f"unknown model kind {kind}")


def column_steps(spark: SparkSession, columns: Sequence[str], stats: N.Stats) -> PipelineModel:
    """Impute means, assemble and scale, as fitted on rows of these statistics.

    One row of the means and two that lie evenly around them have the same
    means and deviations, so the rows themselves need no further pass.
    """
    filled = [f"_f_{c}" for c in columns]
    means = spark.createDataFrame([tuple(stats.mean.tolist())], ", ".join(f"`{c}` double" for c in columns))
    imputer = Imputer(strategy="mean", inputCols=list(columns), outputCols=filled).fit(means)
    apart = stats.deviation / math.sqrt(2.0)
    around = spark.createDataFrame([(Vectors.dense(stats.mean - apart),), (Vectors.dense(stats.mean + apart),)], ["_vector"])
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="_vector", outputCol="features").fit(around)
    return PipelineModel([imputer, VectorAssembler(inputCols=filled, outputCol="_vector"), scaler])


def usable_stats(ready: DataFrame, columns: Sequence[str], label: str) -> tuple[list[str], N.Stats]:
    """Columns with at least one value (the imputer cannot mean an empty one) and their statistics, in one pass."""
    stats = N.column_stats(ready, label, N.array_of(columns), len(columns))
    used = [i for i in range(len(columns)) if stats.known[i] > 0]
    return [columns[i] for i in used], N.Stats(stats.n, stats.zeros, stats.ones, stats.known[used], stats.mean[used], stats.m2[used])


def in_few_passes(kind: str, stats: N.Stats, params: dict) -> bool:
    """Whether a logistic fit is between 0 and 1 with both seen, and nothing is asked of it but a penalty."""
    return kind == "logistic" and set(params) <= {"regParam"} and min(stats.zeros, stats.ones) > 0 and stats.zeros + stats.ones == stats.n


def fit_logistic(rows: DataFrame, values: Column, mean: np.ndarray, scale: np.ndarray, label: str, stats: N.Stats, **params):
    """Spark's logistic model by Newton's method over the scaled array ``values``."""
    last = classifier("logistic", stats.n, label, **params)
    return N.as_model(last, N.newton(rows, label, values, stats, mean, scale, last.getRegParam()))


def fit_classifier(train: DataFrame, columns: Sequence[str], kind: str = "logistic", label: str = "target", **params) -> Fit:
    """Mean-impute, scale and fit; all-null columns are left out.

    ``train`` is read a few times and not copied: store it if it is costly.
    """
    ready = with_columns_present(train.where(F.col(label).isNotNull()), columns).select(label, *columns)
    columns, stats = usable_stats(ready, list(columns), label)
    if not columns:
        raise ValueError("no column has a value in the training rows")
    steps = column_steps(train.sparkSession, columns, stats)
    if in_few_passes(kind, stats, params):
        spread = stats.deviation
        scale = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
        last = fit_logistic(ready, N.array_of(columns), stats.mean, scale, label, stats, **params)
    else:
        last = classifier(kind, stats.n, label, **params).fit(steps.transform(ready).select(label, "features"))
    return Fit(PipelineModel([*steps.stages, last]), columns, kind)


def calibrate(fit: Fit, held_out: DataFrame, label: str = "target", method: str = "auto") -> Fit:
    """Isotonic with 400 rows or more, Platt with 50, else none."""
    n = held_out.where(F.col(label).isNotNull()).count()
    if method == "auto":
        method = "isotonic" if n >= ISOTONIC_MIN else "platt" if n >= PLATT_MIN else "none"
    elif (method == "isotonic" and n < ISOTONIC_MIN) or (method == "platt" and n < PLATT_MIN):
        method = "none"
    if method == "none":
        return fit
    raw = Fit(fit.model, fit.columns, fit.kind).score(held_out.where(F.col(label).isNotNull())).withColumnRenamed("prob", "_raw")
    if method == "isotonic":
        # Rows of one rounded probability are pooled first: the fit then sees bins, not rows.
        bins = raw.groupBy(F.round("_raw", ISOTONIC_DIGITS).alias("_raw")).agg(F.avg(label).alias(label), F.count("*").cast("double").alias("_n"))
        stage = IsotonicRegression(labelCol=label, featuresCol="_raw", weightCol="_n", predictionCol="_iso").fit(bins)
    else:
        stage = Pipeline(stages=[
            VectorAssembler(inputCols=["_raw"], outputCol="_raw_vector"),
            LogisticRegression(labelCol=label, featuresCol="_raw_vector", regParam=1.0 / n, maxIter=200),
        ]).fit(raw)
    return Fit(fit.model, fit.columns, fit.kind, stage, method)


def split_newest(rows: DataFrame, order: Sequence[str], share: float = CALIBRATION_SHARE,
                 row_bound: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(older part, newest ``share``) in chronological order."""
    cut = cut_at(rows, order, lambda of: [math.floor(of * (1 - share))], "_late", row_bound)
    return cut.where("_late = 0").drop("_late"), cut.where("_late = 1").drop("_late")


def brier(scored: DataFrame, label: str = "target") -> float:
    return scored.agg(F.avg(F.pow(F.col("prob") - F.col(label), F.lit(2)))).first()[0]


def union_of(parts: Sequence[DataFrame], empty: DataFrame) -> DataFrame:
    """All parts below each other; ``empty`` gives the columns where there are none."""
    out = empty
    for part in parts:
        out = out.unionByName(part)
    return out


def run_walk_forward(matrix: DataFrame, columns: Sequence[str], kind: str = "logistic", order: Sequence[str] = ("season", "game_num", "game_id"),
                     calibrated: bool = False, label: str = "target", parallel: int = 4, **params) -> DataFrame:
    """Out-of-sample probabilities of every fold: (game_id, season, target, prob).

    Folds are fitted side by side on the same ``matrix``, which is read a few
    times by each and not copied: store it if it is costly. Fewer than two
    seasons have no fold and give no rows.
    """
    from foretrace.operators.trials import side_by_side

    rows = matrix

    def fold(train_seasons: list, test_season) -> DataFrame:
        train = rows.where(F.col("season").isin(train_seasons) & F.col(label).isNotNull())
        test = rows.where(F.col("season") == test_season)
        if calibrated:
            older, newest = split_newest(train, order)
            fit = calibrate(fit_classifier(older, columns, kind, label, **params), newest, label)
        else:
            fit = fit_classifier(train, columns, kind, label, **params)
        return fit.score(test).select("game_id", "season", label, "prob")

    parts = side_by_side(rows.sparkSession, [lambda f=f: fold(*f) for f in folds_of(rows)], parallel)
    return union_of(parts, rows.limit(0).select("game_id", "season", label, F.lit(None).cast("double").alias("prob")))


def ensemble_walk_forward(matrix: DataFrame, columns: Sequence[str], kinds: Sequence[str], label: str = "target") -> DataFrame:
    """Mean of several models' out-of-sample probabilities."""
    runs = [run_walk_forward(matrix, columns, k, label=label) for k in kinds]
    mean = ensemble_mean(runs).drop("n_models")
    return runs[0].drop("prob").join(mean, "game_id")


def stack(train: DataFrame, test: DataFrame, columns: Sequence[str], kinds: Sequence[str], order: Sequence[str],
          chunks: int = 3, label: str = "target") -> DataFrame:
    """Stacked probabilities of ``test``, with the number of chunks they rest on.

    Base models predict each contiguous chunk from the other chunks; a logistic
    regression on those predictions combines base models refitted on all rows.
    A chunk is left out where the others have under 100 rows; ``stack_chunks``
    tells how many were used, and with none the base models' mean is taken.
    """
    from foretrace.operators.trials import fit_kinds

    placed = oof_chunks(train.where(F.col(label).isNotNull()), order, chunks)
    names = [f"p_{k}" for k in kinds]

    def base(rows: DataFrame, held: DataFrame, *own: str) -> DataFrame:
        scored = held
        for name, fit in zip(names, fit_kinds(rows, columns, kinds, label)):
            scored = fit.score(scored).withColumnRenamed("prob", name)
        return scored.select(*own, *names)

    parts = []
    for chunk in range(chunks):
        rest, held = placed.where(F.col("chunk") != chunk), placed.where(F.col("chunk") == chunk)
        if rest.count() >= MIN_TRAIN:
            parts.append(base(rest, held, "game_id", label))
    final = base(placed, test, *test.columns)
    if not parts:
        out = final.withColumn("prob", sum((F.col(n) for n in names), F.lit(0.0)) / len(names))
    else:
        out = fit_classifier(union_of(parts[1:], parts[0]), names, "logistic", label).score(final)
    return out.select(*test.columns, "prob", F.lit(len(parts)).cast("bigint").alias("stack_chunks"))


def random_search(matrix: DataFrame, columns: Sequence[str], kind: str, space: dict[str, Sequence], trials: int,
                  label: str = "target", seed: int = 42) -> tuple[dict, float]:
    """Lowest-Brier parameters on the second newest season, the newest unseen; every trial at its whole budget."""
    from foretrace.operators.trials import halving_search

    train, held = search_split(matrix, label)
    best = halving_search(train, held, columns, kind, space, trials, rungs=1, label=label, seed=seed).where("survived").first()
    return json.loads(best["params"]), best["brier"]


def search_split(matrix: DataFrame, label: str = "target") -> tuple[DataFrame, DataFrame]:
    """(rows before the second newest season, rows of that season with a result)."""
    seasons = sorted(r[0] for r in matrix.select("season").where("season IS NOT NULL").distinct().collect())
    if len(seasons) < 3:
        raise ValueError("a search needs three seasons: to train, to choose and to leave unseen")
    return matrix.where(F.col("season").isin(seasons[:-2])), matrix.where((F.col("season") == seasons[-2]) & F.col(label).isNotNull())


def importances(fit: Fit) -> list[tuple[str, float]]:
    """Features by importance or by absolute weight; a short driver-side list."""
    last = fit.model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return sorted(zip(fit.columns, (float(x) for x in values.toArray())), key=lambda t: -abs(t[1]))


def select_features(train: DataFrame, test: DataFrame, columns: Sequence[str], sizes: Sequence[int],
                    kind: str = "forest", label: str = "target", **params) -> list[tuple[int, float]]:
    """(size, Brier) of the top-n features, ranked inside the training seasons only."""
    from foretrace.operators.trials import sweep

    return [(r["size"], r["brier"]) for r in sweep(train, test, columns, sizes, kind, label, **params).collect()]


def permutation_importance(fit: Fit, rows: DataFrame, columns: Sequence[str], label: str = "target", seed: int = 7) -> DataFrame:
    """Rise in Brier when one column is shuffled between rows, as (feature, brier_rise)."""
    from foretrace.operators.trials import permutation_table

    return permutation_table(fit, rows, columns, label, seed).select("feature", "brier_rise")


# ---- counts -----------------------------------------------------------------

def fit_counts(train: DataFrame, columns: Sequence[str], label: str, half_life: float | None = 0.5,
               alpha: float = POISSON_ALPHA) -> tuple[Fit, float]:
    """Poisson regression with recency weights, and its drift factor.

    ``train`` is read a few times and not copied: store it if it is costly. Its
    vectors are written once as a table, which is all that every step of the
    fit reads. The factor compares actual and predicted means on the newest season; under
    a log link scaling the prediction equals shifting the intercept.
    """
    ages = bounded(season_ages(train))
    ready = with_columns_present(train.where(F.col(label).isNotNull()), columns).join(ages, "season")
    ready = ready.withColumn("_weight", recency_weight(F.col("age"), half_life)).withColumn("_label", F.col(label).cast("double"))
    ready = ready.select("age", "_weight", "_label", *columns)
    columns, _ = usable_columns(ready, columns)
    filled = [f"_f_{c}" for c in columns]
    steps = Pipeline(stages=[
        Imputer(strategy="mean", inputCols=list(columns), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_vector"),
        StandardScaler(withMean=True, withStd=True, inputCol="_vector", outputCol="features"),
    ]).fit(ready)
    vectors = stored(steps.transform(ready).select("age", "_weight", "_label", "features"), "vectors")
    last = GeneralizedLinearRegression(family="poisson", link="log", labelCol="_label", weightCol="_weight", regParam=alpha,
                                       maxIter=50, predictionCol="pred").fit(vectors)
    newest = last.transform(vectors.where("age = 0")).agg(F.avg("_label").alias("y"), F.avg("pred").alias("p")).first()
    factor = newest["y"] / newest["p"] if newest["p"] and newest["p"] > 0 else 1.0
    return Fit(PipelineModel([*steps.stages, last]), list(columns), "poisson", metadata={"factor": factor}), factor


def predict_counts(fit: Fit, rows: DataFrame, extra_factor: float = 1.0) -> DataFrame:
    """Add ``pred``, scaled by the drift factor and an optional in-season one."""
    ready = with_columns_present(rows, fit.columns)
    scale = fit.metadata.get("factor", 1.0) * extra_factor
    return fit.model.transform(ready).select(*rows.columns, (F.col("pred") * F.lit(float(scale))).alias("pred"))


def counts_walk_forward(rows: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Out-of-sample count forecasts; folds too small to trust are skipped, and without any there are no rows."""
    parts = []
    for train_seasons, test_season in folds_of(rows):
        train, test = rows.where(F.col("season").isin(train_seasons)), rows.where(F.col("season") == test_season)
        if train.count() < MIN_TRAIN or test.count() < MIN_TEST:
            continue
        fit, _ = fit_counts(train, columns, label)
        parts.append(predict_counts(fit, test).select("game_id", "season", F.col(label).cast("double").alias("y"), "pred"))
    return union_of(parts, rows.limit(0).select("game_id", "season", *[F.lit(None).cast("double").alias(c) for c in ("y", "pred")]))


# ---- persistence ------------------------------------------------------------

def save_fit(fit: Fit, path: str) -> None:
    """Write the model, its calibration and its column list."""
    fit.model.write().overwrite().save(f"{path}/model")
    if fit.calibration is not None:
        fit.calibration.write().overwrite().save(f"{path}/calibration")
    spark = SparkSession.active()
    text = json.dumps({"columns": fit.columns, "kind": fit.kind, "method": fit.method, **fit.metadata})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_fit(spark, path: str) -> Fit:
    from pyspark.ml.regression import IsotonicRegressionModel

    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    stage = None
    if meta["method"] == "isotonic":
        stage = IsotonicRegressionModel.load(f"{path}/calibration")
    elif meta["method"] == "platt":
        stage = PipelineModel.load(f"{path}/calibration")
    known = {"columns", "kind", "method"}
    return Fit(PipelineModel.load(f"{path}/model"), meta["columns"], meta["kind"], stage, meta["method"],
               {k: v for k, v in meta.items() if k not in known})


def log_metrics(metrics: DataFrame, path: str, run: str) -> None:
    """Append fold metrics to a table of runs."""
    metrics.withColumn("run", F.lit(run)).write.mode("append").parquet(path)

"""Scores of a prediction log, each beside its no-skill baseline.

Every report is one aggregate over scored rows. Reports that take ``by`` give
one row per group (model, season); without it they give a single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions import scalars as S
from foretrace.functions.odds import favoured
from foretrace.operators.history import Total, with_history
from foretrace.session import bounded

MIN_EDGE = 0.03
LOG_LOSS_CLIP = 1e-15
RECENT_ROWS = 25


def _share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def score_rows(log: DataFrame) -> DataFrame:
    """Add ``correct`` and ``brier``; both are null until the game is played."""
    p, y = F.col("prob_home_win"), F.col("actual_home_win")
    return log.select("*", S.pick_correct(p, y).alias("correct"), S.squared_error(p, y).alias("brier"))


def attach_outcomes(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Join results onto the log; a stored result survives a missing fresh one.

    ``outcomes`` has (game_id, home_win). Duplicate games collapse to one row
    before the join.
    """
    fresh = outcomes.groupBy("game_id").agg(F.max("home_win").alias("_fresh"))
    keep = [c for c in log.columns if c not in ("actual_home_win", "correct", "brier")]
    joined = log.join(fresh, "game_id", "left")
    return score_rows(joined.select(*keep, F.coalesce("_fresh", "actual_home_win").alias("actual_home_win")))


def played(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("actual_home_win").isNotNull())


def summarize(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Headline record with the base-rate baselines of the same rows."""
    y = F.col("actual_home_win")
    agg = scored.groupBy(*by).agg(
        F.count(y).alias("n"), F.count("*").alias("n_logged"),
        _share(F.col("correct")).alias("accuracy"), F.avg("brier").alias("brier"),
        F.coalesce(F.sum(F.col("correct").cast("bigint")), F.lit(0)).alias("wins"),
        F.avg(y).alias("home_win_rate"),
    )
    rate = F.col("home_win_rate")
    return agg.select(
        *by, "n", "n_logged", "accuracy", "brier", "wins", (F.col("n") - F.col("wins")).alias("losses"),
        "home_win_rate", F.greatest(rate, 1 - rate).alias("baseline_accuracy"),
        (rate * (1 - rate)).alias("baseline_brier"), F.lit(0.25).alias("coin_flip_brier"))


def calibration_table(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    bucket = S.right_closed(F.col("prob_home_win"), S.CALIBRATION_EDGES, S.CALIBRATION_LABELS, include_lowest=True)
    return (
        played(scored).withColumn("bucket", bucket).where(F.col("bucket").isNotNull()).groupBy(*by, "bucket")
        .agg(F.count("*").alias("n"), F.avg("prob_home_win").alias("predicted"), F.avg("actual_home_win").alias("actual"))
    )


def tier_breakdown(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    p = F.col("prob_home_win")
    return (
        played(scored).withColumn("tier", S.confidence_tier(F.greatest(p, 1 - p))).groupBy(*by, "tier")
        .agg(F.count("*").alias("n"), _share(F.col("correct")).alias("accuracy"), F.avg("brier").alias("brier"))
    )


def _priced(scored: DataFrame, price: str) -> DataFrame:
    return played(scored).where(F.col(price).isNotNull())


def market_comparison(scored: DataFrame, price: str = "closing_prob_home", by: Sequence[str] = ()) -> DataFrame:
    """Model and market on the same rows."""
    p, m, y = F.col("prob_home_win"), F.col(price), (F.col("actual_home_win") == 1.0)
    actual = y.cast("double")
    return _priced(scored, price).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(S.squared_error(p, actual)).alias("model_brier"),
        F.avg(S.squared_error(m, actual)).alias("market_brier"),
        _share((p >= 0.5) == y).alias("model_accuracy"), _share((m >= 0.5) == y).alias("market_accuracy"),
        F.avg(F.abs(p - m)).alias("mean_abs_edge"))


def clv_summary(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean move of the price toward the pick, and how often it moved that way."""
    gap = F.col("closing_prob_home") - F.col("market_prob_home")
    move = F.when(F.col("prob_home_win") >= 0.5, gap).otherwise(-gap)
    return _priced(scored, "closing_prob_home").where(F.col("market_prob_home").isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(move).alias("mean_clv"), _share(move > 0).alias("beat_close_rate"))


def edge_realization_rows(scored: DataFrame, price: str = "closing_prob_home", by: Sequence[str] = ()) -> DataFrame:
    """Played and priced rows from the favoured side, with the bucket of the claimed edge."""
    side = favoured(F.col("prob_home_win"), F.col(price))
    y = (F.col("actual_home_win") == 1.0).cast("double")
    won = F.when(side["picked_home"], y).otherwise(1 - y)
    bucket = S.right_closed(F.round(side["edge"], 9), S.EDGE_EDGES, S.EDGE_LABELS)
    rows = _priced(scored, price).select(
        *by, bucket.alias("bucket"), side["model_p"].alias("model_p"), side["market_p"].alias("market_p"), won.alias("won"))
    return rows.where(F.col("bucket").isNotNull())


def edge_realization(scored: DataFrame, price: str = "closing_prob_home", by: Sequence[str] = ()) -> DataFrame:
    """Claimed edge against what happened, from the favoured side."""
    return edge_realization_rows(scored, price, by).groupBy(*by, "bucket").agg(
        F.count("*").alias("n"), F.avg("model_p").alias("model_said"),
        F.avg("market_p").alias("market_said"), F.avg("won").alias("actual"))


def edge_ranking(preds: DataFrame, min_edge: float = MIN_EDGE) -> DataFrame:
    """Disagreements with the market of at least ``min_edge``, largest first."""
    side = favoured(F.col("prob_home_win"), F.col("market_prob_home"))
    home = side["picked_home"]
    rows = preds.where(F.col("market_prob_home").isNotNull()).select(
        "game_id", F.when(home, F.col("home_id")).otherwise(F.col("away_id")).alias("pick"),
        F.when(home, F.col("away_id")).otherwise(F.col("home_id")).alias("against"),
        side["model_p"].alias("model_p"), side["market_p"].alias("market_p"), F.round(side["edge"], 9).alias("edge"))
    return rows.where(F.col("edge") >= min_edge).withColumn(
        "confidence", S.confidence_tier(F.col("model_p"))).orderBy(F.desc("edge"), "game_id")


def recent_form(scored: DataFrame, order: Sequence[str], last_n: int = RECENT_ROWS) -> DataFrame:
    """Record over the newest ``last_n`` played rows; only those are shuffled."""
    newest = played(scored).orderBy(*[F.desc(c) for c in order]).limit(last_n)
    out = summarize(newest)
    return out.select("n", "accuracy", "brier", "wins", "losses")


def coverage_stats(log: DataFrame, threshold: float = 0.95) -> DataFrame:
    c = F.col("feature_coverage")
    return log.where(c.isNotNull()).agg(
        F.count("*").alias("n"), F.sum((c < threshold).cast("bigint")).alias("n_degraded"), F.min(c).alias("min_coverage"))


def latest_played_date(scored: DataFrame) -> DataFrame:
    """One row with the newest date that has a scored game."""
    return played(scored).agg(F.max("game_date").alias("game_date"))


def day_games(scored: DataFrame, day: DataFrame) -> DataFrame:
    """Every pick of one night; ``day`` holds that one date."""
    p = F.col("prob_home_win")
    home = p >= 0.5
    night = played(scored).join(bounded(day), "game_date", "left_semi")
    tier = S.confidence_tier(F.greatest(p, 1 - p))
    return night.select(
        "game_id", "model_name", F.when(home, F.col("home_id")).otherwise(F.col("away_id")).alias("pick"),
        F.when(home, p).otherwise(1 - p).alias("prob"), tier.alias("confidence"), "correct", "brier",
        "closing_prob_home", (~F.col("correct") & (tier == "Strong Pick")).alias("strong_miss"))


def fold_metrics(preds: DataFrame, by: Sequence[str], fold: str, row_bound: int | None = None) -> DataFrame:
    """Accuracy, Brier, log-loss, ROC-AUC and beat-naive per walk-forward fold.

    Rows collapse to one per distinct probability first; every metric is a
    weighted sum over those. AUC needs, per probability, the losses below it:
    a running total, which splits a hot fold into chunks when it has to.
    The naive rate of a fold is the base rate of all earlier folds; the first
    fold has nothing to learn from and is left out.
    """
    p, y = F.col("prob_home_win"), F.col("actual_home_win")
    cells = preds.where(y.isNotNull()).groupBy(*by, fold, p.alias("p")).agg(
        F.count("*").cast("double").alias("n"), F.sum(y).alias("pos"))
    cells = cells.withColumn("neg", F.col("n") - F.col("pos"))
    ranked = with_history(cells, [*by, fold], ["p"], [Total("below", "neg")], row_bound)
    folds = preds.where(y.isNotNull()).groupBy(*by, fold).agg(
        F.count("*").cast("double").alias("n_test"), F.sum(y).alias("n_pos"))
    line = Window.partitionBy(*by).orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    folds = folds.select(
        "*", F.sum("n_test").over(line).alias("n_train"),
        (F.sum("n_pos").over(line) / F.sum("n_test").over(line)).alias("naive_rate"),
    ).where(F.col("n_train").isNotNull())
    rows = ranked.join(bounded(folds), [*by, fold])
    n, pos, neg, prob, naive = (F.col(c) for c in ("n", "pos", "neg", "p", "naive_rate"))
    clipped = F.least(F.greatest(prob, F.lit(LOG_LOSS_CLIP)), F.lit(1 - LOG_LOSS_CLIP))
    hits = F.when(prob >= 0.5, pos).otherwise(neg)
    beat = F.when(prob > naive, pos).otherwise(0.0) + F.when(prob < naive, neg).otherwise(0.0)

    def total(x: Column, name: str) -> Column:
        return F.sum(x).alias(name)

    sums = rows.groupBy(*by, fold).agg(
        F.first("n_train").cast("bigint").alias("n_train"), F.first("n_test").alias("n_test"), F.first("n_pos").alias("n_pos"),
        F.first("naive_rate").alias("naive_rate"),
        total(hits, "hits"), total(pos * F.pow(1 - prob, F.lit(2)) + neg * F.pow(prob, F.lit(2)), "sq"),
        total(-(pos * F.log(clipped) + neg * F.log(1 - clipped)), "ll"),
        total(pos * (F.col("below") + 0.5 * neg), "pairs"), total(beat, "beat"),
        total(pos * F.pow(1 - naive, F.lit(2)) + neg * F.pow(naive, F.lit(2)), "nsq"))
    size = F.col("n_test")
    return sums.select(
        *by, fold, "n_train", size.cast("bigint").alias("n_test"), (F.col("hits") / size).alias("accuracy"),
        (F.col("sq") / size).alias("brier"), (F.col("ll") / size).alias("log_loss"),
        F.try_divide(F.col("pairs"), F.col("n_pos") * (size - F.col("n_pos"))).alias("roc_auc"),
        (F.col("beat") / size).alias("beat_naive_rate"), (F.col("nsq") / size).alias("naive_brier"))


FOLD_SCORES = ["accuracy", "brier", "log_loss", "roc_auc", "beat_naive_rate", "naive_brier"]


def fold_average(folds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fold metrics averaged with the test sizes as weights."""
    n = F.col("n_test")
    return folds.groupBy(*by).agg(
        F.count("*").alias("n_folds"),
        *[(F.sum(F.col(c) * n) / F.sum(F.when(F.col(c).isNotNull(), n))).alias(c) for c in FOLD_SCORES])


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null share, mean, minimum and maximum of each column, in one pass."""
    parts = [F.struct(
        F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("null_rate"),
        F.avg(F.col(c).cast("double")).alias("mean"), F.min(F.col(c).cast("double")).alias("min"),
        F.max(F.col(c).cast("double")).alias("max")) for c in columns]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))

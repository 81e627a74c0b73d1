"""Player and goalie count projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.functions import scalars as S
from foretrace.functions.counts import over_probability
from foretrace.operators import features as Y
from foretrace.operators.forecasts import MIN_IN_SEASON_SAMPLE, drift_factor
from foretrace.operators.history import games_before, snapshot_next, with_history
from foretrace.operators.joins import roster_identity, without
from foretrace.operators.models import Fit, predict_counts
from foretrace.session import stored

MIN_GAMES = 5
SKIP_POSITIONS = ["G", ""]


def eligible_players(rows: DataFrame, min_games: int = MIN_GAMES) -> DataFrame:
    """Skaters with a valid id and at least ``min_games`` earlier games."""
    return rows.where(
        ~F.col("position").isin(SKIP_POSITIONS) & (F.col("games_played") >= min_games) & (F.col("player_id") > 0))


def top_projections(rows: DataFrame, value: str, minimum: float, top: int = 0, tie: Sequence[str] = ()) -> DataFrame:
    """Projections of at least ``minimum``, largest first; ``top`` 0 keeps all."""
    out = rows.where(F.col(value) >= minimum).orderBy(F.desc(value), *tie)
    return out.limit(top) if top > 0 else out


def goalie_projections(rows: DataFrame, lines: Sequence[float], dispersion: float) -> DataFrame:
    """Round the expected count, then read P(over) off the rounded mean."""
    mean = F.bround("expected", 2)
    return rows.withColumn("expected", mean).select("*", *[
        F.bround(over_probability(F.col("expected"), x, dispersion), 3).alias(f"p_over_{str(x).replace('.', '_')}")
        for x in lines])


def _covered(rows: DataFrame, columns: Sequence[str], minimum: float) -> DataFrame:
    return rows.withColumn("feature_coverage", S.coverage(columns, rows.columns)).where(F.col("feature_coverage") >= minimum)


def player_projections(players: DataFrame, roster: DataFrame, scratched: DataFrame, opponents: DataFrame, fit: Fit,
                       min_sog: float = 0.0, top: int = 0, min_coverage: float = S.MIN_FEATURE_COVERAGE,
                       ice_time: DataFrame | None = None, row_bound: int | None = None) -> DataFrame:
    """Expected shots of everyone on today's roster who is not scratched.

    ``roster`` has (player_id, player_name, team_id, opp_id, position);
    ``opponents`` has ``opp_id`` and ``opp_*`` columns.
    """
    available = without(roster, scratched, ["player_id"])
    features = [*Y.rolling(Y.PLAYER_STATS, Y.PLAYER_WINDOWS), games_before()]
    names = [f.name for f in features]
    snapshot = snapshot_next(
        lambda h: with_history(h, ["player_id"], Y.CAREER, features, row_bound),
        players.where(F.col("player_id").isNotNull()), available.select("player_id"), "player_id", Y.CAREER, names)
    rows = roster_identity(snapshot.where(F.col("games_played") >= MIN_GAMES), available, opponents, ice_time)
    ready = predict_counts(fit, _covered(rows, fit.columns, min_coverage)).withColumn("expected", F.bround("pred", 2))
    # Ordering reads its input twice, for the ranges and for the rows: that should not be the histories.
    return top_projections(stored(ready.drop("pred"), "projections"), "expected", min_sog, top, ["player_id"])


def in_season_factor(fit: Fit, played: DataFrame, target: str, season) -> float:
    """Actual over predicted mean of this season's completed rows; one if they are too few."""
    now = predict_counts(fit, played.where((F.col("season") == season) & F.col(target).isNotNull()))
    return drift_factor(now.select(F.col(target).cast("double").alias("y"), "pred"), (), MIN_IN_SEASON_SAMPLE).first()["factor"]


def saves_projections(goalies: DataFrame, slate: DataFrame, team_context: DataFrame, fit: Fit, lines: Sequence[float],
                      dispersion: float, factor: float = 1.0, min_starts: int = 5,
                      min_coverage: float = S.MIN_FEATURE_COVERAGE, row_bound: int | None = None) -> DataFrame:
    """Expected saves and P(over) of each slate team's probable starter.

    ``slate`` has (team_id, opp_id, is_home); ``team_context`` has team_id and
    ``own_*`` columns, and opp_id-keyed ``opp_*`` columns are read from the
    same frame under their opponent.
    """
    starts = goalies.where("is_starter")
    probable = Y.likely_starter(starts).join(slate, "team_id")
    features = [*Y.rolling(Y.GOALIE_PROP_STATS, Y.GOALIE_PROP_WINDOWS), games_before("starts")]
    names = [f.name for f in features]
    snapshot = snapshot_next(
        lambda h: with_history(h, ["goalie_id"], Y.CAREER, features, row_bound),
        starts, probable.select("goalie_id"), "goalie_id", Y.CAREER, names)
    own = [c for c in team_context.columns if c.startswith("own_")]
    opp = [c for c in team_context.columns if c.startswith("opp_")]
    rows = (
        snapshot.where(F.col("starts") >= min_starts).join(probable, "goalie_id")
        .join(team_context.select("team_id", *own), "team_id", "left")
        .join(team_context.select(F.col("team_id").alias("opp_id"), *opp), "opp_id", "left")
    )
    ready = predict_counts(fit, _covered(rows, fit.columns, min_coverage), factor).withColumn("in_season_factor", F.bround(F.lit(float(factor)), 4))
    ready = stored(ready.withColumnRenamed("pred", "expected"), "projections")
    return goalie_projections(ready, lines, dispersion).orderBy(F.desc("expected"), "goalie_id")

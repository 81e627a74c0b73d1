"""Scoring a slate of scheduled games from next-event snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.functions import scalars as S
from foretrace.operators import facts as X
from foretrace.operators import features as Y
from foretrace.operators import ratings as R
from foretrace.operators.history import snapshot_next, with_history
from foretrace.operators.features import DEFAULT_REST, PAIR_WINDOW
from foretrace.operators.joins import attach_prices, attach_teams, last_event_before, last_meetings
from foretrace.session import pin


def mark_started(preds: DataFrame, schedule: DataFrame) -> DataFrame:
    """Add ``already_started`` from the schedule's game state."""
    states = schedule.groupBy("game_id").agg(F.max("game_state").alias("_state"))
    joined = preds.join(states, "game_id", "left")
    return joined.withColumn("already_started", S.started(F.col("_state"))).drop("_state")


def publish_guard(rows: DataFrame, min_coverage: float = S.MIN_FEATURE_COVERAGE) -> DataFrame:
    """Flag season openers and rows fit to publish.

    An opener needs both ratings; any other game needs enough features.
    """
    opener = F.coalesce(F.least("home_games_played", "away_games_played") == 0, F.lit(False))
    rated = F.col("home_elo").isNotNull() & F.col("away_elo").isNotNull()
    return rows.withColumn("season_opener", opener).withColumn(
        "usable", F.when(F.col("season_opener"), rated).otherwise(
            F.coalesce(F.col("feature_coverage") >= min_coverage, F.lit(False))))


def slate_context(slate: DataFrame, sides: DataFrame, matches: DataFrame, day: Column, opener: Column) -> DataFrame:
    """Rest, advantage, season day and head-to-head of games on ``day``.

    The training default applies: only an unknown rest counts as two days.
    """
    last = last_event_before(sides, day)

    def side(name: str) -> DataFrame:
        return last.select(F.col("team_id").alias(f"{name}_id"), F.col("last_date").alias(f"_{name}_last"))

    rows = slate.join(side("home"), "home_id", "left").join(side("away"), "away_id", "left")
    rest = {s: F.datediff(day, f"_{s}_last").cast("bigint") for s in ("home", "away")}
    rows = rows.select(
        *slate.columns,
        *[rest[s].alias(f"{s}_rest_days") for s in rest],
        *[F.coalesce(rest[s] == 1, F.lit(False)).cast("bigint").alias(f"{s}_back_to_back") for s in rest],
        (F.coalesce(rest["home"], F.lit(DEFAULT_REST)) - F.coalesce(rest["away"], F.lit(DEFAULT_REST))).alias("rest_advantage"),
        F.datediff(day, opener).cast("bigint").alias("season_day"))
    return rows.join(last_meetings(slate, matches, day, PAIR_WINDOW), "game_id", "left")


def slate_features(slate: DataFrame, snapshots: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Attach one snapshot per feature family to both sides of each game.

    ``snapshots`` maps a column prefix to (per-team frame, its columns). The
    one under the empty prefix is required: a game where either team lacks it
    is skipped; the others are optional.
    """
    team, columns = snapshots[""]
    known = team.select("team_id").distinct()
    for side in ("home_id", "away_id"):
        slate = slate.join(known.withColumnRenamed("team_id", side), side, "left_semi")
    out = attach_teams(slate, team, columns)
    for prefix, (frame, names) in snapshots.items():
        if prefix:
            out = attach_teams(out, frame, names, prefix)
    return out


def team_snapshots(shots: DataFrame, matches: DataFrame, season: int, replayed: DataFrame, row_bound: int | None = None,
                   shot_bound: int | None = None, teams: DataFrame | None = None) -> dict[str, tuple[DataFrame, list[str]]]:
    """Next-event features of every family, from the functions that train.

    ``teams`` (team_id) are those of the slate: one that hasn't played this
    season yet gets a row without form and with no games played.

    Families that restart each season read that season only; goalie form and
    ratings read the whole history. ``shots`` and ``matches`` hold what was
    played before the slate; ``replayed`` is their pinned rating pass.
    """
    now = F.col("season") == season
    facts = X.team_games(shots.where(now), matches.where(now).select("game_id", "home_win"))
    strong = Y.opponent_strength(facts, R.pregame(replayed))

    def team_family(history: DataFrame, features) -> tuple[DataFrame, list[str]]:
        names = [f.name for f in features]
        build = lambda h: with_history(h, ["team_id"], Y.IN_SEASON, features, row_bound)
        # One row per team, read once per side: written out rather than rolled twice.
        return pin(snapshot_next(build, history, teams, "team_id", Y.IN_SEASON, names)), names

    team = team_family(strong, [*Y.team_feature_list(), *Y.strength_feature_list()])
    special = team_family(X.special_teams(shots.where(now)), Y.rolling(Y.SPECIAL_STATS, Y.SPECIAL_WINDOWS))
    goalies = X.goalie_games(shots).where("is_starter")
    form = Y.rolling(Y.GOALIE_FORM_STATS, Y.GOALIE_FORM_WINDOWS)
    names = [f.name for f in form]
    goalie = snapshot_next(
        lambda h: with_history(h, ["goalie_id"], Y.CAREER, form, shot_bound), goalies, None, "goalie_id", Y.CAREER, names)
    starter = Y.likely_starter(goalies).join(goalie, "goalie_id").select("team_id", *names)
    return {"": team, "st_": special, "g_": (pin(starter), names)}


def slate_matrix(slate: DataFrame, shots: DataFrame, matches: DataFrame, sides: DataFrame, season: int, day: Column,
                 opener: Column, params: R.EloParams = R.EloParams(), row_bound: int | None = None,
                 shot_bound: int | None = None, groups: DataFrame | None = None) -> DataFrame:
    """The feature matrix of scheduled games, column for column as in training."""
    past = F.col("game_date") < day
    played, seen, legs = matches.where(past), shots.where(past), sides.where(past)
    replayed = pin(R.elo_pass(played, params))
    teams = slate.select(F.col("home_id").alias("team_id")).unionByName(slate.select(F.col("away_id").alias("team_id")))
    snapshots = team_snapshots(seen, played, season, replayed, row_bound, shot_bound, teams)
    rows = slate_features(slate, snapshots)
    rows = slate_context(rows, legs, played, day, opener)
    if groups is not None:
        rows = rows.join(Y.group_flags(slate, groups).select("game_id", "same_division", "same_conference"), "game_id", "left")
    entering = R.entering(R.finals(replayed), F.lit(season), params)
    return attach_teams(rows, entering, ["elo"])


def score_slate(rows: DataFrame, fit, schedule: DataFrame, prices: DataFrame | None, day: Column, model_name: str,
                predicted_at: Column) -> DataFrame:
    """Guard, score, price and stamp a slate; the rows of the prediction log."""
    present = rows.columns
    covered = rows.withColumn("feature_coverage", S.coverage(fit.columns, present))
    kept = publish_guard(covered).where("usable")
    scored = fit.score(kept).withColumnRenamed("prob", "prob_home_win").withColumn("game_date", day)
    if prices is not None:
        scored = attach_prices(scored, prices)
    out = mark_started(scored, schedule).where(~F.col("already_started"))
    return out.withColumn("model_name", F.lit(model_name)).withColumn("predicted_at", predicted_at)

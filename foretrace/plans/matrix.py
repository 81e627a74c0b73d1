"""The per-game feature matrix and the count-model training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.operators import facts as X
from foretrace.operators import features as Y
from foretrace.operators import joins as J
from foretrace.operators import ratings as R
from foretrace.operators.history import with_history
from foretrace.plans.projections import eligible_players
from foretrace.session import pin, stored

GOALIE = Y.rolling_columns(Y.GOALIE_FORM_STATS, Y.GOALIE_FORM_WINDOWS)
SPECIAL = Y.rolling_columns(Y.SPECIAL_STATS, Y.SPECIAL_WINDOWS)
SOG_OWN = [*Y.rolling_columns(Y.PLAYER_STATS, Y.PLAYER_WINDOWS)]
OPP_DEFENCE = ["sf_pct_l20", "xg_against_l20", "hd_chances_against_l20"]
# Team context of the saves model.
OWN_TEAM = ["sf_pct_l20", "xg_against_l20", "hd_chances_against_l20"]
OPP_TEAM = ["xg_for_l20", "hd_chances_for_l20", "sf_pct_l20"]
MIN_STARTS = 5


def team_columns() -> list[str]:
    return [f.name for f in Y.team_feature_list()]


def feature_matrix(shots: DataFrame, matches: DataFrame, sides: DataFrame, groups: DataFrame | None = None,
                   params: R.EloParams = R.EloParams(), row_bound: int | None = None, shot_bound: int | None = None,
                   replayed: DataFrame | None = None) -> DataFrame:
    """One row per game with a known result: every family on both sides.

    ``groups`` maps teams to divisions. The rating chain is pinned once and
    serves both the ratings and the opponent strength. Team and strength
    windows share their partitioning, so they run in the same stage. Shots are
    joined to their games once and written as a table; the three fact tables
    read their columns of that.
    """
    shots = stored(shots, "shots")
    replayed = pin(R.elo_pass(matches, params)) if replayed is None else replayed
    elo = R.pregame(replayed)
    facts = X.team_games(shots, matches.select("game_id", "home_win"))
    strong = Y.opponent_strength(facts, elo)
    own = [*Y.team_feature_list(), *Y.strength_feature_list()]
    rolled = with_history(strong, Y.BY_SEASON, Y.IN_SEASON, own, row_bound)
    names = [f.name for f in own]
    # Both rows of a game know its result; the home row's is the target.
    home_result = F.when(F.col("is_home"), F.col("won")).alias("target")
    games = J.home_away(rolled.select("*", home_result), names, ["target"])
    head = matches.select("game_id", "season", "game_date", "game_num", "home_id", "away_id")
    base = head.join(games, "game_id")
    context = Y.context_features(matches, sides, row_bound)
    base = base.join(context, "game_id", "left")
    if groups is not None:
        base = base.join(Y.group_flags(matches, groups).select("game_id", "same_division", "same_conference"), "game_id", "left")
    goalies = Y.goalie_form(X.goalie_games(shots), shot_bound)
    base = J.attach_sides(base, goalies, GOALIE, prefix="g_", diff=False, sides=matches)
    special = Y.special_features(X.special_teams(shots), row_bound)
    base = J.attach_sides(base, special, SPECIAL, prefix="st_", sides=matches)
    return base.join(elo, "game_id", "left").where(F.col("target").isNotNull())


def sog_training(shots: DataFrame, matches: DataFrame, team_features: DataFrame, positions: DataFrame | None = None,
                 shot_bound: int | None = None) -> DataFrame:
    """Player-games with rolling features and the opponent's defence."""
    rows = Y.player_features(X.player_games(shots), shot_bound)
    rows = rows.withColumn("position", F.lit("F")) if positions is None else rows.join(positions, "player_id", "left")
    return J.opponent_context(eligible_players(rows), matches, team_features, [], OPP_DEFENCE)


def saves_training(shots: DataFrame, matches: DataFrame, team_features: DataFrame, shot_bound: int | None = None) -> DataFrame:
    """Starts with rolling features, own defence and the opponent's attack."""
    rows = Y.goalie_props(X.goalie_games(shots), shot_bound).where(
        (F.col("starts") >= MIN_STARTS) & F.col("saves").isNotNull())
    return J.opponent_context(rows, matches, team_features, OWN_TEAM, OPP_TEAM)

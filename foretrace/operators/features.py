"""Feature families: which stats, which windows, which reset rule.

Team, special-teams and opponent-strength histories restart every season;
goalie, player, rest and head-to-head histories do not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.functions import scalars as S
from foretrace.operators.history import (
    Decayed, Feature, Previous, Recent, Rolling, games_before, with_history,
)
from foretrace.session import bounded

# Windows and stat lists that define the feature columns.
TEAM_WINDOWS = [5, 10, 20]
TEAM_STATS = [
    "xg_for", "xg_against", "xg_for_5v5", "xg_against_5v5", "xgf_pct", "xgf_pct_5v5", "cf_pct", "sf_pct",
    "goals_for", "goals_against", "goal_diff", "hd_chances_for", "hd_chances_against", "won", "regulation_win",
]
FORM_STATS = ["xgf_pct", "xgf_pct_5v5", "cf_pct", "sf_pct", "goals_for", "goals_against", "goal_diff", "won"]
HALF_LIFE = 7
VENUE_WINDOW = 10
GOALIE_FORM_STATS, GOALIE_FORM_WINDOWS = ["save_pct", "gsax"], [5, 10]
GOALIE_PROP_STATS = ["saves", "shots_against", "save_pct", "gsax", "xg_against"]
GOALIE_PROP_WINDOWS = [5, 10, 20]
PLAYER_STATS, PLAYER_WINDOWS = ["sog", "xg", "shot_attempts", "xg_per_attempt"], [10, 20]
SPECIAL_STATS = ["pp_goals", "pp_xg", "pp_shots", "pk_goals_against", "pk_xg_against", "pk_shots_against"]
SPECIAL_WINDOWS = [10, 20]
STRENGTH_STATS = ["xgf_pct", "cf_pct", "won", "goal_diff"]
STRENGTH_WINDOW, STRENGTH_MIN = 20, 3
STRONG_ELO = 1500.0
DEFAULT_REST = 2
PAIR_WINDOW = 3
STARTER_WINDOW = 10
MAX_IDLE_DAYS = 30

BY_SEASON = ["team_id", "season"]
IN_SEASON = ["game_num", "game_id"]
CAREER = ["season", "game_num", "game_id"]


def rolling_columns(stats: Sequence[str], windows: Sequence[int]) -> list[str]:
    return [f"{s}_l{w}" for s in stats for w in windows]


def rolling(stats: Sequence[str], windows: Sequence[int]) -> list[Feature]:
    return [Rolling(f"{s}_l{w}", s, w) for s in stats for w in windows]


def decayed(stats: Sequence[str], half_life: int = HALF_LIFE) -> list[Feature]:
    return [Decayed(f"{s}_ewm{half_life}", s, half_life) for s in stats]


def venue_split(stats: Sequence[str], window: int = VENUE_WINDOW) -> list[Feature]:
    """Means over the games at one venue among the last ``window`` games."""
    return [
        Rolling(f"{s}_{label}_l{window}", f"CASE WHEN is_home = {at_home} THEN {s} END", window)
        for at_home, label in (("true", "home"), ("false", "away")) for s in stats
    ]


def team_feature_list() -> list[Feature]:
    return [*rolling(TEAM_STATS, TEAM_WINDOWS), *decayed(FORM_STATS), *venue_split(FORM_STATS), games_before()]


def team_features(facts: DataFrame, row_bound: int | None = None) -> DataFrame:
    """Every team feature of every team-game: one shuffle by (team, season)."""
    return with_history(facts, BY_SEASON, IN_SEASON, team_feature_list(), row_bound)


def goalie_form(goalies: DataFrame, row_bound: int | None = None) -> DataFrame:
    """Form of each starter over his previous starts, across seasons."""
    starts = goalies.where("is_starter")
    return with_history(starts, ["goalie_id"], CAREER, rolling(GOALIE_FORM_STATS, GOALIE_FORM_WINDOWS), row_bound)


def goalie_props(goalies: DataFrame, row_bound: int | None = None) -> DataFrame:
    starts = goalies.where("is_starter")
    features = [*rolling(GOALIE_PROP_STATS, GOALIE_PROP_WINDOWS), games_before("starts")]
    return with_history(starts, ["goalie_id"], CAREER, features, row_bound)


def player_features(players: DataFrame, row_bound: int | None = None) -> DataFrame:
    features = [*rolling(PLAYER_STATS, PLAYER_WINDOWS), games_before()]
    return with_history(players.where(F.col("player_id").isNotNull()), ["player_id"], CAREER, features, row_bound)


def special_features(games: DataFrame, row_bound: int | None = None) -> DataFrame:
    return with_history(games, BY_SEASON, IN_SEASON, rolling(SPECIAL_STATS, SPECIAL_WINDOWS), row_bound)


def opponent_strength(facts: DataFrame, elo: DataFrame) -> DataFrame:
    """Attach the opponent's pre-game rating; unrated counts as weak.

    ``elo`` has (game_id, home_elo, away_elo). Both ratings of the game are on
    one row, so a join on game_id and a choice by venue replace the unpivot.
    """
    rated = facts.join(elo.select("game_id", "home_elo", "away_elo"), "game_id", "left")
    opponent = F.when(F.col("is_home"), F.col("away_elo")).otherwise(F.col("home_elo"))
    strong = F.coalesce(opponent >= STRONG_ELO, F.lit(False)).cast("bigint")
    return rated.select(*facts.columns, opponent.alias("opp_elo"), strong.alias("opp_is_strong"))


def strength_columns() -> list[str]:
    return [f"{s}_vs_{label}_l{STRENGTH_WINDOW}" for label in ("strong", "weak") for s in STRENGTH_STATS]


def strength_feature_list() -> list[Feature]:
    return [
        Rolling(f"{s}_vs_{label}_l{STRENGTH_WINDOW}", f"CASE WHEN opp_is_strong = {flag} THEN {s} END",
                STRENGTH_WINDOW, STRENGTH_MIN)
        for flag, label in ((1, "strong"), (0, "weak")) for s in STRENGTH_STATS
    ]


def strength_features(facts: DataFrame, row_bound: int | None = None) -> DataFrame:
    """Means against strong and weak opponents among the last twenty games."""
    return with_history(facts, BY_SEASON, IN_SEASON, strength_feature_list(), row_bound)


def rest_days(sides: DataFrame, row_bound: int | None = None) -> DataFrame:
    """Days since the team's previous game and the back-to-back flag."""
    out = with_history(
        sides, ["team_id"], ["game_date", "game_id"], [Previous("prev_date", "game_date")], row_bound)
    days = F.datediff("game_date", "prev_date").cast("bigint")
    return out.select(
        *sides.columns, days.alias("days_rest"), F.coalesce(days == 1, F.lit(False)).cast("bigint").alias("back_to_back"))


def idle_days(appearances: DataFrame, keys: Sequence[str], row_bound: int | None = None) -> DataFrame:
    """Days since the last appearance, at most thirty."""
    out = with_history(
        appearances, keys, ["game_date", "game_id"], [Previous("_prev", "game_date")], row_bound)
    gap = F.datediff("game_date", "_prev").cast("bigint")
    return out.select(*appearances.columns,
                      F.when(gap.isNotNull(), F.least(gap, F.lit(MAX_IDLE_DAYS))).alias("days_since_last"))


def pair_form(matches: DataFrame, row_bound: int | None = None) -> DataFrame:
    """Home win rate over the pair's last three meetings, whoever was at home."""
    keyed = matches.withColumn("pair", S.pair_key(F.col("home_id"), F.col("away_id")))
    feature = Rolling(f"h2h_home_win_rate_l{PAIR_WINDOW}", "home_win", PAIR_WINDOW)
    return with_history(keyed, ["pair"], ["game_date", "game_id"], [feature], row_bound).drop("pair")


def season_day(matches: DataFrame) -> DataFrame:
    """Days since the season's first game.

    The opener is an aggregate joined back on the season; its size, the number
    of seasons, is checked before it is broadcast.
    """
    opener = bounded(matches.groupBy("season").agg(F.min("game_date").alias("season_opener")))
    return matches.join(opener, "season").withColumn(
        "season_day", F.datediff("game_date", "season_opener").cast("bigint"))


def group_flags(matches: DataFrame, groups: DataFrame) -> DataFrame:
    """Same division / same conference flags from a (team_id, division, conference) table."""
    def side(name: str) -> DataFrame:
        return groups.select(
            F.col("team_id").alias(f"{name}_id"), F.col("division").alias(f"_{name}_div"),
            F.col("conference").alias(f"_{name}_conf"))

    joined = matches.join(side("home"), "home_id", "left").join(side("away"), "away_id", "left")

    def same(kind: str):
        return F.coalesce(F.col(f"_home_{kind}") == F.col(f"_away_{kind}"), F.lit(False)).cast("bigint")

    return joined.select(
        *matches.columns, same("div").alias("same_division"), same("conf").alias("same_conference"))


def context_features(matches: DataFrame, sides: DataFrame, row_bound: int | None = None) -> DataFrame:
    """Rest, advantage, season day and head-to-head, one row per match."""
    rest = rest_days(sides, row_bound)
    wide = rest.groupBy("game_id").agg(*[
        F.max(F.when(F.col("is_home") == home, F.col(c))).alias(f"{label}_{name}")
        for home, label in ((True, "home"), (False, "away"))
        for c, name in (("days_rest", "rest_days"), ("back_to_back", "back_to_back"))
    ])
    advantage = F.coalesce("home_rest_days", F.lit(DEFAULT_REST)) - F.coalesce("away_rest_days", F.lit(DEFAULT_REST))
    h2h = pair_form(matches, row_bound).select("game_id", f"h2h_home_win_rate_l{PAIR_WINDOW}")
    day = season_day(matches).select("game_id", "season_day")
    return wide.withColumn("rest_advantage", advantage).join(day, "game_id").join(h2h, "game_id")


def mode_of(ids) -> "F.Column":
    """Most common id of a short array, the most recent one where counts tie."""
    def score(x):
        count = F.size(F.filter(ids, lambda y: y == x))
        last = F.size(ids) - F.array_position(F.reverse(ids), x)
        return F.struct(count.alias("n"), last.alias("last"), x.alias("id"))

    best = F.array_max(F.transform(F.array_distinct(ids), score))
    return F.struct(best["id"].alias("id"), best["n"].cast("bigint").alias("n"),
                    F.size(ids).cast("bigint").alias("of"))


def starter_rule(starts: DataFrame, window: int = STARTER_WINDOW, row_bound: int | None = None) -> DataFrame:
    """The probable-starter rule at every start, scored against who did start."""
    out = with_history(starts, ["team_id"], CAREER, [Recent("_ids", "goalie_id", window)], row_bound)
    guess = mode_of(F.col("_ids"))
    return out.select(*starts.columns, F.when(F.size("_ids") > 0, guess["id"]).alias("guess"))


def likely_starter(starts: DataFrame, window: int = STARTER_WINDOW) -> DataFrame:
    """Most common goalie of each team's last starts, with the share behind it."""
    from foretrace.operators.history import first_per_group

    recent = first_per_group(starts, ["team_id"], [F.desc(c) for c in CAREER], window)
    votes = recent.groupBy("team_id", "goalie_id").agg(
        F.count("*").alias("n"), F.max(F.struct(*CAREER)).alias("last"))
    best = F.max_by("goalie_id", F.struct("n", "last", "goalie_id"))
    out = votes.groupBy("team_id").agg(best.alias("goalie_id"), F.max("n").alias("n"), F.sum("n").alias("of"))
    return out.select(
        "team_id", "goalie_id",
        F.format_string("%d of last %d starts", "n", "of").alias("starter_basis"),
        (F.col("n") / F.col("of")).alias("starter_confidence"))

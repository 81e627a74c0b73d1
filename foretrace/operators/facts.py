"""Per-event facts aggregated from raw measurements.

Each aggregate is one ``groupBy`` with conditional measures, so partial sums
are formed before the shuffle and a hot event costs no more than a small one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions import scalars as S

EVENT = ["game_id", "season", "game_num", "game_date", "game_type"]
FOR_STATS = ["xg_for", "xg_for_5v5", "goals_for", "shots_for", "corsi_for", "hd_chances_for", "hd_goals_for"]
HIGH_DANGER_DISTANCE = 20
REGULATION_PERIODS = 3


def _sum0(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def regular(df: DataFrame) -> DataFrame:
    return df.where(F.col("game_type") == "R")


def team_totals(shots: DataFrame, *extra: Column) -> DataFrame:
    """One row per (game, shooting team); ``extra`` aggregates ride along."""
    even = (F.col("home_skaters") == 5) & (F.col("away_skaters") == 5)
    near = F.col("distance") < HIGH_DANGER_DISTANCE
    totals = shots.groupBy(*EVENT, "team_id", "is_home", "home_id", "away_id").agg(
        _sum0(F.col("xg")).alias("xg_for"),
        _sum0(F.when(even, F.col("xg")).otherwise(0.0)).alias("xg_for_5v5"),
        F.sum("goal").alias("goals_for"),
        F.sum("sog").alias("shots_for"),
        F.count("*").alias("corsi_for"),
        F.sum(near.cast("bigint")).alias("hd_chances_for"),
        F.sum(F.when(near, F.col("goal")).otherwise(0)).alias("hd_goals_for"),
        *extra,
    )
    opponent = F.when(F.col("team_id") == F.col("home_id"), F.col("away_id")).otherwise(F.col("home_id"))
    return totals.withColumn("opp_id", opponent)


def against(totals: DataFrame, stats: Sequence[str] = FOR_STATS) -> DataFrame:
    """Add the opponent's values of ``stats`` as ``*_against``.

    A game has two team rows at most, so the opponent is read in a window over
    the game, which reuses the partitioning of the aggregate below it. A self
    join would shuffle both sides again.
    """
    def of(team: str, stat: str) -> str:
        return f"max(CASE WHEN team_id = {team} THEN {stat} END) OVER (PARTITION BY game_id)"

    return totals.selectExpr("*", *[
        f"CASE WHEN team_id = home_id THEN {of('away_id', s)} ELSE {of('home_id', s)} END AS {s.replace('_for', '_against')}"
        for s in stats
    ])


def ratios(df: DataFrame) -> DataFrame:
    """Shares of each measured total and the naive result."""
    return df.select(
        "*",
        S.share(F.col("xg_for"), F.col("xg_against")).alias("xgf_pct"),
        S.share(F.col("xg_for_5v5"), F.col("xg_against_5v5")).alias("xgf_pct_5v5"),
        S.share(F.col("corsi_for"), F.col("corsi_against")).alias("cf_pct"),
        S.share(F.col("shots_for"), F.col("shots_against")).alias("sf_pct"),
        (F.col("goals_for") - F.col("goals_against")).alias("goal_diff"),
        F.coalesce(F.col("goals_for") > F.col("goals_against"), F.lit(False)).cast("double").alias("won"),
    )


def official_override(df: DataFrame, results: DataFrame) -> DataFrame:
    """Replace ``won`` wherever the official result is known.

    ``results`` has (game_id, home_win); a tie without a result stays a loss
    for both sides and is flagged ``undecided``.
    """
    official = results.select("game_id", F.col("home_win").alias("_official"))
    known = F.col("_official").isNotNull()
    joined = df.join(official, "game_id", "left")
    won = F.when(known, ((F.col("_official") == 1.0) == F.col("is_home")).cast("double")).otherwise(F.col("won"))
    undecided = ~known & F.coalesce(F.col("goals_for") == F.col("goals_against"), F.lit(False))
    keep = [c for c in df.columns if c != "won"]
    return joined.select(*keep, won.alias("won"), undecided.alias("undecided"))


def overtime_games(shots: DataFrame) -> DataFrame:
    """Regular-season games with a shot after the last regulation period."""
    return (
        regular(shots).groupBy("game_id").agg(F.max("period").alias("last_period"))
        .where(F.col("last_period") > REGULATION_PERIODS).select("game_id")
    )


def regulation_win(df: DataFrame, overtime: DataFrame) -> DataFrame:
    """Add ``shot_ot`` and ``regulation_win``."""
    flag = overtime.select("game_id", F.lit(1.0).alias("shot_ot"))
    joined = df.join(flag, "game_id", "left").withColumn("shot_ot", F.coalesce("shot_ot", F.lit(0.0)))
    return joined.withColumn(
        "regulation_win", ((F.col("won") == 1.0) & (F.col("shot_ot") == 0.0)).cast("double"))


def team_games(shots: DataFrame, results: DataFrame) -> DataFrame:
    """The full team-game fact: totals, opponent, ratios, official result.

    The overtime flag comes from the same shuffle as the totals: the highest
    period is one more aggregate over the game.
    """
    late = F.max(F.when(F.col("game_type") == "R", F.col("period"))).alias("last_period")
    paired = against(team_totals(shots, late))
    w = Window.partitionBy("game_id")
    ot = F.coalesce(F.max("last_period").over(w) > REGULATION_PERIODS, F.lit(False)).cast("double")
    flagged = paired.select("*", ot.alias("shot_ot")).drop("last_period")
    decided = official_override(ratios(flagged), results)
    return decided.withColumn(
        "regulation_win", ((F.col("won") == 1.0) & (F.col("shot_ot") == 0.0)).cast("double"))


def player_games(shots: DataFrame) -> DataFrame:
    """One row per (game, player); rows without a player id are kept.

    Name and position, where the shots have them, belong to the key.
    """
    identity = [c for c in ("player_name", "position") if c in shots.columns]
    agg = regular(shots).groupBy("game_id", "season", "game_num", "player_id", *identity, "team_id").agg(
        F.sum("sog").alias("sog"), _sum0(F.col("xg")).alias("xg"), F.count("xg").alias("shot_attempts"),
    )
    rate = F.bround(F.col("xg") / F.greatest(F.col("shot_attempts"), F.lit(1)), 5)
    return agg.withColumn("xg_per_attempt", rate)


def goalie_totals(shots: DataFrame) -> DataFrame:
    """One row per (game, goalie) on the defending side."""
    return (
        regular(shots).where(F.col("goalie_id").isNotNull())
        .groupBy("game_id", "season", "game_num", "game_date", "goalie_id", F.col("def_team_id").alias("team_id"))
        .agg(F.sum("sog").alias("shots_against"), F.sum("goal").alias("goals_against"),
             _sum0(F.col("xg")).alias("xg_against"))
    )


def starter_flag(df: DataFrame) -> DataFrame:
    """Starter: the most shots faced in the team's game and more than half."""
    w = Window.partitionBy("game_id", "team_id")
    faced = F.col("shots_against")
    portion = faced / F.greatest(F.sum(faced).over(w), F.lit(1))
    return df.select(
        "*", portion.alias("shot_share"),
        ((faced == F.max(faced).over(w)) & (portion > 0.5)).alias("is_starter"),
    )


def goalie_games(shots: DataFrame) -> DataFrame:
    saves = F.col("shots_against") - F.col("goals_against")
    return starter_flag(goalie_totals(shots)).select(
        "*", saves.alias("saves"),
        (saves / F.greatest(F.col("shots_against"), F.lit(1))).alias("save_pct"),
        (F.col("xg_against") - F.col("goals_against")).alias("gsax"),
    )


def special_teams(shots: DataFrame) -> DataFrame:
    """Power-play totals for and penalty-kill totals against, per team-game.

    A power-play shot counts for the shooting side and against the other. One
    aggregate per game has both sides' totals, which then become two rows. Only
    teams that took a shot in the game are kept, as a dense index of games.
    """
    home = F.col("is_home")
    own = F.when(home, F.col("home_skaters")).otherwise(F.col("away_skaters"))
    other = F.when(home, F.col("away_skaters")).otherwise(F.col("home_skaters"))
    pp = S.situation(own, other) == "PP"
    stats, sides = ("goal", "xg", "sog"), {"h": home, "a": ~home}
    names = {"goal": ("pp_goals", "pk_goals_against"), "xg": ("pp_xg", "pk_xg_against"), "sog": ("pp_shots", "pk_shots_against")}
    games = regular(shots).groupBy("game_id", "season", "game_num").agg(
        *[_sum0(F.when(pp & flag, F.col(stat))).alias(f"{side}_{stat}") for side, flag in sides.items() for stat in stats],
        *[F.max(F.when(flag, F.col("team_id")).otherwise(F.col("def_team_id"))).alias(f"{side}_team") for side, flag in sides.items()],
        *[F.max(flag).alias(f"{side}_shot") for side, flag in sides.items()])

    def row(side: str, against: str) -> Column:
        return F.struct(
            F.col(f"{side}_team").alias("team_id"), *[F.col(f"{side}_{stat}").alias(names[stat][0]) for stat in stats],
            *[F.col(f"{against}_{stat}").alias(names[stat][1]) for stat in stats], F.col(f"{side}_shot").alias("took_a_shot"))

    rows = games.select("game_id", "season", "game_num", F.inline(F.array(row("h", "a"), row("a", "h"))))
    return rows.where("took_a_shot").drop("took_a_shot")


def first_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First non-null value of each column per group, in ``order``."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns
    ])

"""Joins between events, sides, prices and lookups.

No join carries a broadcast hint: AQE broadcasts a side once it has measured
it, and splits a skewed key otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.functions import scalars as S
from foretrace.functions.odds import fair_pair, mean_half_even
from foretrace.operators.history import first_per_group
from foretrace.sources.merge import newest, oldest


def home_away(rows: DataFrame, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Two team rows to one game row with ``home_*``, ``away_*`` and ``diff_*``.

    Inner semantics: a game that lacks one side is dropped. One conditional
    aggregate by game does what a self join would shuffle twice for. Rows meet
    before they are aggregated: sums by task would hold twice the columns and
    unite nothing, as the two teams' histories lie in different tasks.
    """
    def side(flag: str, value: str) -> str:
        return f"CASE WHEN is_home = {flag} THEN {value} END"

    flags = {"home": "true", "away": "false"}
    needed = [c for c in rows.columns if c in {"game_id", "is_home", *carry, *columns}]
    sides = rows.select(*needed).repartition("game_id").groupBy("game_id").agg(
        F.expr(f"count({side('true', '1')}) AS _h"), F.expr(f"count({side('false', '1')}) AS _a"),
        *[F.expr(f"max({side('true', c)}) AS {c}") for c in carry],
        *[F.expr(f"max({side(flag, c)}) AS {name}_{c}") for name, flag in flags.items() for c in columns])
    return sides.where("_h > 0 AND _a > 0").selectExpr(
        "game_id", *carry, *[f"{name}_{c}" for name in flags for c in columns],
        *[f"home_{c} - away_{c} AS diff_{c}" for c in columns])


def attach_sides(games: DataFrame, features: DataFrame, columns: Sequence[str], prefix: str = "",
                 diff: bool = True, sides: DataFrame | None = None) -> DataFrame:
    """Left-join per-(game, team) features to both sides of each game.

    The features are pivoted to one row per game first, so they are computed
    and shuffled once; the join then finds both inputs partitioned by game.
    ``sides`` tells the teams of a game where that is cheaper than ``games``.
    """
    teams = (games if sides is None else sides).select("game_id", "home_id", "away_id")
    keyed = features.select("game_id", "team_id", *columns).join(teams, "game_id")
    wide = keyed.groupBy("game_id").agg(*[
        F.expr(f"max(CASE WHEN team_id = {side}_id THEN {c} END) AS {side}_{prefix}{c}")
        for side in ("home", "away") for c in columns])
    return _with_diffs(games, games.join(wide, "game_id", "left"), columns, prefix, diff)


def attach_teams(games: DataFrame, features: DataFrame, columns: Sequence[str], prefix: str = "",
                 diff: bool = True) -> DataFrame:
    """Left-join a per-team snapshot to both sides of each game.

    The snapshot is read twice: pin it if it is expensive.
    """
    out = games
    for side in ("home", "away"):
        named = features.selectExpr(f"team_id AS {side}_id", *[f"{c} AS {side}_{prefix}{c}" for c in columns])
        out = out.join(named, f"{side}_id", "left")
    return _with_diffs(games, out, columns, prefix, diff)


def _with_diffs(games: DataFrame, out: DataFrame, columns: Sequence[str], prefix: str, diff: bool) -> DataFrame:
    new = [f"{s}_{prefix}{c}" for s in ("home", "away") for c in columns]
    diffs = [f"home_{prefix}{c} - away_{prefix}{c} AS diff_{prefix}{c}" for c in columns]
    return out.selectExpr(*games.columns, *new, *(diffs if diff else []))


def opponent_context(rows: DataFrame, matches: DataFrame, team_features: DataFrame,
                     own: Sequence[str], opponent: Sequence[str]) -> DataFrame:
    """Resolve each row's opponent, then attach own and opponent team features."""
    teams = matches.select("game_id", "home_id", "away_id")
    at_home = F.col("team_id") == F.col("home_id")
    out = rows.join(teams, "game_id", "left").select(
        *rows.columns, F.when(at_home, F.col("away_id")).otherwise(F.col("home_id")).alias("opp_id"),
        at_home.cast("double").alias("is_home"))
    if own:
        out = out.join(team_features.select("game_id", "team_id", *[F.col(c).alias(f"own_{c}") for c in own]),
                       ["game_id", "team_id"], "left")
    return out.join(
        team_features.select("game_id", F.col("team_id").alias("opp_id"), *[F.col(c).alias(f"opp_{c}") for c in opponent]),
        ["game_id", "opp_id"], "left")


def spine_enrich(spine: DataFrame, measured: DataFrame) -> DataFrame:
    """Measurements onto the full lineup; a missing count is zero, a rate null.

    ``measured`` may repeat a (game, player); the first by attempts is kept.
    The full name of a player, wherever he has one, replaces the short one.
    """
    known = measured.where(F.col("player_id") > 0)
    one = oldest(known.select("game_id", "player_id", "xg", "shot_attempts", F.col("sog").alias("sog_measured")),
                 ["game_id", "player_id"], ["shot_attempts", "xg", "sog_measured"])
    names = known.where(F.col("player_name").isNotNull()).groupBy("player_id").agg(
        F.min_by("player_name", F.struct("game_id", "player_name")).alias("_full"))
    joined = spine.join(one, ["game_id", "player_id"], "left").join(names, "player_id", "left")
    attempts = F.coalesce("shot_attempts", F.lit(0))
    xg = F.coalesce("xg", F.lit(0.0))
    return joined.select(
        *[c for c in spine.columns if c != "player_name"], F.coalesce("_full", "player_name").alias("player_name"),
        xg.alias("xg"), attempts.cast("bigint").alias("shot_attempts"),
        F.try_divide(xg, attempts).alias("xg_per_attempt"),
        F.col("shot_attempts").isNotNull().alias("matched"),
        F.coalesce(F.col("sog_measured") != F.col("sog"), F.lit(False)).alias("disagrees"))


def reconcile(enriched: DataFrame) -> DataFrame:
    """How well the two sources agree."""
    return enriched.agg(
        F.count("*").alias("n_rows"), F.sum(F.col("matched").cast("bigint")).alias("n_matched"),
        F.avg(F.col("matched").cast("double")).alias("matched_share"),
        F.sum((F.col("shot_attempts") == 0).cast("bigint")).alias("n_zero_attempts"),
        F.sum(F.col("disagrees").cast("bigint")).alias("n_disagree"))


def last_event_before(sides: DataFrame, day: Column) -> DataFrame:
    """Last event date of every team strictly before ``day``."""
    return sides.where(F.col("game_date") < day).groupBy("team_id").agg(F.max("game_date").alias("last_date"))


def last_meetings(slate: DataFrame, matches: DataFrame, day: Column, n: int = 3) -> DataFrame:
    """Home win rate of each slate pair's last ``n`` meetings before ``day``.

    The ``n`` newest are taken first and unknown results dropped afterwards.
    """
    pair = S.pair_key(F.col("home_id"), F.col("away_id")).alias("pair")
    wanted = slate.select("game_id", pair)
    past = matches.where(F.col("game_date") < day).select(pair, "game_date", F.col("game_id").alias("past_id"), "home_win")
    past = past.join(wanted.select("pair").distinct(), "pair", "left_semi")
    recent = first_per_group(past, ["pair"], [F.desc("game_date"), F.desc("past_id")], n)
    rate = recent.groupBy("pair").agg(F.avg("home_win").alias(f"h2h_home_win_rate_l{n}"))
    return wanted.join(rate, "pair", "left").drop("pair")


def consensus(quotes: DataFrame) -> DataFrame:
    """Mean fair price and mean total across the books of a game."""
    home, away = fair_pair(F.col("home_ml"), F.col("away_ml"), digits=4)
    return quotes.where(F.col("home_ml").isNotNull() & F.col("away_ml").isNotNull()).groupBy("game_id").agg(
        mean_half_even(home, 4).alias("prob_home_win"), mean_half_even(away, 4).alias("prob_away_win"),
        F.bround(F.avg("total"), 2).alias("total"), F.count("*").alias("n_books"))


def price_index(prices: DataFrame) -> DataFrame:
    """One price per (date, home, away); the last game of a double meeting wins."""
    keyed = prices.select("game_date", "home_id", "away_id", "game_id", "market_prob_home", "market_n_books")
    return newest(keyed, ["game_date", "home_id", "away_id"], ["game_id"]).drop("game_id")


def attach_prices(preds: DataFrame, index: DataFrame) -> DataFrame:
    """Market price of each prediction by date and teams, null where there is none."""
    keep = [c for c in preds.columns if c not in ("market_prob_home", "market_n_books")]
    return preds.select(*keep).join(index, ["game_date", "home_id", "away_id"], "left")


def fill_closing(log: DataFrame, index: DataFrame) -> DataFrame:
    """Fill the missing closing price of every played row, and how many books made it."""
    if "closing_n_books" not in log.columns:
        log = log.withColumn("closing_n_books", F.lit(None).cast("bigint"))
    open_row = F.col("closing_prob_home").isNull() & F.col("actual_home_win").isNotNull()
    fresh = index.select("game_date", "home_id", "away_id", F.col("market_prob_home").alias("_close"), F.col("market_n_books").alias("_books"))
    joined = log.join(fresh, ["game_date", "home_id", "away_id"], "left")
    filled = {"closing_prob_home": "_close", "closing_n_books": "_books"}
    fill = open_row & F.col("_close").isNotNull()
    return joined.select(*[F.when(fill, F.col(filled[c])).otherwise(F.col(c)).alias(c) if c in filled else F.col(c) for c in log.columns])


def match_odds(odds: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) odds rows by teams and date; one game per row."""
    one = oldest(matches.select("game_date", "home_id", "away_id", "game_id"),
                 ["game_date", "home_id", "away_id"], ["game_id"])
    on = ["game_date", "home_id", "away_id"]
    return odds.join(one, on, "inner"), odds.join(one, on, "left_anti")


def without(rows: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop the listed keys (scratched players, ids already seen)."""
    return rows.join(excluded.select(*keys), list(keys), "left_anti")


def roster_identity(snapshot: DataFrame, roster: DataFrame, opponents: DataFrame, ice_time: DataFrame | None = None) -> DataFrame:
    """Identity from today's roster, opponent features, optional ice time."""
    stale = [c for c in ("player_name", "team_id", "position") if c in snapshot.columns]
    out = snapshot.drop(*stale).join(roster, "player_id").join(opponents, "opp_id", "left")
    return out if ice_time is None else out.join(ice_time, "player_id", "left")

"""Sequential pairwise ratings.

A rating depends on every earlier game of the two sides, so within one league
the games form a chain: no window or aggregate expresses it. Leagues are
independent and run in parallel; inside a league the rows stream through one
task in Arrow batches, already sorted by the JVM (which spills), and the task
holds the ratings of the league's teams and nothing else. A league is never
collected. Parameter sets share one pass: their ratings sit side by side in an
array, so a grid search does not multiply the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.session import ship_by_value

ORDER = ["season", "game_num", "game_id"]
_COLUMNS = ["league", "season", "game_id", "home_id", "away_id", "home_win", "went_to_ot"]


@dataclass(frozen=True)
class EloParams:
    """The published defaults."""

    k_factor: float = 20.0
    home_advantage: float = 50.0
    season_regress: float = 0.33
    ot_win_value: float = 0.6
    initial: float = 1500.0


# The search grid.
GRID = {
    "k_factor": [15.0, 20.0, 25.0, 30.0],
    "home_advantage": [30.0, 50.0, 70.0],
    "season_regress": [0.25, 0.33, 0.5],
    "ot_win_value": [0.5, 0.6, 0.75, 1.0],
}


def param_grid(grid: dict[str, Sequence[float]] | None = None) -> list[EloParams]:
    grid = grid or GRID
    return [EloParams(**dict(zip(grid, values))) for values in product(*grid.values())]


def _by_league(games: DataFrame) -> DataFrame:
    """Rows of a league together and in order, without collecting them."""
    return games.select(*_COLUMNS, *[c for c in ORDER if c not in _COLUMNS]).repartition("league").sortWithinPartitions(
        "league", *ORDER)


class _League:
    """Ratings of one league for one or more parameter sets: plain numbers for one set, arrays for several."""

    def __init__(self, params: Sequence[EloParams]):
        self.k, self.home, self.regress, self.ot, self.start = (
            float(getattr(params[0], n)) if len(params) == 1 else np.array([getattr(p, n) for p in params])
            for n in ("k_factor", "home_advantage", "season_regress", "ot_win_value", "initial"))
        self.ratings: dict = {}
        self.season = None

    def enter(self, season) -> None:
        if self.season is not None and season != self.season:
            for team, rating in self.ratings.items():
                self.ratings[team] = rating * (1 - self.regress) + self.start * self.regress
        self.season = season

    def pair(self, home, away):
        return self.ratings.setdefault(home, self.start), self.ratings.setdefault(away, self.start)

    def play(self, home, away, win, overtime):
        """Update both ratings; returns the expected home score."""
        h, a = self.ratings[home], self.ratings[away]
        expected = 1.0 / (1.0 + 10.0 ** ((a - h - self.home) / 400.0))
        if overtime != overtime or not overtime:
            actual = win
        else:
            actual = self.ot if win == 1.0 else 1.0 - self.ot
        step = self.k * (actual - expected)
        self.ratings[home], self.ratings[away] = h + step, a - step
        return expected


def _replay(params: EloParams):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        league, name = _League([params]), None

        def finals():
            teams = list(league.ratings)
            return pd.DataFrame({
                "kind": "final", "league": name, "season": league.season, "game_id": None, "team_id": teams,
                "home_elo": [league.ratings[t] for t in teams], "away_elo": None})

        for batch in batches:
            out, done = [], []
            for lg, season, game, home, away, win, overtime in zip(*(batch[c].tolist() for c in _COLUMNS)):
                if lg != name:
                    if name is not None:
                        done.append(finals())
                    league, name = _League([params]), lg
                league.enter(season)
                h, a = league.pair(home, away)
                out.append((lg, season, game, h, a))
                if win == win and win is not None:
                    league.play(home, away, win, overtime)
            rows = pd.DataFrame(out, columns=["league", "season", "game_id", "home_elo", "away_elo"])
            yield rows.assign(kind="game", team_id=None)
            yield from done
        if name is not None:
            yield finals()

    return run


def elo_pass(games: DataFrame, params: EloParams = EloParams()) -> DataFrame:
    """One pass over every league: pre-game rows (``kind = 'game'``) and final ratings (``'final'``).

    Pin the result before using both kinds, or the chain is replayed.
    """
    types = dict(games.dtypes)
    schema = (f"kind string, league {types['league']}, season {types['season']}, game_id {types['game_id']}, "
              f"team_id {types['home_id']}, home_elo double, away_elo double")
    return _by_league(games).mapInPandas(_replay(params), schema)


def pregame(replayed: DataFrame) -> DataFrame:
    """(game_id, home_elo, away_elo, diff_elo) entering each game."""
    return replayed.where("kind = 'game'").select(
        "game_id", "home_elo", "away_elo", (F.col("home_elo") - F.col("away_elo")).alias("diff_elo"))


def finals(replayed: DataFrame) -> DataFrame:
    """(league, team_id, elo, last_season) after the last game."""
    return replayed.where("kind = 'final'").select(
        "league", "team_id", F.col("home_elo").alias("elo"), F.col("season").alias("last_season"))


def entering(final: DataFrame, season: Column, params: EloParams = EloParams()) -> DataFrame:
    """Ratings carried into ``season``: regressed once when it is a new one."""
    same = F.col("last_season") == season
    moved = F.col("elo") * (1 - params.season_regress) + params.initial * params.season_regress
    return final.withColumn("elo", F.when(same, F.col("elo")).otherwise(moved))


def _grid_replay(params: Sequence[EloParams]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(params)
        league, name = _League(params), None
        squares, n = np.zeros(size), 0
        for batch in batches:
            for lg, season, _, home, away, win, overtime in zip(*(batch[c].tolist() for c in _COLUMNS)):
                if lg != name:
                    league, name = _League(params), lg
                league.enter(season)
                league.pair(home, away)
                if win == win and win is not None:
                    squares += (league.play(home, away, win, overtime) - win) ** 2
                    n += 1
        yield pd.DataFrame({"set": range(size), "squares": squares, "n": n})

    return run


def elo_grid(games: DataFrame, grid: Sequence[EloParams] | None = None) -> DataFrame:
    """Brier of the rating's win probability for every parameter set.

    Each task sums the squared errors of its leagues and emits one row per set;
    an aggregate adds the tasks up.
    """
    params = list(grid or param_grid())
    partial = _by_league(games).mapInPandas(_grid_replay(params), "set int, squares double, n bigint")
    total = partial.groupBy("set").agg(F.sum("squares").alias("squares"), F.sum("n").alias("n"))
    names = list(GRID)
    table = games.sparkSession.createDataFrame(
        [(i, *[float(asdict(p)[c]) for c in names]) for i, p in enumerate(params)],
        "set int, " + ", ".join(f"{c} double" for c in names))
    return total.join(table, "set").select(*names, "n", (F.col("squares") / F.col("n")).alias("brier"))


def best_params(scores: DataFrame) -> EloParams:
    """The set with the lowest Brier; one row reaches the driver."""
    names = list(GRID)
    row = scores.orderBy("brier", *names).limit(1).first()
    return EloParams(**{c: row[c] for c in names})


def save_params(spark, params: EloParams, path: str) -> None:
    spark.createDataFrame([asdict(params)]).coalesce(1).write.mode("overwrite").json(path)


def load_params(spark, path: str) -> EloParams:
    """Saved parameters; what is absent or unreadable keeps its default."""
    names = [n for n in asdict(EloParams())]
    try:
        row = spark.read.schema(", ".join(f"{n} double" for n in names)).json(path).first()
    except Exception:  # noqa: BLE001 - a missing or broken file means defaults
        row = None
    known = {n: row[n] for n in names if row is not None and row[n] is not None}
    return EloParams(**known)


ship_by_value(__name__)

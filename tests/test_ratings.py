import math

import pytest
from pyspark.sql import functions as F

from foretrace.operators import ratings as R

SCHEMA = "game_id bigint, league bigint, season bigint, game_num bigint, home_id bigint, away_id bigint, home_win double, went_to_ot bigint"
GAMES = [
    (1, 0, 2024, 1, 10, 20, 1.0, 0), (2, 0, 2024, 2, 20, 30, 0.0, 1), (3, 0, 2024, 3, 10, 30, None, 0),
    (4, 0, 2025, 1, 30, 10, 1.0, 0), (5, 1, 2024, 1, 110, 120, 0.0, 0), (6, 1, 2025, 9, 120, 110, 1.0, 1),
]


def brute(games, p):
    """The definition, game by game, as reference values for the tests."""
    out, ratings, last, squares = {}, {}, {}, []
    for g, lg, season, num, h, a, win, ot in sorted(games, key=lambda r: (r[1], r[2], r[3], r[0])):
        mine = ratings.setdefault(lg, {})
        if lg in last and last[lg] != season:
            for t in mine:
                mine[t] = mine[t] * (1 - p.season_regress) + p.initial * p.season_regress
        last[lg] = season
        rh, ra = mine.setdefault(h, p.initial), mine.setdefault(a, p.initial)
        out[g] = (rh, ra)
        if win is not None:
            e = 1 / (1 + 10 ** ((ra - rh - p.home_advantage) / 400))
            s = win if not ot else (p.ot_win_value if win == 1 else 1 - p.ot_win_value)
            mine[h], mine[a] = rh + p.k_factor * (s - e), ra - p.k_factor * (s - e)
            squares.append((e - win) ** 2)
    return out, {t: x for lg in ratings.values() for t, x in lg.items()}, sum(squares) / len(squares)


@pytest.fixture(scope="module")
def games(spark):
    return spark.createDataFrame(GAMES, SCHEMA)


def test_chain_equals_definition(games):
    p = R.EloParams()
    replayed = R.elo_pass(games, p)
    pre, final, _ = brute(GAMES, p)
    got = {r.game_id: (r.home_elo, r.away_elo) for r in R.pregame(replayed).collect()}
    assert got.keys() == pre.keys()
    for g in pre:
        assert got[g] == pytest.approx(pre[g], abs=1e-9)
    ends = {r.team_id: r.elo for r in R.finals(replayed).collect()}
    assert ends == pytest.approx(final, abs=1e-9)


def test_zero_sum_within_a_season(games):
    total = R.finals(R.elo_pass(games.where("season = 2024"))).groupBy("league").agg(F.sum("elo").alias("s"), F.count("*").alias("n"))
    for r in total.collect():
        assert math.isclose(r.s, 1500 * r.n, abs_tol=1e-9)


def test_even_overtime_credit_ignores_the_winner(spark):
    p = R.EloParams(ot_win_value=0.5)
    for win in (0.0, 1.0):
        df = spark.createDataFrame([(1, 0, 2024, 1, 1, 2, win, 1)], SCHEMA)
        ends = {r.team_id: r.elo for r in R.finals(R.elo_pass(df, p)).collect()}
        assert ends[1] < 1500 < ends[2]


def test_unknown_result_moves_nothing(spark):
    df = spark.createDataFrame([(1, 0, 2024, 1, 1, 2, None, 0)], SCHEMA)
    assert all(r.elo == 1500 for r in R.finals(R.elo_pass(df)).collect())


def test_entering_regresses_once(spark):
    final = spark.createDataFrame([(1, 1600.0, 2024), (2, 1600.0, 2025)], "team_id int, elo double, last_season int")
    got = {r.team_id: r.elo for r in R.entering(final, F.lit(2025)).collect()}
    assert got == pytest.approx({1: 1600 * 0.67 + 1500 * 0.33, 2: 1600.0})


def test_grid_equals_definition_and_params_round_trip(spark, games, tmp_path):
    grid = R.param_grid()
    assert len(grid) == 144
    rows = R.elo_grid(games, grid).collect()
    assert len(rows) == 144
    for r in rows[::17]:
        p = R.EloParams(r.k_factor, r.home_advantage, r.season_regress, r.ot_win_value)
        assert r.n == 5 and r.brier == pytest.approx(brute(GAMES, p)[2], abs=1e-12)
    best = R.best_params(R.elo_grid(games, grid))
    R.save_params(spark, best, str(tmp_path / "p"))
    assert R.load_params(spark, str(tmp_path / "p")) == best
    assert R.load_params(spark, str(tmp_path / "absent")) == R.EloParams()

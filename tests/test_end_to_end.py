"""End-to-end plans on the smallest data folder."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from foretrace.catalog.documents import box_documents
from foretrace.catalog.scalars import division_table
from foretrace.operators import facts as X
from foretrace.operators.scoring import score_rows
from foretrace.plans import reports
from foretrace.plans.matrix import feature_matrix, team_columns
from foretrace.plans.refresh import lineup_spine, refresh
from foretrace.plans.slate import slate_matrix
from foretrace.session import pin
from foretrace.sources.views import Views


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SMALL)


def test_slate_equals_the_training_row(spark, views):
    """The serving matrix of the next game is that game's training row."""
    regular = F.col("game_type") == "R"
    shots, matches, sides = (pin(df.where(regular)) for df in (views.shots, views.matches, views.sides))
    groups = division_table(views)
    trained = pin(feature_matrix(shots, matches, sides, groups, row_bound=views.match_bound, shot_bound=views.shot_bound))
    # A late game that is alone on its day, so that nothing lies between the cut-off and it.
    alone = matches.groupBy("game_date").agg(F.count("*").alias("n"), F.first("game_id").alias("game_id")).where("n = 1")
    game = trained.where("season = 2000").join(alone.select("game_id"), "game_id").orderBy(F.desc("game_date")).first()
    slate = matches.where(F.col("game_id") == game.game_id).select("game_id", "season", "home_id", "away_id")
    opener = matches.where("season = 2000").agg(F.min("game_date")).first()[0]
    served = slate_matrix(slate, shots, matches, sides, 2000, F.lit(game.game_date), F.lit(opener),
                          row_bound=views.match_bound, shot_bound=views.shot_bound, groups=groups).first()
    names = [f"{s}_{c}" for s in ("home", "away", "diff") for c in team_columns()]
    names += ["home_rest_days", "away_rest_days", "home_back_to_back", "rest_advantage", "season_day", "h2h_home_win_rate_l3",
              "same_division", "home_elo", "away_elo", "diff_elo", "home_won_vs_strong_l20", "diff_st_pp_xg_l10"]
    for c in names:
        a, b = game[c], served[c]
        assert (a is None) == (b is None), c
        assert a is None or a == pytest.approx(b, abs=1e-9), c
    assert game.home_games_played > 0 and game.home_won_l5 is not None


def test_refresh_writes_every_table_in_order(spark, views, tmp_path):
    results = views.matches.where("game_state = 'OFF' AND home_win IS NOT NULL").select("game_id", "season", "home_win")
    paths = refresh(spark, str(tmp_path), views.shots, views.matches, views.sides, results, division_table(views), views.preds)
    read = {n: spark.read.parquet(p) for n, p in paths.items()}
    assert read["team_games"].count() > 0 and read["matrix"].count() > 0 and read["ratings"].count() == 16
    official = {r.game_id: r.home_win for r in results.collect()}
    for r in read["matrix"].select("game_id", "target").collect():
        assert r.game_id not in official or r.target == official[r.game_id]
    assert read["log"].where("actual_home_win IS NOT NULL").count() == views.preds.where("actual_home_win IS NOT NULL").count()


def test_lineup_spine_keeps_every_dressed_player(spark, views):
    docs = box_documents(views)
    measured = X.player_games(views.shots).select(
        F.lit("none").alias("game_id"), "player_id", "xg", "shot_attempts", "sog", F.lit("Full Name").alias("player_name"))
    spine = lineup_spine(docs, measured)
    assert spine.count() == 2 * views.shots.count()
    assert spine.where("matched").count() == 0 and spine.where("xg_per_attempt IS NOT NULL").count() == 0


def test_reports(views):
    scored = score_rows(views.preds)
    history = reports.history_report(scored, ["game_date", "game_id"])
    assert history["summary"].count() == 2 and history["recent"].first().n == 25
    night = reports.day_report(scored)
    assert night["games"].count() == night["summary"].first().n
    assert reports.edge_report(views.preds, scored)["edges"].where("edge < 0.03").count() == 0

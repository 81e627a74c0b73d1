import json

import pytest
from pyspark.sql import functions as F

from foretrace.operators import joins as J
from foretrace.session import explained
from foretrace.sources import documents as D
from foretrace.sources import scans as A

BOX = {
    "id": 2025020001, "season": 20252026, "gameDate": "2025-10-08", "gameType": "2", "gameState": "OFF",
    "homeTeam": {"abbrev": "AAA", "score": 4}, "awayTeam": {"abbrev": "BBB", "score": 3},
    "periodDescriptor": {"periodType": "SO"},
    "playerByGameStats": {
        "homeTeam": {"forwards": [{"playerId": 1, "name": {"default": "A. One"}, "position": "C", "toi": "12:30", "sog": 3}],
                     "defense": [{"playerId": 2, "name": "B Two", "position": "D", "toi": None}],
                     "goalies": [{"playerId": 9, "name": {"default": "G"}, "starter": True, "toi": "60:00", "saves": 20, "shotsAgainst": 23}]},
        "awayTeam": {"forwards": [], "goalies": [{"playerId": 8, "name": {"default": "H"}, "toi": "00:00"}]},
    },
}


@pytest.fixture(scope="module")
def docs(spark):
    live = {**BOX, "id": 2025020002, "gameState": "LIVE"}
    level = {**BOX, "id": 2025020003, "homeTeam": {"abbrev": "AAA", "score": 3}}
    texts = [json.dumps(d) for d in (BOX, live, level)] + ['{"id": 20250', None]
    return spark.createDataFrame([(t,) for t in texts], "doc string")


def test_skaters_keep_zero_lines(docs):
    rows = {r.player_id: r for r in D.skaters(docs).where("game_id = '2025020001'").collect()}
    assert set(rows) == {1, 2}
    assert rows[1].player_name == "A. One" and rows[1].toi_seconds == 750 and rows[1].sog == 3 and rows[1].hits == 0
    assert rows[2].player_name == "B Two" and rows[2].toi_seconds == 0 and rows[2].sog == 0
    assert rows[1].season == "2025-2026" and rows[1].game_num == 20001


def test_goalies_and_starter_flag(docs):
    rows = {r.player_id: r for r in D.goalies(docs).where("game_id = '2025020001'").collect()}
    assert rows[9].starter and not rows[8].starter and rows[8].saves == 0 and rows[8].team == "BBB"


def test_results_only_when_final_and_decided(docs):
    rows = D.game_results(docs).collect()
    assert [r.game_id for r in rows] == ["2025020001"]
    assert rows[0].home_win and rows[0].went_to_ot and rows[0].went_to_so


def test_scan_status(spark, docs):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "game_id int")
    landed = spark.createDataFrame([(1, json.dumps(BOX)), (2, '{"id": 1')], "game_id int, doc string")
    assert {r.status: r.n for r in D.scan_status(asked, landed, D.BOX_SCHEMA).collect()} == {"parsed": 1, "corrupt": 1, "missing": 1}


def test_statuses_are_never_broadcast(spark, docs):
    asked, landed = spark.range(3).select(F.col("id").alias("game_id")), spark.range(3).select(F.col("id").alias("game_id"), F.lit("{}").alias("doc"))
    assert "Broadcast" not in explained(D.scan_status(asked, landed, D.BOX_SCHEMA))


def test_landed_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(BOX, indent=2))
    (tmp_path / "b.json").write_text('{"id": ')
    rows = A.scan_documents(spark, [str(tmp_path / "*.json")], D.BOX_SCHEMA).select("id", "_corrupt", "file").collect()
    assert sorted((r.id or 0) for r in rows) == [0, 2025020001] and sum(r._corrupt is not None for r in rows) == 1


def test_csv_whitelist_nan_and_year(spark, tmp_path):
    (tmp_path / "shots_2024.csv").write_text("game_id,xGoal,goal,extra\n1,0.5,1,x\n2,NaN,0,y\n")
    (tmp_path / "shots_2025.csv").write_text("game_id,xGoal,goal,extra\n3,0.25,0,z\n")
    rows = A.scan_csv(spark, [str(tmp_path / "shots_*.csv")], "game_id bigint, xGoal double, goal int, extra string", ["game_id", "xGoal"])
    assert {(r.game_id, r.xGoal, r.source_year) for r in rows.collect()} == {(1, 0.5, 2024), (2, None, 2024), (3, 0.25, 2025)}


def test_partition_overwrite_keeps_other_seasons(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2024), (2, 2025)], "x int, season int")
    A.save_table(df, path)
    A.save_table(df.where("season = 2025").selectExpr("x + 10 AS x", "season"), path)
    assert sorted((r.x, r.season) for r in spark.read.parquet(path).collect()) == [(1, 2024), (12, 2025)]


def test_spine_zeroes_counts_and_keeps_rates_null(spark):
    spine = spark.createDataFrame([(1, 7, "P. S", 2), (1, 8, "Q. T", 0)], "game_id int, player_id int, player_name string, sog int")
    measured = spark.createDataFrame([(1, 7, "Paul S", 0.4, 2, 3), (1, 7, "Paul S", 0.4, 2, 3), (1, 0, "x", 1.0, 1, 1)],
                                     "game_id int, player_id int, player_name string, xg double, shot_attempts bigint, sog int")
    rows = {r.player_id: r for r in J.spine_enrich(spine, measured).collect()}
    assert rows[7].player_name == "Paul S" and rows[7].xg_per_attempt == 0.2 and rows[7].disagrees
    assert rows[8].xg == 0.0 and rows[8].shot_attempts == 0 and rows[8].xg_per_attempt is None and not rows[8].matched


def test_meetings_take_three_before_dropping_unknown(spark):
    from conftest import day
    from pyspark.sql import functions as F

    past = spark.createDataFrame(
        [(1, 1, 2, day("2025-01-01"), 1.0), (2, 2, 1, day("2025-01-02"), None), (3, 1, 2, day("2025-01-03"), 0.0),
         (4, 1, 2, day("2025-01-04"), 0.0), (5, 1, 2, day("2025-02-01"), 1.0)],
        "game_id int, home_id int, away_id int, game_date date, home_win double")
    slate = spark.createDataFrame([(9, 2, 1), (10, 5, 6)], "game_id int, home_id int, away_id int")
    got = {r.game_id: r.h2h_home_win_rate_l3 for r in J.last_meetings(slate, past, F.lit("2025-01-20").cast("date")).collect()}
    assert got == {9: 0.0, 10: None}


def test_both_sides_of_a_game_meet_before_they_are_aggregated(spark):
    rows = spark.createDataFrame([(1, True, 2.0), (1, False, 0.5), (2, True, 1.0), (None, True, 3.0), (None, False, 1.0)], "game_id int, is_home boolean, x double")
    out = J.home_away(rows, ["x"])
    assert {(r.game_id, r.home_x, r.away_x, r.diff_x) for r in out.collect()} == {(1, 2.0, 0.5, 1.5), (None, 3.0, 1.0, 2.0)}
    plan = J.home_away(rows, ["x"])._jdf.queryExecution().executedPlan().toString()
    # Printed from the last step down: both steps of the aggregate stand above the exchange.
    assert plan.count("Exchange") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange")


def test_only_named_fields_become_columns_and_the_same_texts_are_unreadable(spark):
    """A field that nobody reads is not copied, but a wrong type in it still tells an unreadable text."""
    good = '{"id": 1, "homeTeam": {"score": 2}, "summary": {"teamGameStats": [{"category": "sog", "homeValue": 1.0}]}}'
    docs = spark.createDataFrame([(good,), ('{"id": 2, "summary": {"teamGameStats": 5}}',), ('{"id": 3',), (None,)], "doc string")
    some = D.readable(docs, D.LANDING_SCHEMA, ["id", "homeTeam"])
    assert some.columns == ["id", "homeTeam"]
    assert [r["id"] for r in some.collect()] == [r["id"] for r in D.readable(docs, D.LANDING_SCHEMA).collect()] == [1]
    assert [(r["game_id"], r["home_score"]) for r in D.landing_results(docs).collect()] == [("1", 2)]

from pyspark.sql import functions as F

from foretrace.operators import ratings as R
from foretrace.operators.history import Rolling, games_before, with_history
from foretrace.streaming import incremental as I
from foretrace.streaming import log as L
from foretrace.streaming import replay as P
from foretrace.streaming import stateful as S


def test_log_stores_a_repeated_batch_once(spark, tmp_path):
    log = L.PredictionLog(spark, str(tmp_path / "log"))
    schema = "game_id int, model_name string, predicted_at string, prob double"
    first = spark.createDataFrame([(1, "m", "2025-01-01", 0.5), (1, "m", "2025-01-02", 0.6), (2, "m", "2025-01-01", 0.4)], schema)
    second = spark.createDataFrame([(1, "m", "2025-01-03", 0.7)], schema)
    log.append(first, 0)
    log.append(second, 1)
    log.append(second, 1)
    want = [(1, 0.7), (2, 0.4)]
    assert sorted((r.game_id, r.prob) for r in log.latest().collect()) == want
    log.compact(str(tmp_path / "small"))
    assert sorted((r.game_id, r.prob) for r in L.PredictionLog(spark, str(tmp_path / "small")).latest().collect()) == want


def ended(rows, key):
    return rows.limit(1).withColumns({key: F.lit(-1).cast("bigint"), "event_time": F.lit("2100-01-01").cast("timestamp")})


def test_rolling_state_equals_the_windows_whatever_the_order_within_the_delay(spark, season_rows, monkeypatch):
    """Rows come up to 8 games late, in many small micro-batches."""
    monkeypatch.setattr(P, "FILES_PER_TRIGGER", 1)
    monkeypatch.setattr(P, "ROWS_PER_FILE", 25)
    rows = season_rows.select("game_id", "team_id", "season", "game_num", "x", S.sequence_time(F.col("season"), F.col("game_num")).alias("event_time"))
    rows = rows.withColumn("arrival", F.col("season") * 100 + ((F.col("game_num") + F.pmod(F.xxhash64("game_id"), F.lit(9))) / 11).cast("int"))
    order = ["season", "game_num", "game_id"]
    build = lambda s: S.rolling_stream(s, "team_id", ["game_id", "team_id"], order, "x", [5], "season", delay="25 seconds")
    got = P.replayed(rows, "arrival", build, "t", ended(rows, "team_id")).collect()
    want = with_history(rows, ["team_id", "season"], ["game_num", "game_id"], [Rolling("x_l5", "x", 5), games_before()]).collect()
    key = lambda found: sorted((r.game_id, None if r.x_l5 is None else round(r.x_l5, 9), r.games_played) for r in found)
    assert key(got) == key(want) and len(got) == 100


def test_nothing_leaves_before_the_watermark(spark, season_rows):
    rows = season_rows.select("game_id", "team_id", "season", "game_num", "x", S.sequence_time(F.col("season"), F.col("game_num")).alias("event_time"))
    rows = rows.unionByName(rows.limit(1).withColumn("event_time", F.lit(None).cast("timestamp")))
    build = lambda s: S.rolling_stream(s, "team_id", ["game_id", "team_id", "game_num", "season"], ["game_id"], "x", [5], delay="5 seconds")
    got = P.replayed(rows, "season", build, "w").collect()
    assert {r.game_num for r in got if r.season == 2025} == set(range(1, 21)) and len([r for r in got if r.season == 2024]) == 50


def test_rating_state_equals_the_chain(spark):
    from test_ratings import GAMES, SCHEMA

    games = spark.createDataFrame(GAMES, SCHEMA).withColumn("event_time", S.sequence_time(F.col("season"), F.col("game_num")))
    stream = P.replayed(games, "season", lambda s: S.elo_stream(s, delay="30000 seconds"), "e", ended(games, "league").withColumn("home_id", F.lit(-1).cast("bigint")))
    got = {r.game_id: round(r.home_elo, 9) for r in stream.collect()}
    want = {r.game_id: round(r.home_elo, 9) for r in R.pregame(R.elo_pass(games)).collect()}
    assert got == want


def test_late_predictions_are_dropped(spark):
    rows = spark.createDataFrame([(1, "m", 5), (1, "m", 10), (2, "m", 99)], "game_id int, model_name string, predicted_at int")
    schedule = spark.createDataFrame([(1, 10)], "game_id int, start_time int")
    assert sorted((r.game_id, r.predicted_at) for r in L.before_start(rows, schedule).collect()) == [(1, 5), (2, 99)]


def test_rolling_batches_cross_boundaries_split_and_repeat(spark, season_rows, tmp_path):
    rows = season_rows.select("game_id", "team_id", "season", "game_num", "x")
    order = ["season", "game_num", "game_id"]
    features = [Rolling("x_l5", "x", 5), Rolling("x_l20", "x", 20)]
    table = I.RollingBatches(spark, str(tmp_path / "b"), ["team_id"], order, features, split_rows=20, chunk_rows=8)
    parts = [rows.where("season = 2024 AND game_num <= 3"), rows.where("season = 2024 AND game_num > 3"), rows.where("season = 2025")]
    for i in (0, 1, 1, 2):
        table.append(parts[i], i)
    want = with_history(rows, ["team_id"], order, features)
    key = lambda df: {r.game_id: tuple(None if v is None else round(v, 9) for v in (r.x_l5, r.x_l20)) for r in df.collect()}
    assert key(table.rows()) == key(want)


def test_state_has_few_partitions(spark, season_rows, monkeypatch, tmp_path):
    monkeypatch.setattr(P, "state_tasks", lambda _: 3)
    monkeypatch.setattr(P, "fresh_path", lambda _, label: str(tmp_path / label))
    rows = season_rows.where("season = 2025").select("game_id", "team_id", "season", "game_num", "x", S.sequence_time(F.col("season"), F.col("game_num")).alias("event_time"))
    order, configured = ["season", "game_num", "game_id"], spark.conf.get(P.SHUFFLE)
    P.replayed(rows, "season", lambda s: S.rolling_stream(s, "team_id", ["game_id"], order, "x", [5], "season"), "t")
    assert len([f for f in (tmp_path / "t/progress/state/0").iterdir() if f.name.isdigit()]) == 3
    assert spark.conf.get(P.SHUFFLE) == configured


def test_an_entity_lies_in_one_file_of_a_long_landing(spark, season_rows, monkeypatch, tmp_path):
    monkeypatch.setattr(P, "fresh_path", lambda _, label: str(tmp_path / label))
    monkeypatch.setattr(P, "FILES_PER_TRIGGER", 1)
    monkeypatch.setattr(P, "ROWS_PER_FILE", 30)
    rows = season_rows.repartition(4)
    P.replay(rows, "season", lambda stream: None, None, "team_id")
    landed = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "landed")).withColumn("file", F.input_file_name())
    files = landed.groupBy("season", "team_id").agg(F.countDistinct("file").alias("files"))
    assert landed.count() == rows.count() and files.where("files > 1").count() == 0

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretrace.operators import models as M
from foretrace.operators import trials as T
from foretrace.plans.projections import goalie_projections, top_projections
from foretrace.plans.slate import mark_started, publish_guard
from foretrace.session import explained

COLUMNS = ["a", "b", "empty"]


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        a, b = rng.normal(), rng.normal()
        y = float(rng.random() < 1 / (1 + np.exp(-2 * a)))
        rows.append((i, 2020 + i // 300, i, float(a) if i % 10 else None, float(b), y))
    df = spark.createDataFrame(rows, "game_id bigint, season int, game_num int, a double, b double, target double")
    return df.withColumn("empty", F.lit(None).cast("double")).cache()


def test_walk_forward_beats_the_base_rate(matrix):
    out = M.run_walk_forward(matrix, COLUMNS, "logistic")
    assert out.select("season").distinct().count() == 2 and out.count() == 600
    rate = matrix.agg(F.avg("target")).first()[0]
    assert M.brier(out) < rate * (1 - rate) - 0.02


def test_fold_assignment_never_trains_on_the_future(matrix):
    rows = M.walk_forward(matrix)
    assert rows.where("role = 'train' AND season >= test_season").count() == 0
    assert {(r.fold, r.role): r.n for r in rows.groupBy("fold", "role").agg(F.count("*").alias("n")).collect()} == {
        (1, "train"): 300, (1, "test"): 300, (2, "train"): 600, (2, "test"): 300}


def test_chunks_are_contiguous_and_equal_when_split(matrix):
    order = ["season", "game_num"]
    plain = {r.game_id: r.chunk for r in M.oof_chunks(matrix, order).collect()}
    assert [plain[i] for i in (0, 299, 300, 599, 600, 899)] == [0, 0, 1, 1, 2, 2]
    older, newest = M.split_newest(matrix, order)
    assert older.count() == 765 and newest.agg(F.min("game_id")).first()[0] == 765


def test_wide_rows_are_cut_where_they_are(spark, matrix):
    spread = spark.createDataFrame(matrix.repartition(6).rdd, matrix.schema).repartition(6)
    for part in (*M.split_newest(spread, ["season", "game_num"]), M.oof_chunks(spread, ["season", "game_num"])):
        assert part.rdd.getNumPartitions() == 6 and "Window" not in explained(part)


def test_cuts_between_rows_of_one_key_keep_their_sizes(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([None, 1, 1, 1, 1, 2, 3, 3, 3])], "k int, i int")
    chunks = M.oof_chunks(rows, ["k"])
    assert sorted(map(tuple, chunks.groupBy("k", "chunk").count().collect()), key=str) == sorted(
        [(None, 0, 1), (1, 0, 2), (1, 1, 2), (2, 1, 1), (3, 2, 3)], key=str)
    same = M.oof_chunks(rows.select(F.lit(1).alias("k")), ["k"], 4)
    assert {r.chunk: r["count"] for r in same.groupBy("chunk").count().collect()} == {0: 2, 1: 2, 2: 2, 3: 3}
    older, newest = M.split_newest(rows, ["k"], 0.2)
    assert (older.count(), newest.count()) == (7, 2)
    assert M.oof_chunks(rows.limit(0), ["k"]).count() == 0


def test_fits_write_no_copy_of_the_matrix(matrix, monkeypatch):
    for module in (M, T):
        for name in ("pin", "stored"):
            real = getattr(module, name, None)
            if real is not None:
                def narrow(df, *label, real=real):
                    assert not {"a", "b"} & set(df.columns)
                    return real(df, *label)
                monkeypatch.setattr(module, name, narrow)
    assert M.run_walk_forward(matrix, COLUMNS, "logistic").count() == 600
    assert len(T.fit_kinds(matrix, ["a", "b"], ["logistic"])) == 1


def test_calibration_method_follows_the_sample(matrix):
    fit = M.fit_classifier(matrix.where("season = 2020"), COLUMNS)
    assert fit.columns == ["a", "b"]
    assert M.calibrate(fit, matrix.where("season = 2021").limit(20)).method == "none"
    platt = M.calibrate(fit, matrix.where("season = 2021"))
    iso = M.calibrate(fit, matrix.where("season > 2020"))
    assert platt.method == "platt" and iso.method == "isotonic"
    for f in (platt, iso):
        assert M.brier(f.score(matrix)) < 0.25


def test_saved_fit_scores_the_same(spark, matrix, tmp_path):
    fit = M.calibrate(M.fit_classifier(matrix.where("season = 2020"), COLUMNS), matrix.where("season > 2020"))
    M.save_fit(fit, str(tmp_path / "m"))
    again = M.load_fit(spark, str(tmp_path / "m"))
    a = {r.game_id: r.prob for r in fit.score(matrix).collect()}
    b = {r.game_id: r.prob for r in again.score(matrix).collect()}
    assert a == pytest.approx(b)


def test_forest_search_selection_and_importance(matrix):
    train, test = matrix.where("season < 2022"), matrix.where("season = 2022")
    best, score = M.random_search(matrix, ["a", "b"], "forest", {"maxDepth": [2, 3], "numTrees": [5]}, 2)
    assert set(best) == {"maxDepth", "numTrees"} and 0 < score < 0.26
    picked = M.select_features(train, test, ["a", "b"], [1, 5], numTrees=5)
    assert [n for n, _ in picked] == [1, 2]
    fit = M.fit_classifier(train, ["a", "b"])
    rise = {r.feature: r.brier_rise for r in M.permutation_importance(fit, test, ["a", "b"]).collect()}
    assert rise["a"] > rise["b"] and M.importances(fit)[0][0] == "a"


def test_stack_and_ensemble(matrix):
    train, test = matrix.where("season < 2022"), matrix.where("season = 2022")
    out = M.stack(train, test, ["a", "b"], ["logistic", "boost"], ["season", "game_num"])
    assert out.count() == 300 and M.brier(out) < 0.25
    one, two = test.select("game_id", F.lit(0.4).alias("prob")), test.select("game_id", F.lit(0.6).alias("prob"))
    assert M.ensemble_mean([one, two]).agg(F.min("prob"), F.max("n_models")).first()[:] == (0.5, 2)


def test_counts_recover_the_rate(spark):
    rng = np.random.default_rng(9)
    rows = [(i, 2020 + i // 200, float(x), int(rng.poisson(np.exp(0.5 + 0.6 * x)))) for i, x in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(rows, "game_id bigint, season int, x double, sog int")
    fit, factor = M.fit_counts(df, ["x"], "sog", alpha=0.001)
    assert factor == pytest.approx(1.0, abs=0.1)
    newest = M.predict_counts(fit, df).where("season = 2022").agg(F.avg("sog").alias("y"), F.avg("pred").alias("p")).first()
    assert newest.p == pytest.approx(newest.y, rel=1e-6)
    out = M.counts_walk_forward(df, ["x"], "sog")
    assert out.count() == 400


def test_guards(spark):
    rows = spark.createDataFrame(
        [(1, 0, 5, 1500.0, 1500.0, 0.1), (2, 0, 5, None, 1500.0, 0.9), (3, 4, 5, None, None, 0.7), (4, 4, 5, 1.0, 1.0, 0.69)],
        "game_id int, home_games_played int, away_games_played int, home_elo double, away_elo double, feature_coverage double")
    assert {r.game_id: r.usable for r in publish_guard(rows).collect()} == {1: True, 2: False, 3: True, 4: False}
    schedule = spark.createDataFrame([(1, "LIVE"), (2, "FUT"), (3, None)], "game_id int, game_state string")
    assert {r.game_id: r.already_started for r in mark_started(rows, schedule).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_projections_round_before_the_tail(spark):
    rows = spark.createDataFrame([(1, 2.344), (2, 0.4), (3, 3.0)], "player_id int, expected double")
    assert [r.player_id for r in top_projections(rows, "expected", 0.5, 1).collect()] == [3]
    row = goalie_projections(rows, [2.5], 0.0).where("player_id = 1").first()
    want = 1 - np.exp(-2.34) * (1 + 2.34 + 2.34**2 / 2)
    assert row.expected == 2.34 and row.p_over_2_5 == round(want, 3)


def test_counts_fit_reads_vectors_that_are_written_once(spark, monkeypatch):
    """Every step of the fit reads one narrow table; no row is copied by a checkpoint."""
    written = []
    keep = M.stored
    monkeypatch.setattr(M, "stored", lambda df, label="rows": written.append(df.columns) or keep(df, label))
    monkeypatch.setattr(M, "pin", lambda df: pytest.fail("a checkpoint of the rows"))
    rows = [(2020 + i % 3, float(i % 7) if i % 11 else None, float(i % 5), i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "season int, x double, other double, sog int")
    fit, factor = M.fit_counts(df, ["x", "other"], "sog")
    assert written == [["age", "_weight", "_label", "features"]]
    newest = M.predict_counts(fit, df.where("season = 2022")).agg(F.avg("sog"), F.avg("pred")).first()
    assert factor > 0 and abs(newest[0] - newest[1]) < 1e-9


def test_projections_are_ordered_from_a_table(spark):
    """An ordering reads its input twice; the histories are not below it."""
    from __spark_entry__ import queries
    from foretrace.session import explained

    out = queries()["goalie_projections"](spark, "/root/testdata/sf0.001")
    assert "Window" not in explained(out).split("\n\n")[0] and out.count() > 0

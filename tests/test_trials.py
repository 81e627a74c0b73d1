import numpy as np
import pytest
from pyspark.sql import functions as F

from foretrace.operators import models as M
from foretrace.operators import trials as T
from foretrace.operators.history import Rolling, games_before, with_history
from foretrace.session import explained
from foretrace.sources.stored import bucketed_table, save_bucketed


@pytest.fixture(scope="module")
def split(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        a, b, c = (float(x) for x in rng.normal(size=3))
        rows.append((i, 2020 + i // 300, i, a if i % 7 else None, b, c, float(rng.random() < 1 / (1 + np.exp(-2 * a - b)))))
    df = spark.createDataFrame(rows, "game_id bigint, season int, game_num int, a double, b double, c double, target double").coalesce(2).cache()
    return df.where("season = 2020"), df.where("season = 2021")


COLUMNS = ["a", "b", "c"]


def test_tasks_keep_their_order(spark):
    assert T.side_by_side(spark, [lambda i=i: i for i in range(9)], 3) == list(range(9))
    assert T.side_by_side(spark, []) == []


def test_halving_keeps_the_best_of_each_rung(split):
    space = {"maxDepth": T.Between(2, 4), "subsamplingRate": T.Between(0.6, 1.0), "minInstancesPerNode": [1, 5]}
    rows = T.halving_search(*split, COLUMNS, "forest", space, trials=5, budget=("numTrees", 6), rungs=2).collect()
    first, last = ([r for r in rows if r.rung == k] for k in (0, 1))
    assert [r.budget for r in first] == [2] * 5 and [r.budget for r in last] == [6] * 2
    best = sorted(first, key=lambda r: (r.brier, r.trial))[:2]
    assert {r.trial for r in best} == {r.trial for r in first if r.survived} == {r.trial for r in last}
    assert [r.trial for r in last if r.survived] == [min(last, key=lambda r: (r.brier, r.trial)).trial]
    assert {r.n_scored for r in rows} == {100}
    assert T.drawn(space, 5, 42) == T.drawn(space, 5, 42) and all(2 <= d["maxDepth"] <= 4 for d in T.drawn(space, 30, 1))


def test_nothing_held_out_gives_null_scores(split):
    rows = T.halving_search(split[0], split[1].limit(0), COLUMNS, "logistic", {"elasticNetParam": [0.0, 0.5]}, trials=2, rungs=1).collect()
    assert [(r.n_scored, r.brier, r.survived) for r in rows] == [(0, None, True), (0, None, False)]


def test_slices_equal_fits_on_the_columns(split):
    train, test = split
    rows = T.sweep(train, test, COLUMNS, [1, 2, 9], "logistic").collect()
    assert [(r["size"], len(r.features)) for r in rows] == [(1, 1), (2, 2), (3, 3)] and rows[0].features == ["a"]
    for r in rows:
        assert r.brier == pytest.approx(M.brier(M.fit_classifier(train, r.features).score(test)), abs=1e-6)


def test_permuted_columns_equal_a_plain_shuffle(split):
    train, test = split
    test = test.unionByName(test.limit(1).withColumn("game_id", F.lit(None).cast("bigint")))
    fit = M.fit_classifier(train, COLUMNS)
    got = {r.feature: r for r in T.permutation_table(fit, test, seed=3).collect()}
    kept = test.where("game_id IS NOT NULL")
    hashed = kept.select("*", F.xxhash64("game_id", F.lit(3)).alias("s"), F.xxhash64("game_id", F.lit(4)).alias("v")).toPandas()
    slots, others = hashed.sort_values(["s", "game_id"]).reset_index(drop=True), hashed.sort_values(["v", "game_id"]).reset_index(drop=True)
    base = ((kept.transform(fit.score).toPandas().set_index("game_id").loc[slots.game_id, "prob"].to_numpy() - slots.target) ** 2).mean()
    means = train.agg(*[F.avg(c).alias(c) for c in COLUMNS]).first().asDict()
    last, scaler = fit.model.stages[-1], fit.model.stages[-2]
    for c in COLUMNS:
        mixed = slots.assign(**{c: others[c]})[COLUMNS].fillna(means)
        x = (mixed.to_numpy() - scaler.mean.toArray()) / scaler.std.toArray()
        prob = 1 / (1 + np.exp(-(x @ last.coefficients.toArray() + last.intercept)))
        want = ((prob - slots.target) ** 2).mean()
        assert got[c].n_scored == 100 and got[c].brier == pytest.approx(want) and got[c].brier_rise == pytest.approx(want - base)
    assert T.permutation_table(fit, test.limit(0)).count() == 0
    assert T.permutation_table(fit, test, ["b"]).count() == 1


def test_arrays_are_never_broadcast(spark):
    arrays = spark.range(40).select(F.col("id").alias("game_id"), F.lit(1.0).alias("target"), F.array(F.lit(1.0), F.lit(2.0)).alias("_own"))
    pairs = spark.range(40).select(F.col("id").alias("game_id"), (39 - F.col("id")).alias("_other"))
    both = T.arrays_side_by_side(arrays, pairs)
    assert both.count() == 40 and "Broadcast" not in explained(both)


def test_stack_tells_its_chunks(split):
    train, test = split
    out = M.stack(train, test, COLUMNS, ["logistic"], ["season", "game_num"])
    assert out.agg(F.min("stack_chunks"), F.max("stack_chunks")).first()[:] == (3, 3)
    few = M.stack(train.limit(60), test, COLUMNS, ["logistic"], ["season", "game_num"])
    assert few.agg(F.max("stack_chunks"), F.count("prob")).first()[:] == (0, 100)


def test_one_season_has_no_fold(split):
    assert M.run_walk_forward(split[0], COLUMNS).count() == 0
    assert M.counts_walk_forward(split[0], COLUMNS, "target").count() == 0


def test_stored_histories_need_no_exchange(spark, season_rows, tmp_path):
    keys, order, path = ["team_id"], ["season", "game_num", "game_id"], str(tmp_path / "facts")
    odd = season_rows.unionByName(season_rows.limit(3).withColumn("team_id", F.lit(None).cast("bigint")).withColumn("game_id", F.col("game_id") + 1))
    stored = save_bucketed(odd, path, "stored_facts", keys, order, 4)
    features = [Rolling("x_l5", "x", 5), games_before()]
    for by in (["team_id", "season"], ["team_id"]):
        plan = explained(with_history(stored, by, order, features, 1000))
        assert "Window" in plan and "Exchange" not in plan
        want = with_history(odd, by, order, features, 1000)
        got = with_history(stored, by, order, features, 1000).select(*want.columns)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    spark.sql("DROP TABLE stored_facts")
    again = bucketed_table(spark, path, "stored_facts", keys, order, 4)
    assert "Exchange" not in explained(with_history(again, ["team_id", "season"], order, features, 1000)) and again.count() == odd.count()
    spark.sql("DROP TABLE stored_facts")

"""Resumed refreshes, pruned merges into stored tables, resampled differences."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from foretrace.catalog.scalars import division_table
from foretrace.operators import analytics as N
from foretrace.operators import facts as X
from foretrace.plans import journal as J
from foretrace.plans.refresh import refresh
from foretrace.session import explained
from foretrace.sources import merge as M
from foretrace.sources import pruned as P
from foretrace.sources.scans import save_table
from foretrace.sources.views import Views


def test_a_failed_refresh_resumes_without_the_finished_steps(spark, tmp_path, monkeypatch):
    views = Views(spark, SMALL)
    results = views.matches.where("game_state = 'OFF' AND home_win IS NOT NULL").select("game_id", "season", "home_win")
    run = lambda found: refresh(spark, str(tmp_path / "r"), views.shots, views.matches, views.sides, found, division_table(views), views.preds)
    built = []
    monkeypatch.setattr(J, "save_table", lambda df, path, by: built.append(path.split("/")[-2]) or save_table(df, path, by))
    goalie_games = X.goalie_games

    def broken(shots):
        raise RuntimeError("lost")

    monkeypatch.setattr(X, "goalie_games", broken)
    with pytest.raises(RuntimeError):
        run(results)
    assert built == ["results", "team_games", "player_games"]
    monkeypatch.setattr(X, "goalie_games", goalie_games)
    built.clear()
    paths = run(results)
    assert built == ["goalie_games", "rating_pass", "matrix", "ratings", "log"]
    built.clear()
    assert run(results) == paths and not built
    # Other results: what reads them is computed again, what doesn't is not; old tables stay whole.
    again = run(results.where("game_id % 2 = 0"))
    assert built == ["results", "team_games", "rating_pass", "matrix", "ratings", "log"]
    assert again["player_games"] == paths["player_games"] and spark.read.parquet(paths["results"]).count() == results.count()
    assert J.Journal(spark, str(tmp_path / "r")).newest("results") == again["results"]


def test_a_half_written_table_is_never_published(spark, tmp_path):
    journal, ten = J.Journal(spark, str(tmp_path)), spark.range(10)
    first = journal.step("t", [ten], lambda: ten, ())
    bad = spark.range(20).select(F.when(F.col("id") < 19, F.col("id")).otherwise(F.raise_error(F.lit("late"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="late"):
        journal.step("t", [spark.range(20)], lambda: bad, ())
    assert journal.newest("t") == first and spark.read.parquet(first).count() == 10
    assert journal.newest("none") is None and journal.step("t", [spark.range(10)], lambda: bad, ()) == first


ROWS = [(i, 2000 + i % 5, i % 7, None if i % 4 == 0 else float(i)) for i in range(400)] + [(None, 2001, 1, 1.0), (None, None, 2, 2.0), (7000, None, 3, None)]
FRESH = [(i, 2000 + i % 5, 90 + i % 3, None if i % 3 == 0 else -1.0) for i in range(395, 460) if i % 5 in (1, 3)] + [(None, 2001, 8, 8.0), (7000, None, 9, 9.0)]
SCHEMA = "id long, season long, a long, b double"


@pytest.mark.parametrize("policy", ["replace", "coalesce", "update", "insert"])
@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "filter_bytes": 0}])
def test_stored_merges_equal_merges_of_whole_tables(spark, tmp_path, policy, sizes):
    path, target, fresh = str(tmp_path / "t"), spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(FRESH, SCHEMA)
    save_table(target, path)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/season=*/*.parquet")}
    before = files()
    touched = P.merge_stored(spark, path, fresh, ["id"], policy=policy, **sizes)
    assert sorted(touched, key=str) == [2001, 2003, None]
    kept = {f: t for f, t in before.items() if "season=2001" not in f and "season=2003" not in f and "DEFAULT" not in f}
    assert len(kept) >= 3 and kept.items() <= files().items()
    whole = {"insert": lambda: M.insert_only(target, fresh, ["id", "season"]), "update": lambda: M.update_only(target, fresh, ["id", "season"])}
    want = whole.get(policy, lambda: M.upsert(target, fresh, ["id", "season"], policy))()
    key = lambda df: sorted(df.select("id", "season", "a", "b").collect(), key=str)
    assert key(spark.read.parquet(path).withColumn("season", F.col("season").cast("long"))) == key(want)


def test_untouched_seasons_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    save_table(spark.createDataFrame(ROWS, SCHEMA), path)
    rows = P.in_partitions(spark.read.parquet(path), "season", [2001, 2003])
    assert "PartitionFilters: [season" in explained(rows) and rows.agg(F.min("season"), F.max("season"), F.count("*")).first() == (2001, 2003, 161)
    # The scan itself, before any filter could drop rows, lists the two partitions' files alone.
    scan = rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metadata().get("PartitionFilters").isDefined()
    assert {f.split("season=")[1][:4] for f in (r[0] for r in rows.select(F.input_file_name()).distinct().collect())} == {"2001", "2003"}
    may, rest = P.split_by_keys(spark.range(100_000), spark.range(0, 100_000, 1000), ["id"], 100, 0, 1 << 20)
    assert may.where("id % 1000 = 0").count() == 100 and may.count() + rest.count() == 100_000 and may.count() < 10_000


def test_resampling_weights_are_independent_poisson_draws():
    weights = N.bootstrap_weights(np.arange(20_000) * 977 - 5_000_000, 60)[:, 1:]
    assert abs(weights.mean() - 1) < 0.005 and abs(weights.var() - 1) < 0.01
    between = np.corrcoef(weights.T)[np.triu_indices(60, 1)]
    assert np.abs(between).max() < 0.04 and abs(between.mean()) < 0.001
    following = np.corrcoef(weights[:-1].ravel(), weights[1:].ravel())[0, 1]
    assert abs(following) < 0.005
    assert (N.bootstrap_weights(np.array([5, 5]), 9)[0] == N.bootstrap_weights(np.array([5]), 9)).all()


def test_resampling_copies_no_row(spark):
    rows = spark.range(1000).selectExpr("id AS game_id", "0.2 + id % 7 / 100D AS brier", "0.5D AS closing_prob_home", "id % 2 AS actual_home_win")
    out = N.brier_difference(rows, 50)
    plan = explained(out)
    assert plan.index("Generate") < plan.index("MapInArrow") and plan.count("Generate (") == 1
    found = out.first()
    assert found["n"] == 1000 and found["low"] < found["difference"] < found["high"]
    assert N.brier_difference(rows.where("false")).first()["n"] == 0

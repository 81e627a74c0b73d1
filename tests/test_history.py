import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foretrace.operators import features as Y
from foretrace.operators.history import (
    Decayed, Previous, Recent, Rolling, Total, first_per_group, games_before, snapshot_next, tail_mean, with_history,
)
from foretrace.session import explained

KEYS, ORDER = ["team_id", "season"], ["game_num", "game_id"]
FEATURES = [
    Rolling("x_l5", "x", 5), Rolling("x_home_l10", "CASE WHEN is_home THEN x END", 10), Rolling("x_min3", "x", 4, 3),
    Decayed("x_ewm", "x", 7), games_before(), Previous("prev", "x"), Recent("recent", "game_num", 3), Total("sum_won", "won"),
]


def local(df):
    return df.toPandas().sort_values(["team_id", "season", "game_num"]).reset_index(drop=True)


def same(a, b):
    a, b = a.astype(float), b.astype(float)
    assert (a.isna() == b.isna()).all()
    np.testing.assert_allclose(a.dropna(), b.dropna(), rtol=0, atol=1e-12)


def test_equals_definition(season_rows):
    out = local(with_history(season_rows, KEYS, ORDER, FEATURES))
    group = out.groupby(KEYS)
    same(out.x_l5, group.x.transform(lambda s: s.shift(1).rolling(5, min_periods=1).mean()))
    same(out.x_min3, group.x.transform(lambda s: s.shift(1).rolling(4, min_periods=3).mean()))
    same(out.x_ewm, group.x.transform(lambda s: s.shift(1).ewm(halflife=7, min_periods=1).mean()))
    masked = out.assign(m=out.x.where(out.is_home)).groupby(KEYS).m
    same(out.x_home_l10, masked.transform(lambda s: s.shift(1).rolling(10, min_periods=1).mean()))
    same(out.prev, group.x.shift(1))
    same(out.sum_won, group.won.transform(lambda s: s.shift(1).fillna(0).cumsum()))
    assert (out.games_played == group.cumcount()).all()


def test_first_event_has_no_features_and_seasons_reset(season_rows):
    out = local(with_history(season_rows, KEYS, ORDER, FEATURES))
    first = out[out.game_num == 1]
    assert first.x_l5.isna().all() and first.x_ewm.isna().all() and (first.games_played == 0).all()


@pytest.mark.parametrize("chunk_rows", [7, 30])
def test_hot_keys_in_chunks_give_the_same(season_rows, chunk_rows):
    plain = local(with_history(season_rows, ["team_id"], ["season", *ORDER], FEATURES))
    split = local(with_history(season_rows, ["team_id"], ["season", *ORDER], FEATURES, split_rows=10, chunk_rows=chunk_rows))
    assert len(plain) == len(split)
    for c in ["x_l5", "x_home_l10", "x_min3", "x_ewm", "games_played", "prev", "sum_won"]:
        same(plain[c], split[c])
    assert plain.recent.map(list).tolist() == split.recent.map(list).tolist()


def test_only_hot_keys_are_split(spark):
    rows = [(1, i, float(i)) for i in range(60)] + [(2, i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, o int, x double")
    features = [Rolling("m", "x", 3), games_before("n")]
    a = {(r.k, r.o): (r.m, r.n) for r in with_history(df, ["k"], ["o"], features).collect()}
    b = {(r.k, r.o): (r.m, r.n) for r in with_history(df, ["k"], ["o"], features, split_rows=20, chunk_rows=9).collect()}
    assert a == b
    cheap = df.select("k").unionByName(df.select("k"))
    c = with_history(df, ["k"], ["o"], features, row_bound=cheap, split_rows=20, chunk_rows=9)
    assert a == {(r.k, r.o): (r.m, r.n) for r in c.collect()}


def test_decay_over_long_histories_and_long_gaps(spark):
    """Past the block size and across a gap longer than the reach of the weights."""
    n = 2000
    x = np.random.default_rng(1).random(n)
    x[300:900] = np.nan
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    values = spark.createDataFrame(pd.DataFrame({"o": range(n), "x": x})).withColumn("x", F.nanvl(F.col("x"), F.lit(None)))
    df = df.join(values, "o")
    want = pd.Series(x).shift(1).ewm(halflife=1, min_periods=1).mean()
    for extra in ({}, {"split_rows": 100, "chunk_rows": 170}):
        out = with_history(df, ["k"], ["o"], [Decayed("e", "x", 1)], **extra).toPandas().sort_values("o")
        same(out.e.reset_index(drop=True), want)


def test_later_rows_cannot_change_earlier_ones(season_rows):
    whole = local(with_history(season_rows, KEYS, ORDER, FEATURES))
    cut = local(with_history(season_rows.where("game_num <= 12"), KEYS, ORDER, FEATURES))
    early = whole[whole.game_num <= 12].reset_index(drop=True)
    for c in ["x_l5", "x_ewm", "x_home_l10", "games_played"]:
        same(early[c], cut[c])


def test_one_shuffle_and_one_window(season_rows):
    features = [*Y.rolling(["x", "won"], [5, 10, 20]), *Y.venue_split(["x"]), games_before()]
    plan = explained(with_history(season_rows, KEYS, ORDER, features, row_bound=100))
    tree = plan.split("\n\n")[0]
    assert tree.count("Exchange") == 1 and tree.count("Window") == 1


@pytest.mark.parametrize("k", [1, 5, 24])
def test_snapshot_equals_training_row(season_rows, k):
    features = [Rolling("x_l5", "x", 5), Decayed("x_ewm", "x", 7), games_before()]
    names = [f.name for f in features]
    one = season_rows.where("season = 2025")
    trained = local(with_history(one, ["team_id"], ORDER, features))
    row = trained[trained.game_num == k + 1] if k < 25 else None
    served = snapshot_next(lambda h: with_history(h, ["team_id"], ORDER, features),
                           one.where(F.col("game_num") <= k), None, "team_id", ORDER, names).toPandas().sort_values("team_id")
    for c in names:
        same(served[c].reset_index(drop=True), row[c].reset_index(drop=True))


def test_snapshot_of_an_unknown_entity_is_null(spark, season_rows):
    features = [Rolling("x_l5", "x", 5), games_before()]
    extra = spark.createDataFrame([(9,)], "team_id bigint")
    out = snapshot_next(lambda h: with_history(h, ["team_id"], ORDER, features), season_rows, extra, "team_id", ORDER, ["x_l5", "games_played"])
    row = out.where("team_id = 9").first()
    assert row.x_l5 is None and row.games_played == 0 and out.count() == 3


def test_tail_mean_and_top_rows(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0), ("a", 4, 5.0), ("b", 1, None)], "k string, o int, x double")
    assert [tuple(r) for r in tail_mean(df, ["k"], ["o"], "x", 2, "m").collect()] == [("a", 4.0, 2)]
    top = first_per_group(df, ["k"], [F.desc("o")]).collect()
    assert sorted((r.k, r.o) for r in top) == [("a", 4), ("b", 1)]


def test_mode_prefers_the_latest_on_ties(spark):
    df = spark.createDataFrame([([1, 2, 1, 2],), ([3, 3, 4],), ([5],)], "ids array<bigint>")
    got = [r.m.id for r in df.select(Y.mode_of(F.col("ids")).alias("m")).collect()]
    assert got == [2, 3, 5]


def test_rest_and_pair_form(spark):
    from conftest import day

    sides = spark.createDataFrame([(1, 7, day("2025-01-01")), (2, 7, day("2025-01-02")), (3, 7, day("2025-01-06"))], "game_id int, team_id int, game_date date")
    rows = {r.game_id: (r.days_rest, r.back_to_back) for r in Y.rest_days(sides).collect()}
    assert rows == {1: (None, 0), 2: (1, 1), 3: (4, 0)}
    games = spark.createDataFrame(
        [(1, 1, 2, day("2025-01-01"), 1.0), (2, 2, 1, day("2025-01-03"), None), (3, 1, 2, day("2025-01-05"), 0.0), (4, 2, 1, day("2025-01-09"), 1.0)],
        "game_id int, home_id int, away_id int, game_date date, home_win double")
    form = {r.game_id: r.h2h_home_win_rate_l3 for r in Y.pair_form(games).collect()}
    assert form == {1: None, 2: 1.0, 3: 1.0, 4: 0.5}


@pytest.mark.parametrize("extra", [{}, {"split_rows": 20, "chunk_rows": 17}])
def test_many_rolling_means_are_added_up_from_short_sums(spark, extra):
    """No frame is longer than a block; nulls, masks, infinities and least counts mean what they did."""
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"k": np.repeat([1, 2, 3], [90, 35, 3]), "o": [*range(90), *range(35), *range(3)], "n": rng.integers(0, 9, 128),
                          "x": rng.random(128) * 10.0 ** rng.integers(-3, 12, 128), "y": rng.random(128)})
    frame.loc[rng.random(128) < 0.2, "x"] = np.nan
    frame.loc[30:59, "y"] = np.nan
    df = spark.createDataFrame(frame).select("k", "o", "n", *[F.nanvl(c, F.lit(None)).alias(c) for c in "xy"])
    df = df.withColumn("z", F.when((F.col("o") == 40) & (F.col("k") == 1), float("inf")).otherwise(F.col("y")))
    masked = "CASE WHEN o % 2 = 0 THEN x END"
    features = [*Y.rolling(["x", "y", "z", "n"], [5, 10, 20]), Rolling("masked_l10", masked, 10), Rolling("x_min3", "x", 20, 3), games_before()]
    out = with_history(df, ["k"], ["o"], features, **extra)
    assert not extra and "RowFrame, -20, -1" not in explained(out) and "RowFrame, -5, -1" in explained(out) or extra
    out = out.toPandas().sort_values(["k", "o"]).reset_index(drop=True)
    sources = {**{c: out[c] for c in "xyzn"}, "masked": out.x.where(out.o % 2 == 0)}
    for f in features[:-1]:
        values = sources["masked" if f.source == masked else f.source]

        def mean(at, values=values, f=f):
            rows = [i for i in range(max(0, at - f.window), at) if out.k[i] == out.k[at] and not np.isnan(values[i])]
            return values[rows].mean() if len(rows) >= max(f.min_count, 1) else np.nan

        np.testing.assert_allclose(out[f.name].astype(float), [mean(i) for i in range(len(out))], rtol=1e-12, err_msg=f.name)
    assert (out.games_played == out.groupby("k").cumcount()).all()

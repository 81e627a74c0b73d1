import math

import pytest
from pyspark.sql import functions as F

from foretrace.functions import odds as O
from foretrace.functions import scalars as S
from foretrace.functions import seasons as T
from foretrace.functions.counts import over_probability, recency_weight
from foretrace.operators import forecasts as C
from foretrace.operators import scoring as E
from foretrace.sources import merge as M

LOG = [
    (1, 1, 2, 0.62, 1.0, 0.55, 0.58), (2, 3, 4, 0.40, 0.0, 0.45, 0.41), (3, 5, 6, 0.50, 0.0, 0.50, None),
    (4, 7, 8, 0.45, 1.0, 0.52, 0.47), (5, 9, 10, 0.70, None, 0.60, 0.65),
]


@pytest.fixture(scope="module")
def log(spark):
    df = spark.createDataFrame(LOG, "game_id int, home_id int, away_id int, prob_home_win double, actual_home_win double, market_prob_home double, closing_prob_home double")
    return df.withColumn("model_name", F.lit("m"))


def test_summary_with_baselines(log):
    row = E.summarize(E.score_rows(log)).first()
    assert (row.n, row.n_logged, row.wins, row.losses) == (4, 5, 2, 2)
    assert row.home_win_rate == 0.5 and row.baseline_brier == 0.25
    assert row.brier == pytest.approx((0.38**2 + 0.4**2 + 0.5**2 + 0.55**2) / 4)


def test_unplayed_rows_are_unscored(log):
    row = E.score_rows(log).where("game_id = 5").first()
    assert row.correct is None and row.brier is None


def test_calibration_bins_are_right_closed(log):
    got = {r.bucket: r.n for r in E.calibration_table(E.score_rows(log)).collect()}
    assert got == {"<40%": 1, "40-45%": 1, "45-50%": 1, ">60%": 1}


def test_bucket_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.4,), (0.45,), (0.6,), (1.0,), (1.1,)], "p double")
    label = S.right_closed(F.col("p"), S.CALIBRATION_EDGES, S.CALIBRATION_LABELS, include_lowest=True)
    assert [r[0] for r in df.select(label).collect()] == ["<40%", "<40%", "40-45%", "55-60%", ">60%", None]
    tier = [r[0] for r in df.select(S.confidence_tier(F.col("p"))).collect()]
    assert tier[3] == "Strong Pick" and tier[0] == "Toss-Up"


def test_market_clv_and_edges(log):
    scored = E.score_rows(log)
    row = E.market_comparison(scored).first()
    assert row.n == 3 and row.mean_abs_edge == pytest.approx((0.04 + 0.01 + 0.02) / 3)
    clv = E.clv_summary(scored).first()
    assert clv.mean_clv == pytest.approx((0.03 + 0.04 + 0.05) / 3) and clv.beat_close_rate == 1.0
    ranked = E.edge_ranking(log).collect()
    assert [r.game_id for r in ranked] == [5, 1, 4, 2]
    assert [r.edge for r in ranked] == pytest.approx([0.10, 0.07, 0.07, 0.05])


def test_stored_results_survive(spark, log):
    outcomes = spark.createDataFrame([(1, None), (2, 1.0), (5, 1.0), (5, 1.0)], "game_id int, home_win double")
    got = {r.game_id: r.actual_home_win for r in E.attach_outcomes(log, outcomes).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0, 4: 1.0, 5: 1.0}
    twice = E.attach_outcomes(E.attach_outcomes(log, outcomes), outcomes)
    assert {r.game_id: r.actual_home_win for r in twice.collect()} == got


def test_fold_metrics_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, "m", 2020 + i % 3, round(float(rng.random()), 2), float(rng.integers(0, 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "game_id int, model_name string, season int, prob_home_win double, actual_home_win double")
    for extra in (None, 10_000):
        got = {r.season: r for r in E.fold_metrics(df, ["model_name"], "season", extra).collect()}
        assert set(got) == {2021, 2022}
        part = [(p, y) for _, _, s, p, y in rows if s == 2022]
        pos, neg = [p for p, y in part if y == 1], [p for p, y in part if y == 0]
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert got[2022].roc_auc == pytest.approx(auc, abs=1e-12)
        assert got[2022].brier == pytest.approx(sum((p - y) ** 2 for p, y in part) / len(part))
        assert got[2022].n_train == 200 and got[2022].n_test == 100


def test_over_probability_against_direct_sums(spark):
    df = spark.createDataFrame([(0.3,), (2.7,), (26.0,)], "mu double")
    for line in (0.5, 2.5, 30.5):
        for (mu,), got in zip([(0.3,), (2.7,), (26.0,)], df.select(over_probability(F.col("mu"), line)).collect()):
            want = 1 - sum(math.exp(-mu + i * math.log(mu) - math.lgamma(i + 1)) for i in range(int(line) + 1))
            assert got[0] == pytest.approx(want, abs=1e-12)
        n = 1 / 0.03258
        for (mu,), got in zip([(0.3,), (2.7,), (26.0,)], df.select(over_probability(F.col("mu"), line, 0.03258)).collect()):
            want = 1 - sum(math.exp(math.lgamma(i + n) - math.lgamma(n) - math.lgamma(i + 1) + n * math.log(n / (n + mu))
                                    + i * math.log(mu / (n + mu))) for i in range(int(line) + 1))
            assert got[0] == pytest.approx(want, abs=1e-10)


def test_weights_factor_dispersion(spark):
    df = spark.createDataFrame([(0,), (1,)], "age int")
    assert [r[0] for r in df.select(recency_weight(F.col("age"), 0.5)).collect()] == [1.0, 0.25]
    assert [r[0] for r in df.select(recency_weight(F.col("age"), None)).collect()] == [1.0, 1.0]
    rows = spark.createDataFrame([(2.0, 1.0), (4.0, 2.0)], "y double, pred double")
    assert C.drift_factor(rows).first().factor == 2.0
    assert C.drift_factor(rows, min_sample=100).first().factor == 1.0
    assert C.nb_dispersion(rows).first().dispersion == pytest.approx(max(((1 - 1) + (4 - 2)) / 2 / 2.5, 0))
    assert C.nb_dispersion(rows.withColumn("pred", F.col("y"))).first().dispersion == 0.0


def test_count_scoring_uses_the_training_rate(spark):
    rows = spark.createDataFrame([(1.0, 1.2), (3.0, 2.5)], "y double, pred double")
    train = spark.createDataFrame([(1.0, 0.0), (1.0, 0.0), (1.0, 0.0), (3.0, 0.0)], "y double, pred double")
    row = C.count_scoring(rows, [1.5], reference=train).first()
    assert row.brier_base == pytest.approx((0.25**2 + 0.75**2) / 2) and row.over_rate == 0.5


def test_prices(spark):
    df = spark.createDataFrame([(150, -170), (-110, -110)], "h int, a int")
    home, away = O.fair_pair(F.col("h"), F.col("a"))
    for r in df.select(home.alias("h"), away.alias("a")).collect():
        assert r.h + r.a == pytest.approx(1)
    assert df.select(O.implied_prob(F.col("h"))).first()[0] == pytest.approx(0.4)
    values = spark.createDataFrame([(0.4986,), (0.4987,)], "p double")
    assert values.agg(O.mean_half_even(F.col("p"), 4)).first()[0] == 0.4986


def test_season_rules(spark):
    df = spark.createDataFrame([("2025-2026",), ("20252026",), (" 2025 ",), ("25/26",)], "s string")
    assert [r[0] for r in df.select(T.season_year(F.col("s"))).collect()] == [2025, 2025, 2025, None]
    one = spark.createDataFrame([("2024020311", "2024030311")], "r string, p string")
    row = one.select(T.sequence_key(F.col("r")), T.sequence_key(F.col("p"))).first()
    assert row[0] == 20311 < row[1] == 30311


def test_merges(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "k int, v string, w int")
    s = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "k int, v string, w int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(M.insert_only(t, s, ["k"])) == [(1, "a", None), (2, "b", 1), (3, "c", 6)]
    assert rows(M.upsert(t, s, ["k"], "replace")) == [(1, "a", None), (2, None, 5), (3, "c", 6)]
    assert rows(M.upsert(t, s, ["k"], "coalesce")) == [(1, "a", None), (2, "b", 5), (3, "c", 6)]
    assert rows(M.update_only(t, s, ["k"])) == [(1, "a", None), (2, None, 5)]
    log = spark.createDataFrame([(1, "m", "2025-01-02")], "game_id int, model_name string, predicted_at string")
    late = spark.createDataFrame([(1, "m", "2025-01-01"), (2, "m", "2025-01-01")], log.schema)
    assert rows(M.keep_latest(log, late, ["game_id", "model_name"], "predicted_at")) == [(1, "m", "2025-01-02"), (2, "m", "2025-01-01")]
    both = M.by_priority([t.select("k", F.col("w").alias("x")), s.select("k", F.col("w").alias("x"))], ["k"], "x")
    assert rows(both) == [(2, 1), (3, 6)]

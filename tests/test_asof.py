"""As-of merges against a plain search and against one day at a time."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from foretrace.operators import asof as A
from foretrace.plans.slate import slate_context
from foretrace.session import explained
from foretrace.sources.views import Views


def plain(questions, events, n):
    out = []
    for key, t, q in questions:
        before = sorted((e for e in events if None not in (key, t, e[0], e[1]) and e[0] == key and e[1] < t), key=lambda e: (e[1], e[2]))
        out.append((q, [(e[3],) for e in before[-n:]] or None))
    return sorted(out)


@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("sizes", [{}, {"split_rows": 5, "chunk_rows": 7}])
def test_known_before_finds_the_newest_events(spark, n, sizes):
    rng = random.Random(n)
    keys, times = [1, 1, 1, 1, 2, 3, None], [*range(12), None]
    events = [(rng.choice(keys), rng.choice(times), i, rng.choice([None, rng.random()])) for i in range(120)]
    questions = [(rng.choice([*keys, 9]), rng.choice([*times, 99]), i) for i in range(80)]
    asked = spark.createDataFrame([*questions, questions[0]], "k int, t int, q int")
    known = spark.createDataFrame(events, "k int, t int, e int, x double")
    got = A.known_before(asked, known, ["k"], "t", ["x"], "found", n, ["e"], **sizes).collect()
    assert sorted(((r.q, r.found and [tuple(x) for x in r.found]) for r in got)) == plain([*questions, questions[0]], events, n)


def test_one_sort_and_no_range_join(spark):
    asked, known = spark.range(5).selectExpr("id AS k", "id AS t"), spark.range(9).selectExpr("id AS k", "id AS t", "id AS x")
    plan = explained(A.known_before(asked, known, ["k"], "t", ["x"], "found", row_bound=10))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 1 and "CartesianProduct" not in plan


def test_many_days_equal_one_day_at_a_time(spark):
    views = Views(spark, SMALL)
    days = [r[0] for r in views.matches.groupBy("game_date").count().orderBy(F.desc("count"), F.desc("game_date")).limit(3).collect()]
    openers = views.matches.groupBy("season").agg(F.min("game_date").alias("season_opener"))
    slate = views.matches.where(F.col("game_date").isin(days)).select("game_id", "season", "game_date", "home_id", "away_id")
    names = ["game_id", "home_rest_days", "away_rest_days", "home_back_to_back", "away_back_to_back", "rest_advantage", "season_day", "h2h_home_win_rate_l3"]
    got = {tuple(r) for r in A.slate_contexts(slate, views.sides, views.matches, openers).select(*names).collect()}
    want = set()
    for d in days:
        opener = views.matches.where(F.col("season") == d.year).agg(F.min("game_date")).first()[0]
        one = slate_context(slate.where(F.col("game_date") == d), views.sides, views.matches, F.lit(d), F.lit(opener))
        want |= {tuple(r) for r in one.select(*names).collect()}
    assert got == want and len(got) > 3

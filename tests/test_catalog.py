import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SMALL

TABLES = "orders lineitem customer nation events".split()
# One or two queries per family; check_queries.py runs all of them.
SAMPLE = ["ewm_prev", "snapshot_next", "fold_metrics", "over_prob_nb", "approx_date", "team_game_agg", "special_teams_agg",
          "consensus", "log_keep_latest", "box_skaters", "book_lines", "elo_pregame", "walk_forward_assign", "feature_matrix", "slate_openers", "closing_fill", "rolling_split", "player_identity", "edge_p_values"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-6
    return a == b or str(a)[:10] == str(b)[:10]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_oracle(spark, db, name):
    df = queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    cursor = db.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cursor.fetchall()), key=str)
    assert len(got) == len(want) and got
    bad = [(a, b) for a, b in zip(got, want) if not all(close(x, y) for x, y in zip(a, b))]
    assert len(bad) == 0, bad[:3]


def test_every_oracle_has_a_query_and_every_query_a_purpose():
    qs = queries()
    assert set(oracle_sql()) <= set(qs)
    assert all(fn.__doc__ for fn in qs.values())


def test_entry_has_rows(spark):
    assert entry(spark).limit(1).count() == 1


def test_rounding_is_that_of_spark_bit_for_bit(spark):
    import random
    import struct

    from foretrace.catalog.registry import rounded

    rng = random.Random(5)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-9, 17) for _ in range(4000)]
    values += [(2 * rng.randint(-10**9, 10**9) + 1) / 2e6 for _ in range(2000)] + [k / 2**7 for k in range(-400, 400)]
    values += [None, 0.0, -0.0, -1e-9, float("nan"), float("inf"), float("-inf"), 999999.9999995, 1e6, 5e-7, 1.5e-6, 1.7976931348623157e308, 5e-324]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    bits = [[None if r[0] is None else struct.pack("d", r[0]) for r in part.collect()]
            for part in (rounded(df), df.selectExpr("round(x, 6) + 0.0D AS x"))]
    assert bits[0] == bits[1]
    assert "rint" in rounded(df)._jdf.queryExecution().toString().lower()

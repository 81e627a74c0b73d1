"""Plans that must not regress: pushdown, pruning, shuffles, no Python."""

from conftest import SMALL
from __spark_entry__ import queries
from foretrace.session import explained


def tree(spark, name):
    plan = explained(queries()[name](spark, SMALL))
    return plan.split("\n\n")[0], plan


def test_scan_prunes_and_pushes(spark):
    _, plan = tree(spark, "scan_parquet")
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,300000.0)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_schedule_windows_shuffle_once(spark):
    top, _ = tree(spark, "prior_count")
    assert top.count("Exchange") == 1 and top.count("Window") == 1


def test_summary_partially_aggregates_in_one_pass(spark):
    top, plan = tree(spark, "hist_summary")
    assert top.count("Scan parquet") == 1 and top.count("Exchange") == 1 and "partial_avg" in plan


def test_no_python_and_no_cross_join_outside_ratings_and_fits(spark):
    for name in ("rolling_masked", "special_teams_agg", "consensus", "over_prob_nb", "book_lines", "price_attach"):
        top, _ = tree(spark, name)
        for operator in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert operator not in top, (name, operator)


def test_documents_are_parsed_once(spark):
    _, plan = tree(spark, "game_results")
    assert plan.count("from_json(") == 1


def test_matrix_reads_shots_joined_once(spark):
    """The three fact tables read the written shots; none scans or joins lines again."""
    _, plan = tree(spark, "feature_matrix")
    assert "lineitem.parquet" not in plan and plan.count("orders.parquet") <= 12


def test_facts_join_and_windows_share_their_shuffles(spark):
    """Without broadcasts: shots, games and results by game, then teams by season."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        top, plan = tree(spark, "rolling_mean_prev")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert top.count("Exchange") == 4 and plan.count("Arguments: hashpartitioning(game_id") == 3

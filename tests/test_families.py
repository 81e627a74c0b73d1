"""Queries that read the matrix once take only their columns of it."""

from types import SimpleNamespace

from foretrace.catalog import all_queries


def test_a_family_of_the_matrix_is_read_without_writing_the_matrix(spark, monkeypatch):
    all_queries()
    games = spark.createDataFrame([(1, 0.5, 1.0), (2, None, 0.0)], "game_id bigint, form double, target double")
    from foretrace.catalog import models as CM

    monkeypatch.setattr(CM, "matrix_of", lambda v: games)
    v = SimpleNamespace(spark=spark, sf_dir="/none")
    assert CM._family(v, ["form"]).columns == ["game_id", "form"]
    assert (spark.sparkContext.applicationId, "/none", "matrix") not in CM._WRITTEN
    try:
        path = CM.model_rows(v).inputFiles()
        assert CM.some_rows(v).inputFiles() == path
    finally:
        del CM._WRITTEN[spark.sparkContext.applicationId, "/none", "matrix"]

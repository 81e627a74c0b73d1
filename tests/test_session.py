"""The shared folder and measured broadcasts."""

from types import SimpleNamespace

import pytest

from foretrace.sources import views as V
from foretrace.session import bounded, explained, shared_dir


def test_a_cluster_must_name_its_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        context.master = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_only_small_tables_are_broadcast(spark):
    small, text = spark.range(10), spark.range(10).selectExpr("id", "repeat('x', 1000) AS t")
    large = spark.range(100).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in explained(large.join(bounded(small), large.k == small.id))
    plain = bounded(text, 5_000)
    assert "hint" not in plain._jdf.queryExecution().logical().toString().lower()


def test_shuffle_partitions_follow_the_rows_and_go_back(spark):
    kept = {c: spark.conf.get(c) for c in (V.SHUFFLE, V.ADVISORY)}
    try:
        spark.conf.set(V.ADVISORY, "64MB")
        V.prepare(spark)
        V.spread(spark, 3)
        assert spark.conf.get(V.SHUFFLE) == kept[V.SHUFFLE] and int(spark.conf.get(V.ADVISORY)) == V.TASK_BYTES
        V.spread(spark, 40 * V.TASK_ROWS)
        V.spread(spark, 90 * V.TASK_ROWS + 1)
        assert spark.conf.get(V.SHUFFLE) == "91"
        V.prepare(spark)
        assert spark.conf.get(V.SHUFFLE) == kept[V.SHUFFLE]
        # A number set meanwhile is the user's.
        V.spread(spark, 90 * V.TASK_ROWS)
        spark.conf.set(V.SHUFFLE, "7")
        V.prepare(spark)
        assert spark.conf.get(V.SHUFFLE) == "7"
        spark.conf.set(V.ADVISORY, "2m")
        V.prepare(spark)
        assert spark.conf.get(V.ADVISORY) == "2m"
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)

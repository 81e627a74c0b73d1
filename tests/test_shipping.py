"""Workers must not need the package on their path."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {tmp!r}).getOrCreate())
from __spark_entry__ import queries
print("rows", queries()["elo_final"](spark, "/root/testdata/sf0.001").count())
from foretrace.streaming import replay, stateful
games = spark.createDataFrame([(1, 0, 2024, 1, 10, 20, 1.0, 0), (2, 0, 2025, 1, 10, 20, 1.0, 0)], "game_id bigint, league bigint, season bigint, game_num bigint, home_id bigint, away_id bigint, home_win double, went_to_ot bigint")
games = games.selectExpr("*", "timestamp_seconds(season * 100000 + game_num) AS event_time")
# The second game moves the watermark past the first and waits itself.
print("streamed", replay.replayed(games, "season", stateful.elo_stream, "e").count())
"""


def test_ratings_run_where_workers_lack_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=root, tmp=str(tmp_path))], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=300)
    assert "rows " in out.stdout and "streamed 1" in out.stdout, out.stderr[-2000:]

import datetime
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("foretrace-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def season_rows(spark):
    """Two teams over two seasons with gaps in one stat."""
    import numpy as np

    rng = np.random.default_rng(20262027)
    rows = []
    for team in (1, 2):
        for season in (2024, 2025):
            for n in range(25):
                x = None if rng.random() < 0.2 else float(rng.random())
                rows.append((season * 1000 + team * 100 + n, team, season, n + 1, bool(n % 2), x, float(rng.integers(0, 2))))
    schema = "game_id bigint, team_id bigint, season bigint, game_num bigint, is_home boolean, x double, won double"
    return spark.createDataFrame(rows, schema)


def day(text):
    return datetime.date.fromisoformat(text)

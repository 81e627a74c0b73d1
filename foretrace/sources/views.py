"""Event views over the driver tables, as plain projections and one join.

``orders`` play the part of matches, ``lineitem`` the part of shots, and prices
and predictions are derived from both. Entities are groups of sixteen
customers, leagues groups of sixteen entities, so their number grows with the
data. No view needs a window: the order of a season is (game_num, game_id).
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.operators.history import SPLIT_ROWS

TEAM_SIZE = 16
LEAGUE_SIZE = 16

SHUFFLE = "spark.sql.shuffle.partitions"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
# What a task reads of a shuffle: facts unfold to some twenty times their shuffled bytes in its maps and sorts.
TASK_BYTES = 16 << 20
TASK_ROWS = 250_000
_CONFIGURED = "foretrace.shuffle.configured"
_RAISED = "foretrace.shuffle.raised"
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)i?b?", text.strip().lower()).groups()
    return int(number) * _UNITS[unit]


def spread(spark: SparkSession, rows: int) -> None:
    """At least one shuffle partition for ``TASK_ROWS`` rows, so a task's memory doesn't grow with the table."""
    wanted, now = -(-rows // TASK_ROWS), int(spark.conf.get(SHUFFLE))
    if wanted > now:
        if spark.conf.get(_RAISED, None) != str(now):
            spark.conf.set(_CONFIGURED, str(now))
        spark.conf.set(_RAISED, str(wanted))
        spark.conf.set(SHUFFLE, str(wanted))


def _as_configured(spark: SparkSession) -> None:
    """Undo ``spread``, unless someone has set the number since."""
    raised = spark.conf.get(_RAISED, None)
    if raised and raised == spark.conf.get(SHUFFLE):
        spark.conf.set(SHUFFLE, spark.conf.get(_CONFIGURED))
    if raised:
        spark.conf.unset(_RAISED)


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on: AQE with skewed-join splitting, small shuffle reads, compiled wide rows."""
    _as_configured(spark)
    if _bytes(spark.conf.get(ADVISORY)) > TASK_BYTES:
        spark.conf.set(ADVISORY, str(TASK_BYTES))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # HotSpot never compiles a method above this size; Spark then runs such a stage by operators, in methods that it splits.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


class Views:
    """Lazily built views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        prepare(spark)
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, name: str) -> int:
        """Row count of a table, answered from the file footers."""
        return self.table(name).count()

    @cached_property
    def match_bound(self) -> int | DataFrame:
        """Upper bound of team-game rows: two per match.

        Where that is too many to rule out a hot team, the schedule itself: its
        teams are counted without touching the shots.
        """
        total = 2 * self.rows("orders")
        return total if total <= SPLIT_ROWS else self.sides

    @cached_property
    def shot_bound(self) -> int:
        """Upper bound of any per-player or per-goalie fact."""
        return self.rows("lineitem")

    @cached_property
    def matches(self) -> DataFrame:
        spread(self.spark, 2 * self.rows("orders"))
        team, league = f"o_custkey div {TEAM_SIZE}", f"o_custkey div {TEAM_SIZE * LEAGUE_SIZE}"
        return self.table("orders").selectExpr(
            "o_orderkey AS game_id",
            "CAST(year(o_orderdate) AS BIGINT) AS season",
            "to_date(o_orderdate) AS game_date",
            "CAST(CASE WHEN o_orderkey % 20 = 0 THEN 30000 ELSE 20000 END + dayofyear(o_orderdate) AS BIGINT) AS game_num",
            "CASE WHEN o_orderkey % 20 = 0 THEN 'P' ELSE 'R' END AS game_type",
            f"{league} AS league", f"{team} AS home_id",
            f"({league}) * {LEAGUE_SIZE} + (({team}) % {LEAGUE_SIZE} + 1 + o_orderkey % {LEAGUE_SIZE - 1}) % {LEAGUE_SIZE} AS away_id",
            "CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_totalprice > 230000 THEN 1.0D ELSE 0.0D END AS home_win",
            "CAST(o_orderpriority = '1-URGENT' AS BIGINT) AS went_to_ot",
            "CASE o_orderstatus WHEN 'F' THEN 'OFF' WHEN 'O' THEN 'FUT' ELSE 'LIVE' END AS game_state",
            "floor(o_totalprice / 1000) % 7 AS home_score", "floor(o_totalprice / 7000) % 6 AS away_score",
        )

    @cached_property
    def newest_season(self) -> int:
        return self.matches.agg(F.max("season")).first()[0]

    @cached_property
    def sides(self) -> DataFrame:
        """Two rows per match, one per team."""
        common = ["game_id", "season", "game_date", "game_num", "game_type", "league"]
        home = self.matches.selectExpr(*common, "home_id AS team_id", "away_id AS opp_id", "true AS is_home", "home_win AS won")
        away = self.matches.selectExpr(*common, "away_id AS team_id", "home_id AS opp_id", "false AS is_home", "1 - home_win AS won")
        return home.unionByName(away)

    @cached_property
    def shots(self) -> DataFrame:
        spread(self.spark, self.shot_bound)
        m = self.matches.select(
            "game_id", "season", "game_num", "game_date", "game_type", "home_id", "away_id", "went_to_ot")
        team = "CASE WHEN l_linenumber % 2 = 1 THEN home_id ELSE away_id END"
        defending = "CASE WHEN l_linenumber % 2 = 1 THEN away_id ELSE home_id END"
        return self.table("lineitem").withColumnRenamed("l_orderkey", "game_id").join(m, "game_id").selectExpr(
            "game_id", "season", "game_num", "game_date", "game_type", "home_id", "away_id",
            "l_linenumber % 2 = 1 AS is_home", f"{team} AS team_id", f"{defending} AS def_team_id",
            f"({team}) * 20 + l_partkey % 20 AS player_id",
            f"CASE WHEN l_partkey % 97 != 0 THEN ({defending}) * 2 + CAST(l_suppkey % 10 = 0 AS BIGINT) END AS goalie_id",
            "CASE WHEN l_partkey % 17 != 0 THEN l_discount END AS xg",
            "CAST(l_returnflag = 'R' AS BIGINT) AS goal",
            "CAST(l_returnflag = 'R' OR l_linestatus = 'F' AS BIGINT) AS sog",
            "l_quantity AS distance",
            "CAST(CASE WHEN l_partkey % 10 = 0 THEN 4 ELSE 5 END AS BIGINT) AS home_skaters",
            "CAST(CASE WHEN l_suppkey % 7 = 0 THEN 4 ELSE 5 END AS BIGINT) AS away_skaters",
            "CAST(CASE WHEN went_to_ot = 1 AND l_linenumber >= 6 THEN 4 ELSE 1 + l_linenumber % 3 END AS BIGINT) AS period",
            "CAST(l_linenumber AS BIGINT) AS line_no", "l_partkey AS part_no", "l_suppkey AS supp_no",
        )

    @cached_property
    def quotes(self) -> DataFrame:
        """One moneyline pair per (game, book)."""
        raw = F.min(F.floor("l_extendedprice").cast("bigint") % 201 - 100)
        ml = F.col("home_ml")
        return (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("game_id"), (F.col("l_suppkey") % 5).alias("book"))
            .agg(raw.alias("raw"), F.max("l_quantity").alias("total"))
            .select("game_id", "book", "total",
                    F.when(F.col("raw") >= 0, 100 + F.col("raw")).otherwise(F.col("raw") - 100).alias("home_ml"))
            .select("game_id", "book", "total", "home_ml",
                    F.when(ml > 0, -(ml + 20)).when(ml <= -120, -ml - 20).otherwise(-110).alias("away_ml"))
        )

    @cached_property
    def preds(self) -> DataFrame:
        def price(step: int, span: int, low: float) -> str:
            return f"{low}D + CAST((game_id * {step}) % {span} AS DOUBLE) / 1000"

        return self.matches.selectExpr(
            "game_id", "season", "game_date", "home_id", "away_id", "home_win AS actual_home_win",
            "CASE WHEN game_id % 3 = 0 THEN 'model_b' ELSE 'model_a' END AS model_name",
            f"{price(7919, 400, 0.30)} AS prob_home_win", f"{price(6101, 300, 0.35)} AS market_prob_home",
            f"CASE WHEN game_id % 4 != 0 THEN {price(4517, 300, 0.35)} END AS closing_prob_home",
            "0.60D + CAST(game_id % 41 AS DOUBLE) / 100 AS feature_coverage",
        )

"""Queries that serve many days at once, and merges into stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretrace.catalog.registry import query, r, rounded
from foretrace.operators import asof as A
from foretrace.session import fresh_path
from foretrace.sources import pruned as P
from foretrace.sources.scans import save_table
from foretrace.sources.views import Views

_REST = """SELECT s.game_id, s.team_id, CAST(date_diff('day', p.game_date, s.game_date) AS BIGINT) AS rest_days
FROM sides s ASOF LEFT JOIN (SELECT DISTINCT team_id, game_date FROM sides) p ON s.team_id = p.team_id AND s.game_date > p.game_date"""
_MET = """SELECT game_id, avg(home_win) FILTER (k <= 3) AS w FROM (
  SELECT m.game_id, p.home_win, row_number() OVER (PARTITION BY m.game_id ORDER BY p.game_date DESC, p.game_id DESC) AS k
  FROM matches m JOIN matches p ON least(m.home_id, m.away_id) = least(p.home_id, p.away_id) AND greatest(m.home_id, m.away_id) = greatest(p.home_id, p.away_id)
    AND p.game_date < m.game_date) GROUP BY game_id"""


@query("asof_rest_days", _REST)
def asof_rest_days(v: Views):
    """Days since each team's last event, before every date it plays."""
    return A.rest_days(v.sides.select("game_id", "team_id", "game_date"), v.sides, row_bound=2 * v.rows("orders") * 2).select("game_id", "team_id", "rest_days")


@query("asof_rest_split", _REST)
def asof_rest_split(v: Views):
    """The same with every team's questions and events cut into chunks."""
    out = A.rest_days(v.sides.select("game_id", "team_id", "game_date"), v.sides, split_rows=20, chunk_rows=v.rows("orders") // 8)
    return out.select("game_id", "team_id", "rest_days")


@query("asof_meetings", f"WITH met AS ({_MET}) SELECT game_id, {r('w', 'h2h_home_win_rate_l3')} FROM matches LEFT JOIN met USING (game_id)")
def asof_meetings(v: Views):
    """Home win rate of the last three meetings, before every game."""
    slate = v.matches.select("game_id", "game_date", "home_id", "away_id")
    return rounded(A.meeting_rate(slate, v.matches, row_bound=2 * v.rows("orders")).select("game_id", "h2h_home_win_rate_l3"))


@query("slate_context_days", f"""WITH rest AS ({_REST}), met AS ({_MET}),
openers AS (SELECT season, min(game_date) AS opener FROM matches GROUP BY season)
SELECT m.game_id, h.rest_days AS home_rest_days, a.rest_days AS away_rest_days, CAST(coalesce(h.rest_days = 1, FALSE) AS BIGINT) AS home_back_to_back,
  CAST(coalesce(a.rest_days = 1, FALSE) AS BIGINT) AS away_back_to_back, coalesce(h.rest_days, 2) - coalesce(a.rest_days, 2) AS rest_advantage,
  CAST(date_diff('day', opener, m.game_date) AS BIGINT) AS season_day, {r('w', 'h2h_home_win_rate_l3')}
FROM matches m JOIN openers USING (season) JOIN rest h ON h.game_id = m.game_id AND h.team_id = m.home_id
JOIN rest a ON a.game_id = m.game_id AND a.team_id = m.away_id LEFT JOIN met ON met.game_id = m.game_id""")
def slate_context_days(v: Views):
    """Rest, advantage, season day and head-to-head of every game, as known before its own day."""
    openers = v.matches.groupBy("season").agg(F.min("game_date").alias("season_opener"))
    slate = v.matches.select("game_id", "season", "game_date", "home_id", "away_id")
    return rounded(A.slate_contexts(slate, v.sides, v.matches, openers, row_bound=4 * v.rows("orders")).drop("season", "game_date", "home_id", "away_id"))


_TARGET = "SELECT game_id, season, home_score, home_win, went_to_ot FROM matches WHERE game_id % 10 <> 0"
_SOURCE = """SELECT game_id, season, home_score + 1 AS home_score, CASE WHEN game_id % 6 <> 0 THEN home_win END AS home_win, 1 - went_to_ot AS went_to_ot
  FROM matches WHERE season >= 1997 AND game_id % 3 = 0"""
_PICK = {
    "replace": "CASE WHEN s.game_id IS NOT NULL THEN s.{0} ELSE t.{0} END", "coalesce": "coalesce(s.{0}, t.{0})",
    "update": "CASE WHEN s.game_id IS NOT NULL THEN s.{0} ELSE t.{0} END", "insert": "CASE WHEN t.game_id IS NOT NULL THEN t.{0} ELSE s.{0} END"}


def _merged(policy: str):
    picked = ", ".join(f"{_PICK[policy].format(c)} AS {c}" for c in ("home_score", "home_win", "went_to_ot"))
    join = "LEFT" if policy == "update" else "FULL"

    @query(f"merge_stored_{policy}", f"""WITH t AS ({_TARGET}), s AS ({_SOURCE})
SELECT coalesce(t.game_id, s.game_id) AS game_id, coalesce(t.season, s.season) AS season, {picked} FROM t {join} JOIN s ON t.game_id = s.game_id""")
    def run(v: Views):
        """Rows of the newer seasons merged into a stored table of all; older seasons stay untouched."""
        path = fresh_path(v.spark, f"stored-{policy}")
        save_table(v.matches.selectExpr("game_id", "season", "home_score", "home_win", "went_to_ot").where("game_id % 10 <> 0"), path)
        source = v.matches.where("season >= 1997 AND game_id % 3 = 0").selectExpr(
            "game_id", "season", "home_score + 1 AS home_score", "CASE WHEN game_id % 6 <> 0 THEN home_win END AS home_win", "1 - went_to_ot AS went_to_ot")
        # A key filter of hashed bits for one policy, of broadcast keys for the others.
        P.merge_stored(v.spark, path, source, ["game_id"], policy=policy, broadcast_bytes=0 if policy == "coalesce" else 8 << 20)
        return v.spark.read.parquet(path).withColumn("season", F.col("season").cast("bigint"))

    return run


for _policy in _PICK:
    _merged(_policy)

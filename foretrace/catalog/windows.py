"""Queries over pre-event windows."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from foretrace.catalog.registry import query, r, rounded
from foretrace.functions import scalars as S
from foretrace.operators import facts as X
from foretrace.operators import features as Y
from foretrace.operators.history import Previous, Recent, Rolling, first_per_group, games_before, snapshot_next, tail_mean, with_history
from foretrace.session import fresh_path
from foretrace.sources.stored import save_bucketed
from foretrace.sources.views import Views

# Rows of a bucket that one task sorts without trouble.
STORED_ROWS = 1_000_000
ID = "game_id, team_id"


def team_facts(v: Views):
    return X.team_games(v.shots, v.matches.select("game_id", "home_win"))


def _avg(stat: str, w: int, over: str, source: str | None = None, digits: int = 6) -> str:
    return r(f"avg({source or stat}) OVER ({over} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)", f"{stat}_l{w}", digits)


W1 = "PARTITION BY team_id, season ORDER BY game_num, game_id"

_ROLL_SQL = "SELECT game_id, team_id, " + ", ".join(
    _avg(s, w, W1) for s in Y.TEAM_STATS for w in Y.TEAM_WINDOWS) + " FROM facts"


@query("rolling_mean_prev", _ROLL_SQL)
def rolling_mean_prev(v: Views):
    """Means of fifteen team stats over the last 5, 10 and 20 games of the season."""
    out = with_history(team_facts(v), Y.BY_SEASON, Y.IN_SEASON, Y.rolling(Y.TEAM_STATS, Y.TEAM_WINDOWS), v.match_bound)
    return rounded(out.select("game_id", "team_id", *Y.rolling_columns(Y.TEAM_STATS, Y.TEAM_WINDOWS)))


@query("rolling_stored", _ROLL_SQL)
def rolling_stored(v: Views):
    """The same means from facts that are stored by team: written once, then read without a shuffle."""
    buckets = max(8, math.ceil(2 * v.rows("orders") / STORED_ROWS))
    stored = save_bucketed(team_facts(v), fresh_path(v.spark, "facts"), f"facts_{uuid.uuid4().hex}", ["team_id"], Y.CAREER, buckets)
    out = with_history(stored, Y.BY_SEASON, Y.IN_SEASON, Y.rolling(Y.TEAM_STATS, Y.TEAM_WINDOWS), v.match_bound)
    return rounded(out.select("game_id", "team_id", *Y.rolling_columns(Y.TEAM_STATS, Y.TEAM_WINDOWS)))


def _ewm_sql(stat: str) -> str:
    over = "OVER (PARTITION BY team_id, season ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return r(f"sum({stat} * power(2.0, rn / 7.0)) {over} / "
             f"sum(CASE WHEN {stat} IS NOT NULL THEN power(2.0, rn / 7.0) END) {over}", f"{stat}_ewm7")


_EWM_SQL = f"""
WITH numbered AS (SELECT *, row_number() OVER ({W1}) AS rn FROM facts)
SELECT game_id, team_id, {", ".join(_ewm_sql(s) for s in Y.FORM_STATS)} FROM numbered"""


@query("ewm_prev", _EWM_SQL)
def ewm_prev(v: Views):
    """Exponentially weighted means with a half-life of seven games."""
    out = with_history(team_facts(v), Y.BY_SEASON, Y.IN_SEASON, Y.decayed(Y.FORM_STATS), v.match_bound)
    return rounded(out.select("game_id", "team_id", *[f"{s}_ewm7" for s in Y.FORM_STATS]))


# The same results with histories cut into chunks, as keys above the split size are.
SPLIT = 40


def _chunk(v: Views) -> int:
    return max(200, v.rows("orders") // 4)


@query("rolling_split", _ROLL_SQL)
def rolling_split(v: Views):
    """Rolling means of team stats with every long history cut into chunks."""
    out = with_history(team_facts(v), Y.BY_SEASON, Y.IN_SEASON, Y.rolling(Y.TEAM_STATS, Y.TEAM_WINDOWS), v.sides, SPLIT, _chunk(v))
    return rounded(out.select("game_id", "team_id", *Y.rolling_columns(Y.TEAM_STATS, Y.TEAM_WINDOWS)))


@query("ewm_split", _EWM_SQL)
def ewm_split(v: Views):
    """Exponentially weighted means with every long history cut into chunks."""
    out = with_history(team_facts(v), Y.BY_SEASON, Y.IN_SEASON, Y.decayed(Y.FORM_STATS), v.sides, SPLIT, _chunk(v))
    return rounded(out.select("game_id", "team_id", *[f"{s}_ewm7" for s in Y.FORM_STATS]))


_LEGS = "OVER (PARTITION BY team_id ORDER BY game_date, game_id ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"


@query("previous_split", "SELECT game_id, team_id, lag(game_date) OVER (PARTITION BY team_id ORDER BY game_date, game_id) AS prev_date FROM sides")
def previous_split(v: Views):
    """The previous game's date with histories cut into chunks."""
    return with_history(v.sides, ["team_id"], ["game_date", "game_id"], [Previous("prev_date", "game_date")], None, SPLIT, _chunk(v)).select(
        "game_id", "team_id", "prev_date")


@query("recent_split", f"""SELECT game_id, team_id, count(won) {_LEGS.format(7)} AS n_recent, {r(f"coalesce(sum(won) {_LEGS.format(7)}, 0)", "sum_recent")} FROM sides""")
def recent_split(v: Views):
    """The results of the last seven games with histories cut into chunks."""
    out = with_history(v.sides, ["team_id"], ["game_date", "game_id"], [Recent("recent", "won", 7)], None, SPLIT, _chunk(v))
    total = F.aggregate("recent", F.lit(0.0), lambda a, x: a + x)
    return rounded(out.select("game_id", "team_id", F.size("recent").cast("bigint").alias("n_recent"), total.alias("sum_recent")))


@query("total_split", f"SELECT game_id, team_id, row_number() OVER ({W1}) - 1 AS games_played FROM sides")
def total_split(v: Views):
    """Games played before with histories cut into chunks."""
    return with_history(v.sides, Y.BY_SEASON, Y.IN_SEASON, [games_before()], None, SPLIT, _chunk(v)).select("game_id", "team_id", "games_played")


@query("rolling_masked", "SELECT game_id, team_id, " + ", ".join(
    _avg(f"{s}_{label}", 10, W1, f"CASE WHEN is_home = {flag} THEN {s} END")
    for flag, label in (("TRUE", "home"), ("FALSE", "away")) for s in Y.FORM_STATS) + " FROM facts")
def rolling_masked(v: Views):
    """Venue-split means among the last ten games."""
    out = with_history(team_facts(v), Y.BY_SEASON, Y.IN_SEASON, Y.venue_split(Y.FORM_STATS), v.match_bound)
    return rounded(out.select(
        "game_id", "team_id", *[f"{s}_{label}_l10" for label in ("home", "away") for s in Y.FORM_STATS]))


def _strong(label: str, stat: str) -> str:
    flag = 1 if label == "strong" else 0
    x = f"CASE WHEN opp_is_strong = {flag} THEN {stat} END"
    over = f"OVER ({W1} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    return r(f"CASE WHEN count({x}) {over} >= 3 THEN avg({x}) {over} END", f"{stat}_vs_{label}_l20")


@query("rolling_masked_min3", """
WITH rated AS (
  SELECT f.*, CAST(coalesce(1400 + (f.opp_id * 37 + f.game_id) % 200 >= 1500, FALSE) AS BIGINT) AS opp_is_strong
  FROM facts f)
SELECT game_id, team_id, """ + ", ".join(_strong(la, s) for la in ("strong", "weak") for s in Y.STRENGTH_STATS)
       + " FROM rated")
def rolling_masked_min3(v: Views):
    """Means against strong and weak opponents, null under three values."""
    strong = (1400 + (F.col("opp_id") * 37 + F.col("game_id")) % 200 >= Y.STRONG_ELO).cast("bigint")
    out = Y.strength_features(team_facts(v).withColumn("opp_is_strong", strong), v.match_bound)
    return rounded(out.select("game_id", "team_id", *Y.strength_columns()))


@query("prior_count", f"SELECT game_id, team_id, row_number() OVER ({W1}) - 1 AS games_played FROM sides")
def prior_count(v: Views):
    """Games the team has played before this one in the season."""
    return with_history(v.sides, Y.BY_SEASON, Y.IN_SEASON, [games_before()], v.match_bound).select(
        "game_id", "team_id", "games_played")


CAREER_SQL = "PARTITION BY {key} ORDER BY season, game_num, game_id"


@query("rolling_no_reset", "SELECT game_id, team_id, goalie_id, " + ", ".join(
    _avg(s, w, CAREER_SQL.format(key="goalie_id")) for s in Y.GOALIE_FORM_STATS for w in Y.GOALIE_FORM_WINDOWS)
    + " FROM goalie_games WHERE is_starter")
def rolling_no_reset(v: Views):
    """Goalie form across seasons, starters only."""
    out = Y.goalie_form(X.goalie_games(v.shots), v.shot_bound)
    return rounded(out.select(
        "game_id", "team_id", "goalie_id", *Y.rolling_columns(Y.GOALIE_FORM_STATS, Y.GOALIE_FORM_WINDOWS)))


@query("career_split", "SELECT game_id, team_id, goalie_id, " + ", ".join(
    _avg(s, w, CAREER_SQL.format(key="goalie_id")) for s in Y.GOALIE_FORM_STATS for w in Y.GOALIE_FORM_WINDOWS)
    + " FROM goalie_games WHERE is_starter")
def career_split(v: Views):
    """Goalie form across seasons with careers cut into chunks."""
    form = Y.rolling(Y.GOALIE_FORM_STATS, Y.GOALIE_FORM_WINDOWS)
    out = with_history(X.goalie_games(v.shots).where("is_starter"), ["goalie_id"], Y.CAREER, form, None, SPLIT, _chunk(v))
    return rounded(out.select("game_id", "team_id", "goalie_id", *[f.name for f in form]))


@query("player_rolling", "SELECT game_id, player_id, " + ", ".join(
    _avg(s, w, CAREER_SQL.format(key="player_id"), digits=9) for s in Y.PLAYER_STATS for w in Y.PLAYER_WINDOWS)
    + f", row_number() OVER ({CAREER_SQL.format(key='player_id')}) - 1 AS games_played FROM player_games")
def player_rolling(v: Views):
    """Player shot rates over the last 10 and 20 games."""
    out = Y.player_features(X.player_games(v.shots), v.shot_bound)
    return rounded(out.select(
        "game_id", "player_id", *Y.rolling_columns(Y.PLAYER_STATS, Y.PLAYER_WINDOWS), "games_played"), 9)


@query("goalie_prop_rolling", "SELECT game_id, team_id, goalie_id, " + ", ".join(
    _avg(s, w, CAREER_SQL.format(key="goalie_id")) for s in Y.GOALIE_PROP_STATS for w in Y.GOALIE_PROP_WINDOWS)
    + f", row_number() OVER ({CAREER_SQL.format(key='goalie_id')}) - 1 AS starts FROM goalie_games WHERE is_starter")
def goalie_prop_rolling(v: Views):
    """Goalie workload and save stats over the last 5, 10 and 20 starts."""
    out = Y.goalie_props(X.goalie_games(v.shots), v.shot_bound)
    return rounded(out.select("game_id", "team_id", "goalie_id",
                              *Y.rolling_columns(Y.GOALIE_PROP_STATS, Y.GOALIE_PROP_WINDOWS), "starts"))


@query("special_rolling", "SELECT game_id, team_id, " + ", ".join(
    _avg(s, w, W1) for s in Y.SPECIAL_STATS for w in Y.SPECIAL_WINDOWS) + " FROM st_games")
def special_rolling(v: Views):
    """Power-play and penalty-kill means within the season."""
    out = Y.special_features(X.special_teams(v.shots), v.match_bound)
    return rounded(out.select("game_id", "team_id", *Y.rolling_columns(Y.SPECIAL_STATS, Y.SPECIAL_WINDOWS)))


REST_CTE = """
  rest AS (SELECT game_id, team_id, is_home,
    CAST(date_diff('day', lag(game_date) OVER (PARTITION BY team_id ORDER BY game_date, game_id), game_date) AS BIGINT) AS days_rest
    FROM sides)"""


@query("rest_days", f"""WITH {REST_CTE}
SELECT g.game_id, h.days_rest AS home_rest_days, a.days_rest AS away_rest_days,
       CAST(coalesce(h.days_rest = 1, FALSE) AS BIGINT) AS home_back_to_back,
       CAST(coalesce(a.days_rest = 1, FALSE) AS BIGINT) AS away_back_to_back,
       coalesce(h.days_rest, 2) - coalesce(a.days_rest, 2) AS rest_advantage
FROM matches g JOIN rest h ON g.game_id = h.game_id AND h.is_home JOIN rest a ON g.game_id = a.game_id AND NOT a.is_home""")
def rest_days(v: Views):
    """Rest of both teams, back-to-back flags and the advantage."""
    out = Y.context_features(v.matches, v.sides, v.match_bound)
    return out.select("game_id", "home_rest_days", "away_rest_days", "home_back_to_back", "away_back_to_back",
                      "rest_advantage")


@query("pair_rolling3", "SELECT game_id, " + _avg("h2h_home_win_rate", 3,
       "PARTITION BY least(home_id, away_id), greatest(home_id, away_id) ORDER BY game_date, game_id", "home_win")
       + " FROM matches")
def pair_rolling3(v: Views):
    """Home win rate of the pair's last three meetings."""
    return rounded(Y.pair_form(v.matches, v.match_bound).select("game_id", "h2h_home_win_rate_l3"))


@query("season_day", """SELECT game_id, CAST(date_diff('day', min(game_date) OVER (PARTITION BY season), game_date) AS BIGINT)
  AS season_day FROM matches""")
def season_day(v: Views):
    """Days since the season's first game."""
    return Y.season_day(v.matches).select("game_id", "season_day")


@query("starter_flag", "SELECT game_id, team_id, goalie_id, " + r("shot_share") + ", is_starter FROM goalie_games")
def starter_flag(v: Views):
    """Share of shots faced and the starter flag."""
    return rounded(X.starter_flag(X.goalie_totals(v.shots)).select(
        "game_id", "team_id", "goalie_id", "shot_share", "is_starter"))


@query("days_since_clip", """SELECT game_id, team_id, goalie_id, least(CAST(date_diff('day',
  lag(game_date) OVER (PARTITION BY goalie_id ORDER BY game_date, game_id), game_date) AS BIGINT),
  CASE WHEN lag(game_date) OVER (PARTITION BY goalie_id ORDER BY game_date, game_id) IS NOT NULL THEN 30 END)
  AS days_since_last FROM goalie_agg""")
def days_since_clip(v: Views):
    """Days since the goalie's last appearance, at most thirty."""
    return Y.idle_days(X.goalie_totals(v.shots), ["goalie_id"], v.shot_bound).select(
        "game_id", "team_id", "goalie_id", "days_since_last")


@query("gaa_rolling", "WITH paced AS (SELECT *, CASE WHEN shots_against > 0 THEN goals_against / (shots_against * 120 / 3600.0) END AS gaa FROM goalie_games) "
       "SELECT game_id, team_id, goalie_id, " + r("gaa") + ", " + ", ".join(
           _avg(s, w, "PARTITION BY goalie_id ORDER BY game_date, game_id") for s in ("save_pct", "gaa") for w in (5, 10))
       + " FROM paced")
def gaa_rolling(v: Views):
    """Save share and goals per hour over the last appearances, by date."""
    paced = X.goalie_games(v.shots).withColumn(
        "gaa", S.rate_per_hour(F.col("goals_against"), F.col("shots_against") * 120))
    out = with_history(paced, ["goalie_id"], ["game_date", "game_id"], Y.rolling(["save_pct", "gaa"], [5, 10]), v.shot_bound)
    return rounded(out.select("game_id", "team_id", "goalie_id", "gaa", *Y.rolling_columns(["save_pct", "gaa"], [5, 10])))


_TEAM_ALL = [f.name for f in Y.team_feature_list()]


def _latest(stat: str, w: int, cte: str = "ranked") -> str:
    return r(f"avg(CASE WHEN back <= {w} THEN {stat} END)", f"{stat}_l{w}")


@query("snapshot_next", f"""
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY game_num DESC, game_id DESC) AS back
  FROM facts WHERE season = 2000),
wanted AS (SELECT DISTINCT team_id FROM sides)
SELECT w.team_id, count(x.game_id) AS games_played, {", ".join(_latest(s, k) for s in Y.TEAM_STATS for k in Y.TEAM_WINDOWS)}
FROM wanted w LEFT JOIN ranked x ON w.team_id = x.team_id GROUP BY w.team_id""")
def snapshot_next_query(v: Views):
    """Features of every team's next game of one season; unseen teams give nulls."""
    history = team_facts(v).where("season = 2000")
    names = [*Y.rolling_columns(Y.TEAM_STATS, Y.TEAM_WINDOWS), "games_played"]
    features = [*Y.rolling(Y.TEAM_STATS, Y.TEAM_WINDOWS), games_before()]
    out = snapshot_next(
        lambda h: with_history(h, ["team_id"], Y.IN_SEASON, features, v.match_bound),
        history, v.sides.select("team_id"), "team_id", Y.IN_SEASON, names)
    return rounded(out.select("team_id", *names))


@query("snapshot_parity", f"""
WITH rows_of AS (SELECT *, row_number() OVER ({W1}) AS rn FROM facts),
trained AS (SELECT team_id, season, {_avg("won", 5, W1)}, {_avg("goals_for", 10, W1)}, rn FROM rows_of)
SELECT team_id, season, won_l5, goals_for_l10, rn - 1 AS games_played, CAST(0 AS BIGINT) AS differences
FROM trained t WHERE rn = (SELECT max(rn) FROM rows_of x WHERE x.team_id = t.team_id AND x.season = t.season)""")
def snapshot_parity(v: Views):
    """Snapshot before the last game against that game's training row: no difference."""
    facts = team_facts(v).select("game_id", "team_id", "season", "game_num", "won", "goals_for")
    features = [Rolling("won_l5", "won", 5), Rolling("goals_for_l10", "goals_for", 10), games_before()]
    names = [f.name for f in features]
    trained = with_history(facts, Y.BY_SEASON, Y.IN_SEASON, features, v.match_bound)
    last = first_per_group(trained, Y.BY_SEASON, [F.desc(c) for c in Y.IN_SEASON])
    history = facts.join(last.select("game_id", "team_id"), ["game_id", "team_id"], "left_anti").withColumn(
        "entity", F.struct("team_id", "season"))
    everyone = last.select(F.struct("team_id", "season").alias("entity"))
    served = snapshot_next(
        lambda h: with_history(h, ["entity"], Y.IN_SEASON, features, v.match_bound),
        history, everyone, "entity", Y.IN_SEASON, names)
    served = served.select("entity.team_id", "entity.season", *[F.col(n).alias(f"served_{n}") for n in names])
    differ = sum(((~F.round(n, 9).eqNullSafe(F.round(f"served_{n}", 9))).cast("bigint") for n in names[1:]),
                 (~F.round(names[0], 9).eqNullSafe(F.round(f"served_{names[0]}", 9))).cast("bigint"))
    return rounded(last.join(served, Y.BY_SEASON).select("team_id", "season", *names, differ.alias("differences")))


@query("top1_per_group", """SELECT game_id, team_id, goalie_id, shots_against FROM (
  SELECT *, row_number() OVER (PARTITION BY game_id, team_id ORDER BY is_starter DESC, shots_against DESC, goalie_id) AS k
  FROM goalie_games) WHERE k = 1""")
def top1_per_group(v: Views):
    """One goalie per (game, team): the starter, else the busiest."""
    return first_per_group(
        X.goalie_games(v.shots), ["game_id", "team_id"],
        [F.desc("is_starter"), F.desc("shots_against"), "goalie_id"],
    ).select("game_id", "team_id", "goalie_id", "shots_against")


@query("tail_mean", """SELECT player_id, """ + r("avg(xg_per_attempt)", "xg_per_attempt_l10") + """, count(*) AS xg_per_attempt_l10_n
FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC, game_num DESC, game_id DESC, team_id DESC) AS k
  FROM player_games WHERE xg_per_attempt IS NOT NULL) WHERE k <= 10 GROUP BY player_id""")
def tail_mean_query(v: Views):
    """Mean of each player's ten newest values."""
    return rounded(tail_mean(
        X.player_games(v.shots), ["player_id"], [*Y.CAREER, "team_id"], "xg_per_attempt", 10, "xg_per_attempt_l10"))


@query("likely_starter", """
WITH recent AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY season DESC, game_num DESC, game_id DESC) AS k
  FROM goalie_games WHERE is_starter),
votes AS (SELECT team_id, goalie_id, count(*) AS n, min(k) AS newest FROM recent WHERE k <= 10 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY n DESC, newest) AS place,
  CAST(sum(n) OVER (PARTITION BY team_id) AS BIGINT) AS total FROM votes)
SELECT team_id, goalie_id, n || ' of last ' || total || ' starts' AS starter_basis, """
       + r("n / CAST(total AS DOUBLE)", "starter_confidence") + " FROM best WHERE place = 1")
def likely_starter(v: Views):
    """Most common of each team's last ten starters."""
    return rounded(Y.likely_starter(X.goalie_games(v.shots).where("is_starter")))


@query("starter_rule_eval", """
WITH s AS (SELECT team_id, season, goalie_id, list(goalie_id) OVER (PARTITION BY team_id ORDER BY season, game_num, game_id
  ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ids FROM goalie_games WHERE is_starter),
g AS (SELECT season, goalie_id, list_reverse(list_sort(list_transform(list_distinct(ids), lambda x:
  {'n': len(list_filter(ids, lambda y: y = x)), 'last': len(ids) - list_position(list_reverse(ids), x), 'id': x})))[1].id AS guess
  FROM s WHERE len(ids) > 0)
SELECT season, count(*) AS n, CAST(sum(CASE WHEN guess = goalie_id THEN 1 ELSE 0 END) AS BIGINT) AS hits, """
       + r("avg(CASE WHEN guess = goalie_id THEN 1.0 ELSE 0.0 END)", "share_correct") + " FROM g GROUP BY season")
def starter_rule_eval(v: Views):
    """How often the last-ten rule names the goalie who starts."""
    guessed = Y.starter_rule(X.goalie_games(v.shots).where("is_starter"), row_bound=v.shot_bound)
    hit = (F.col("guess") == F.col("goalie_id")).cast("bigint")
    return rounded(guessed.where(F.col("guess").isNotNull()).groupBy("season").agg(
        F.count("*").alias("n"), F.sum(hit).alias("hits"), F.avg(hit).alias("share_correct")))

"""Queries over facts, joins, merges and set operations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from foretrace.catalog.registry import query, r, rounded
from foretrace.catalog.windows import W1, _avg, team_facts
from foretrace.functions import scalars as S
from foretrace.functions.odds import fair_pair
from foretrace.operators import facts as X
from foretrace.operators import features as Y
from foretrace.operators import joins as J
from foretrace.operators.history import Rolling, games_before, with_history
from foretrace.plans.projections import top_projections
from foretrace.sources import merge as M
from foretrace.sources.views import Views

_FOR = ["xg_for", "xg_for_5v5"]
_COUNTS = ["goals_for", "shots_for", "corsi_for", "hd_chances_for", "hd_goals_for"]


@query("team_game_agg", f"SELECT game_id, team_id, is_home, opp_id, {', '.join(r(c) for c in _FOR)}, {', '.join(_COUNTS)} FROM team_agg")
def team_game_agg(v: Views):
    """Shots to team-games."""
    return rounded(X.team_totals(v.shots).select("game_id", "team_id", "is_home", "opp_id", *_FOR, *_COUNTS))


@query("player_game_agg", f"SELECT game_id, player_id, team_id, sog, {r('xg')}, shot_attempts, {r('xg_per_attempt')} FROM player_games")
def player_game_agg(v: Views):
    """Shots to player-games."""
    return rounded(X.player_games(v.shots).select(
        "game_id", "player_id", "team_id", "sog", "xg", "shot_attempts", "xg_per_attempt"))


@query("goalie_game_agg", f"""SELECT game_id, goalie_id, team_id, shots_against, goals_against, saves, {r('xg_against')},
  {r('save_pct')}, {r('gsax')}, is_starter FROM goalie_games""")
def goalie_game_agg(v: Views):
    """Shots to goalie-games on the defending side."""
    return rounded(X.goalie_games(v.shots).select(
        "game_id", "goalie_id", "team_id", "shots_against", "goals_against", "saves", "xg_against", "save_pct", "gsax", "is_starter"))


@query("special_teams_agg", f"""SELECT game_id, team_id, pp_goals, {r('pp_xg')}, pp_shots, pk_goals_against, {r('pk_xg_against')},
  pk_shots_against FROM st_games""")
def special_teams_agg(v: Views):
    """Power-play and penalty-kill totals."""
    return rounded(X.special_teams(v.shots).select(
        "game_id", "team_id", "pp_goals", "pp_xg", "pp_shots", "pk_goals_against", "pk_xg_against", "pk_shots_against"))


@query("first_per_group", """SELECT game_id,
  first(goalie_id ORDER BY line_no, part_no, supp_no, distance) FILTER (WHERE goalie_id IS NOT NULL) AS goalie_id,
  first(xg ORDER BY line_no, part_no, supp_no, distance) FILTER (WHERE xg IS NOT NULL) AS xg,
  first(game_type ORDER BY line_no, part_no, supp_no, distance) AS game_type FROM shots GROUP BY game_id""")
def first_per_group_query(v: Views):
    """First non-null value per column of each game."""
    return X.first_values(v.shots, ["game_id"], ["line_no", "part_no", "supp_no", "distance"], ["goalie_id", "xg", "game_type"])


@query("opponent_self_join", f"""SELECT game_id, team_id, {r('xg_against')}, goals_against, shots_against, corsi_against,
  hd_chances_against, hd_goals_against FROM team_pairs""")
def opponent_self_join(v: Views):
    """The opponent's totals on each team-game."""
    return rounded(X.against(X.team_totals(v.shots)).select(
        "game_id", "team_id", "xg_against", "goals_against", "shots_against", "corsi_against", "hd_chances_against", "hd_goals_against"))


@query("official_override", """SELECT game_id, team_id, won, home_win IS NULL AND goals_for = goals_against AS undecided FROM (
  SELECT t.game_id, t.team_id, t.won, coalesce(t.goals_for, 0) AS goals_for, coalesce(t.goals_against, -1) AS goals_against, m.home_win
  FROM team_games t JOIN matches m ON t.game_id = m.game_id)""")
def official_override(v: Views):
    """Official result over the one counted from shots."""
    rows = X.ratios(X.against(X.team_totals(v.shots)))
    return X.official_override(rows, v.matches).select("game_id", "team_id", "won", "undecided")


@query("regulation_win", "SELECT game_id, team_id, shot_ot, regulation_win FROM facts")
def regulation_win(v: Views):
    """Wins before overtime, overtime seen in regular-season shots."""
    rows = X.official_override(X.ratios(X.against(X.team_totals(v.shots))), v.matches)
    return X.regulation_win(rows, X.overtime_games(v.shots)).select("game_id", "team_id", "shot_ot", "regulation_win")


def short_form(v: Views):
    """A small team feature set for the join queries."""
    features = [Rolling("won_l5", "won", 5), games_before()]
    return with_history(v.sides, Y.BY_SEASON, Y.IN_SEASON, features, v.match_bound)


_FORM = f"form AS (SELECT game_id, team_id, opp_id, is_home, season, {_avg('won', 5, W1)}, row_number() OVER ({W1}) - 1 AS games_played FROM sides)"


@query("home_away_pivot", f"""WITH {_FORM}
SELECT h.game_id, h.season, h.won_l5 AS home_won_l5, h.games_played AS home_games_played, a.won_l5 AS away_won_l5,
  a.games_played AS away_games_played, {r("h.won_l5 - a.won_l5", "diff_won_l5")}, h.games_played - a.games_played AS diff_games_played
FROM form h JOIN form a ON h.game_id = a.game_id AND h.is_home AND NOT a.is_home""")
def home_away_pivot(v: Views):
    """Two team rows to one game row with differences."""
    form = short_form(v).withColumn("won_l5", F.round("won_l5", 6))
    return rounded(J.home_away(form, ["won_l5", "games_played"], ["season"]))


@query("attach_sides", f"""WITH g AS (SELECT game_id, team_id, {_avg('save_pct', 5, 'PARTITION BY goalie_id ORDER BY season, game_num, game_id')}
  FROM goalie_games WHERE is_starter)
SELECT m.game_id, h.save_pct_l5 AS home_g_save_pct_l5, a.save_pct_l5 AS away_g_save_pct_l5,
  {r("h.save_pct_l5 - a.save_pct_l5", "diff_g_save_pct_l5")}
FROM matches m LEFT JOIN g h ON m.game_id = h.game_id AND m.home_id = h.team_id LEFT JOIN g a ON m.game_id = a.game_id AND m.away_id = a.team_id""")
def attach_sides(v: Views):
    """Starter form joined to both sides of each match."""
    form = Y.goalie_form(X.goalie_games(v.shots), v.shot_bound)
    form = form.select("game_id", "team_id", F.round("save_pct_l5", 6).alias("save_pct_l5"))
    games = v.matches.select("game_id", "home_id", "away_id")
    return rounded(J.attach_sides(games, form, ["save_pct_l5"], prefix="g_").drop("home_id", "away_id"))


_SPINE = """spine AS (SELECT DISTINCT game_id, player_id + CAST(game_id % 3 AS BIGINT) AS player_id, CAST((player_id + game_id) % 4 AS BIGINT) AS sog FROM shots),
one AS (SELECT game_id, player_id, min(sog) AS sog FROM spine GROUP BY ALL),
meas AS (SELECT game_id, player_id, first(xg ORDER BY shot_attempts, xg, sog) AS xg, min(shot_attempts) AS shot_attempts,
  first(sog ORDER BY shot_attempts, xg, sog) AS sog FROM player_games WHERE player_id > 0 GROUP BY ALL),
joined AS (SELECT s.game_id, s.player_id, s.sog, coalesce(m.xg, 0) AS xg, coalesce(m.shot_attempts, 0) AS shot_attempts,
  m.shot_attempts IS NOT NULL AS matched, coalesce(m.sog <> s.sog, FALSE) AS disagrees,
  coalesce(n.name, 'P. ' || s.player_id) AS player_name
  FROM one s LEFT JOIN meas m ON s.game_id = m.game_id AND s.player_id = m.player_id
  LEFT JOIN (SELECT DISTINCT player_id, 'Player ' || player_id AS name FROM player_games WHERE player_id % 5 > 0) n ON s.player_id = n.player_id)"""


def spine_rows(v: Views):
    spine = v.shots.select(
        "game_id", (F.col("player_id") + F.col("game_id") % 3).alias("player_id"),
        ((F.col("player_id") + F.col("game_id")) % 4).alias("sog"),
    ).groupBy("game_id", "player_id").agg(F.min("sog").alias("sog"))
    spine = spine.withColumn("player_name", F.concat(F.lit("P. "), F.col("player_id").cast("string")))
    name = F.when(F.col("player_id") % 5 > 0, F.concat(F.lit("Player "), F.col("player_id").cast("string")))
    return J.spine_enrich(spine, X.player_games(v.shots).withColumn("player_name", name))


@query("spine_enrich", f"""WITH {_SPINE} SELECT game_id, player_id, player_name, sog, {r('xg')}, shot_attempts,
  {r('CASE WHEN shot_attempts > 0 THEN xg / shot_attempts END', 'xg_per_attempt')}, matched FROM joined""")
def spine_enrich(v: Views):
    """Full lineups with sparse measurements."""
    return rounded(spine_rows(v).drop("disagrees"))


@query("reconcile_counts", f"""WITH {_SPINE} SELECT count(*) AS n_rows, CAST(sum(CAST(matched AS BIGINT)) AS BIGINT) AS n_matched,
  {r('avg(CAST(matched AS DOUBLE))', 'matched_share')}, CAST(sum(CASE WHEN shot_attempts = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero_attempts,
  CAST(sum(CAST(disagrees AS BIGINT)) AS BIGINT) AS n_disagree FROM joined""")
def reconcile_counts(v: Views):
    """Agreement of lineup and measurements."""
    return rounded(J.reconcile(spine_rows(v)))


@query("opponent_context", f"""WITH {_FORM}
SELECT p.game_id, p.player_id, p.team_id, CASE WHEN p.team_id = m.home_id THEN m.away_id ELSE m.home_id END AS opp_id,
  CAST(p.team_id = m.home_id AS DOUBLE) AS is_home, o.won_l5 AS own_won_l5, x.won_l5 AS opp_won_l5
FROM player_games p JOIN matches m ON p.game_id = m.game_id
LEFT JOIN form o ON p.game_id = o.game_id AND p.team_id = o.team_id
LEFT JOIN form x ON p.game_id = x.game_id AND x.team_id = CASE WHEN p.team_id = m.home_id THEN m.away_id ELSE m.home_id END""")
def opponent_context(v: Views):
    """Own and opponent form on each player-game."""
    players = X.player_games(v.shots).select("game_id", "player_id", "team_id")
    return rounded(J.opponent_context(players, v.matches, short_form(v), ["won_l5"], ["won_l5"]))


@query("asof_last_event", "SELECT team_id, max(game_date) AS last_date FROM sides WHERE game_date < DATE '1999-03-01' GROUP BY team_id")
def asof_last_event(v: Views):
    """Last event date of each team before a day."""
    return J.last_event_before(v.sides, F.lit("1999-03-01").cast("date"))


@query("asof_last3_pair", f"""WITH slate AS (SELECT game_id, least(home_id, away_id) AS a, greatest(home_id, away_id) AS b FROM matches
  WHERE season = 2000),
past AS (SELECT least(home_id, away_id) AS a, greatest(home_id, away_id) AS b, home_win,
  row_number() OVER (PARTITION BY least(home_id, away_id), greatest(home_id, away_id) ORDER BY game_date DESC, game_id DESC) AS k
  FROM matches WHERE game_date < DATE '2000-01-01'),
rate AS (SELECT a, b, avg(home_win) AS w FROM past WHERE k <= 3 GROUP BY a, b)
SELECT game_id, {r("w", "h2h_home_win_rate_l3")} FROM slate LEFT JOIN rate USING (a, b)""")
def asof_last3_pair(v: Views):
    """Last three meetings before a day, for every game of the next season."""
    day = F.lit("2000-01-01").cast("date")
    return rounded(J.last_meetings(v.matches.where("season = 2000"), v.matches, day))


_RAW = "CASE WHEN {0} > 0 THEN 100.0 / ({0} + 100) ELSE abs({0}) / CAST(abs({0}) + 100 AS DOUBLE) END"
_H, _A = f"CAST({_RAW.format('home_ml')} AS DOUBLE)", f"CAST({_RAW.format('away_ml')} AS DOUBLE)"


def _half_even(x: str) -> str:
    return f"(q_{x} + CASE WHEN 2 * (s_{x} - q_{x} * n) > n OR (2 * (s_{x} - q_{x} * n) = n AND q_{x} % 2 = 1) THEN 1 ELSE 0 END) / CAST(10000 AS DOUBLE)"


_CONS = f"""fair AS (SELECT game_id, book, total, round({_H} / ({_H} + {_A}), 4) AS h, round({_A} / ({_H} + {_A}), 4) AS a FROM quotes),
units AS (SELECT game_id, CAST(sum(CAST(round(h * 10000) AS BIGINT)) AS BIGINT) AS s_h, CAST(sum(CAST(round(a * 10000) AS BIGINT)) AS BIGINT) AS s_a,
  round_even(avg(total), 2) AS total, count(*) AS n FROM fair GROUP BY game_id),
consensus AS (SELECT game_id, {_half_even("h")} AS prob_home_win, {_half_even("a")} AS prob_away_win, total, n AS n_books
  FROM (SELECT *, s_h // n AS q_h, s_a // n AS q_a FROM units))"""


@query("consensus", f"WITH {_CONS} SELECT game_id, {r('prob_home_win')}, {r('prob_away_win')}, {r('total')}, n_books FROM consensus")
def consensus(v: Views):
    """Mean fair price and total across books."""
    return rounded(J.consensus(v.quotes))


_INDEX = f"""{_CONS}, idx AS (SELECT game_date, home_id, away_id, max(m.game_id) AS game_id FROM matches m JOIN consensus c ON m.game_id = c.game_id
  GROUP BY ALL), price AS (SELECT i.game_date, i.home_id, i.away_id, c.prob_home_win AS market_prob_home, c.n_books AS market_n_books
  FROM idx i JOIN consensus c ON i.game_id = c.game_id)"""


def price_index(v: Views):
    prices = J.consensus(v.quotes).join(v.matches, "game_id").select(
        "game_id", "game_date", "home_id", "away_id", F.col("prob_home_win").alias("market_prob_home"),
        F.col("n_books").alias("market_n_books"))
    return J.price_index(prices)


@query("price_attach", f"""WITH {_INDEX} SELECT p.game_id, {r('c.market_prob_home', 'market_prob_home')}, c.market_n_books FROM preds p
  LEFT JOIN price c ON p.game_date = c.game_date AND p.home_id = c.home_id AND p.away_id = c.away_id""")
def price_attach(v: Views):
    """Market price of each prediction by date and teams."""
    return rounded(J.attach_prices(v.preds, price_index(v)).select("game_id", "market_prob_home", "market_n_books"))


@query("player_identity", """SELECT game_id, CASE WHEN part_no % 50 = 3 THEN NULL ELSE player_id END AS player_id,
  CASE WHEN part_no % 50 <> 3 THEN 'P' || player_id END AS player_name, CASE WHEN supp_no % 3 = 0 THEN 'D' ELSE 'C' END AS position, team_id,
  CAST(sum(sog) AS BIGINT) AS sog, count(xg) AS shot_attempts FROM shots WHERE game_type = 'R' GROUP BY ALL""")
def player_identity(v: Views):
    """Player facts keyed by id, name and position too, unknown players included."""
    known = F.when(F.col("part_no") % 50 != 3, F.col("player_id"))
    shots = v.shots.withColumn("player_id", known).withColumn("player_name", F.concat(F.lit("P"), F.col("player_id").cast("string"))).withColumn(
        "position", F.when(F.col("supp_no") % 3 == 0, "D").otherwise("C"))
    return X.player_games(shots).select("game_id", "player_id", "player_name", "position", "team_id", "sog", "shot_attempts")


@query("closing_fill", f"""WITH {_INDEX}
SELECT p.game_id, {r("coalesce(p.closing_prob_home, CASE WHEN actual_home_win IS NOT NULL THEN c.market_prob_home END)", "closing_prob_home")},
  CASE WHEN p.closing_prob_home IS NULL AND actual_home_win IS NOT NULL THEN c.market_n_books END AS closing_n_books
FROM preds p LEFT JOIN price c ON p.game_date = c.game_date AND p.home_id = c.home_id AND p.away_id = c.away_id""")
def closing_fill(v: Views):
    """Closing prices of all played games filled where missing, with their books."""
    return rounded(J.fill_closing(v.preds, price_index(v)).select("game_id", "closing_prob_home", "closing_n_books"))


@query("odds_match", """WITH o AS (SELECT q.game_id AS odds_id, book, m.game_date, m.home_id, CASE WHEN q.game_id % 10 = 0 THEN -1 ELSE m.away_id END AS away_id
  FROM quotes q JOIN matches m ON q.game_id = m.game_id), one AS (SELECT game_date, home_id, away_id, min(game_id) AS game_id FROM matches GROUP BY ALL)
SELECT odds_id, book, game_id FROM o JOIN one USING (game_date, home_id, away_id)""")
def odds_match(v: Views):
    """Odds rows matched to one game by teams and date."""
    odds = v.quotes.select(F.col("game_id").alias("odds_id"), "book").join(
        v.matches.withColumnRenamed("game_id", "odds_id"), "odds_id").select(
        "odds_id", "book", "game_date", "home_id", F.when(F.col("odds_id") % 10 == 0, -1).otherwise(F.col("away_id")).alias("away_id"))
    matched, _ = J.match_odds(odds, v.matches)
    return matched.select("odds_id", "book", "game_id")


@query("odds_unmatched", """SELECT q.game_id AS odds_id, book FROM quotes q JOIN matches m ON q.game_id = m.game_id WHERE q.game_id % 10 = 0""")
def odds_unmatched(v: Views):
    """Odds rows no game answers to."""
    odds = v.quotes.select(F.col("game_id").alias("odds_id"), "book").join(
        v.matches.withColumnRenamed("game_id", "odds_id"), "odds_id").select(
        "odds_id", "book", "game_date", "home_id", F.when(F.col("odds_id") % 10 == 0, -1).otherwise(F.col("away_id")).alias("away_id"))
    return J.match_odds(odds, v.matches)[1].select("odds_id", "book")


@query("anti_scratches", """SELECT game_id, player_id FROM player_games WHERE player_id NOT IN
  (SELECT player_id FROM shots WHERE xg IS NULL AND game_type = 'P' AND season = 2001)""")
def anti_scratches(v: Views):
    """Players minus the scratched ones."""
    scratched = v.shots.where("xg IS NULL AND game_type = 'P' AND season = 2001").select("player_id").distinct()
    return J.without(X.player_games(v.shots).select("game_id", "player_id"), scratched, ["player_id"])


@query("roster_override", f"""WITH last AS (SELECT player_id, count(*) AS games_played FROM player_games GROUP BY player_id),
roster AS (SELECT DISTINCT player_id, team_id + 1 AS team_id, team_id AS opp_id, 'Player ' || player_id AS player_name FROM player_games WHERE player_id % 3 > 0),
opp AS (SELECT team_id AS opp_id, {r("avg(won)", "opp_won")} FROM sides WHERE team_id % 2 = 0 GROUP BY team_id)
SELECT r.player_id, r.team_id, r.player_name, games_played, opp_id, opp_won FROM last JOIN roster r USING (player_id) LEFT JOIN opp USING (opp_id)""")
def roster_override(v: Views):
    """Roster identity over history, opponent columns where known."""
    players = X.player_games(v.shots)
    snapshot = players.groupBy("player_id").agg(F.count("*").alias("games_played"), F.max("team_id").alias("team_id"))
    roster = players.where("player_id % 3 > 0").select(
        "player_id", (F.col("team_id") + 1).alias("team_id"), F.col("team_id").alias("opp_id"),
        F.concat(F.lit("Player "), F.col("player_id").cast("string")).alias("player_name")).distinct()
    opponents = v.sides.where("team_id % 2 = 0").groupBy(F.col("team_id").alias("opp_id")).agg(F.avg("won").alias("opp_won"))
    return rounded(J.roster_identity(snapshot, roster, opponents))


@query("goalie_dates", "SELECT g.game_id, g.goalie_id, m.game_date, m.home_id FROM goalie_agg g JOIN matches m ON g.game_id = m.game_id")
def goalie_dates(v: Views):
    """Goalie rows with the date of their game."""
    goalies = X.goalie_totals(v.shots).select("game_id", "goalie_id")
    return goalies.join(v.matches.select("game_id", "game_date", "home_id"), "game_id")


@query("sql_game_dates", "SELECT game_id, game_date, home_id, away_id, home_win FROM matches WHERE game_date IS NOT NULL")
def sql_game_dates(v: Views):
    """Game dates through the SQL interface."""
    return v.spark.sql("SELECT game_id, game_date, home_id, away_id, home_win FROM {games} WHERE game_date IS NOT NULL", games=v.matches)


@query("scan_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def scan_parquet(v: Views):
    """Two columns and one pushed filter."""
    return v.table("orders").where("o_totalprice > 300000").select("o_orderkey", "o_totalprice")


@query("outcomes_by_priority", """SELECT game_id, coalesce(CASE WHEN game_id % 3 > 0 THEN home_win END, 1 - home_win) AS home_win
  FROM matches WHERE home_win IS NOT NULL""")
def outcomes_by_priority(v: Views):
    """Official outcomes first, another source where they are missing."""
    official = v.matches.select("game_id", F.when(F.col("game_id") % 3 > 0, F.col("home_win")).alias("home_win"))
    other = v.matches.select("game_id", (1 - F.col("home_win")).alias("home_win"))
    return M.by_priority([official, other], ["game_id"], "home_win")


_T = "t AS (SELECT game_id, home_score, CASE WHEN game_id % 4 > 0 THEN home_win END AS home_win, went_to_ot FROM matches WHERE game_id % 5 > 0)"
_S = "s AS (SELECT game_id, home_score + 10 AS home_score, CASE WHEN game_id % 3 > 0 THEN home_win END AS home_win, 1 - went_to_ot AS went_to_ot FROM matches WHERE game_id % 7 > 2)"


def _pair(v: Views):
    m = v.matches
    target = m.where("game_id % 5 > 0").select(
        "game_id", "home_score", F.when(F.col("game_id") % 4 > 0, F.col("home_win")).alias("home_win"), "went_to_ot")
    source = m.where("game_id % 7 > 2").select(
        "game_id", (F.col("home_score") + 10).alias("home_score"),
        F.when(F.col("game_id") % 3 > 0, F.col("home_win")).alias("home_win"), (1 - F.col("went_to_ot")).alias("went_to_ot"))
    return target, source


@query("merge_insert_only", f"WITH {_T}, {_S} SELECT * FROM t UNION ALL SELECT * FROM s WHERE game_id NOT IN (SELECT game_id FROM t)")
def merge_insert_only(v: Views):
    """New keys are inserted, known keys ignored."""
    return M.insert_only(*_pair(v), ["game_id"])


@query("merge_replace", f"WITH {_T}, {_S} SELECT * FROM s UNION ALL SELECT * FROM t WHERE game_id NOT IN (SELECT game_id FROM s)")
def merge_replace(v: Views):
    """Source rows win, nulls included."""
    return M.upsert(*_pair(v), ["game_id"], "replace")


@query("merge_coalesce", f"""WITH {_T}, {_S} SELECT coalesce(t.game_id, s.game_id) AS game_id, coalesce(s.home_score, t.home_score) AS home_score,
  coalesce(s.home_win, t.home_win) AS home_win, CASE WHEN s.game_id IS NOT NULL THEN s.went_to_ot ELSE t.went_to_ot END AS went_to_ot
  FROM t FULL JOIN s ON t.game_id = s.game_id""")
def merge_coalesce(v: Views):
    """Non-null source values win; the overtime flag is always replaced."""
    return M.upsert(*_pair(v), ["game_id"], "coalesce", always=["went_to_ot"])


@query("merge_update_only", f"""WITH {_T}, {_S} SELECT t.game_id, CASE WHEN s.game_id IS NOT NULL THEN s.home_score ELSE t.home_score END AS home_score,
  CASE WHEN s.game_id IS NOT NULL THEN s.home_win ELSE t.home_win END AS home_win,
  CASE WHEN s.game_id IS NOT NULL THEN s.went_to_ot ELSE t.went_to_ot END AS went_to_ot FROM t LEFT JOIN s ON t.game_id = s.game_id""")
def merge_update_only(v: Views):
    """Only existing keys change."""
    return M.update_only(*_pair(v), ["game_id"])


@query("closing_update", f"""WITH c AS (SELECT game_id, book, home_ml + 5 AS h, away_ml - 5 AS a FROM quotes WHERE book > 1)
SELECT q.game_id, q.book, q.home_ml, c.h AS close_home_ml, {r(
    "round_even(round(" + _RAW.format('c.h') + ", 4) / (round(" + _RAW.format('c.h') + ", 4) + round(" + _RAW.format('c.a') + ", 4)), 4)", "close_home_prob")}
FROM quotes q LEFT JOIN c ON q.game_id = c.game_id AND q.book = c.book""")
def closing_update(v: Views):
    """Closing lines and their fair probabilities written onto stored odds."""
    stored = v.quotes.select("game_id", "book", "home_ml", F.lit(None).cast("bigint").alias("close_home_ml"),
                             F.lit(None).cast("double").alias("close_home_prob"))
    h, a = F.col("home_ml") + 5, F.col("away_ml") - 5
    fresh = v.quotes.where("book > 1").select(
        "game_id", "book", h.alias("close_home_ml"), fair_pair(h, a, round_first=True, digits=4)[0].alias("close_home_prob"))
    return rounded(M.update_only(stored, fresh, ["game_id", "book"]))


@query("log_keep_latest", """WITH both_rows AS (SELECT home_id AS game_id, model_name, game_id AS run, prob_home_win, 0 AS seq FROM preds WHERE season < 2000
  UNION ALL SELECT home_id, model_name, game_id, prob_home_win, 1 FROM preds WHERE season >= 1999)
SELECT game_id, model_name, run, """ + r("prob_home_win") + """ FROM (SELECT *, row_number() OVER (PARTITION BY game_id, model_name ORDER BY run DESC, seq DESC) AS k
  FROM both_rows) WHERE k = 1""")
def log_keep_latest(v: Views):
    """Append a batch and keep the newest row per (event, model)."""
    rows = v.preds.select(F.col("home_id").alias("game_id"), "model_name", F.col("game_id").alias("run"), "prob_home_win", "season")
    return rounded(M.keep_latest(rows.where("season < 2000").drop("season"), rows.where("season >= 1999").drop("season"),
                                 ["game_id", "model_name"], "run"))


@query("incremental_sync", """WITH known AS (SELECT * FROM matches WHERE game_date < DATE '2001-02-01'),
bound AS (SELECT coalesce(greatest(DATE '2001-01-01', max(game_date) - 7), DATE '2001-01-01') AS since FROM known
  WHERE home_win IS NOT NULL AND game_date >= DATE '2001-01-01'),
fresh AS (SELECT m.* FROM matches m, bound WHERE m.game_date >= since AND game_state IN ('OFF', 'FINAL', 'OVER'))
SELECT coalesce(k.game_id, f.game_id) AS game_id, coalesce(f.home_score, k.home_score) AS home_score, coalesce(f.home_win, k.home_win) AS home_win
FROM known k FULL JOIN fresh f ON k.game_id = f.game_id""")
def incremental_sync(v: Views):
    """Catch up from a week before the newest result and merge."""
    cols = ["game_id", "game_date", "home_score", "home_win"]
    known = v.matches.where("game_date < DATE '2001-02-01'").select(*cols)
    since = M.catch_up_start(known, date(2001, 1, 1))
    fresh = M.finished(v.matches.where(F.col("game_date") >= F.lit(since)), S.FINAL_STATES).select(*cols)
    return M.upsert(known, fresh, ["game_id"], "coalesce").select("game_id", "home_score", "home_win")


@query("dedupe_first", """SELECT home_id, away_id, game_id, game_date FROM (SELECT *, row_number() OVER (PARTITION BY home_id, away_id
  ORDER BY game_date, game_id) AS k FROM matches) WHERE k = 1""")
def dedupe_first(v: Views):
    """First meeting of each ordered pair."""
    return M.oldest(v.matches.select("home_id", "away_id", "game_id", "game_date"), ["home_id", "away_id"], ["game_date", "game_id"])


@query("union_sources", """SELECT source, count(*) AS n, count(DISTINCT entity) AS entities FROM (
  SELECT 'home' AS source, home_id AS entity FROM matches UNION ALL SELECT 'away', away_id FROM matches
  UNION ALL SELECT 'skater', player_id FROM player_games) GROUP BY source""")
def union_sources(v: Views):
    """Several sources stacked by name."""
    home = v.matches.select(F.lit("home").alias("source"), F.col("home_id").alias("entity"))
    away = v.matches.select(F.lit("away").alias("source"), F.col("away_id").alias("entity"))
    skater = X.player_games(v.shots).select(F.lit("skater").alias("source"), F.col("player_id").alias("entity"))
    return home.unionByName(away).unionByName(skater).groupBy("source").agg(
        F.count("*").alias("n"), F.countDistinct("entity").alias("entities"))


@query("topn_threshold", f"""SELECT player_id, {r("expected")}, n FROM (SELECT player_id, round(avg(sog), 2) AS expected, count(*) AS n FROM player_games
  GROUP BY player_id) WHERE expected >= 0.5 ORDER BY expected DESC, player_id LIMIT 50""")
def topn_threshold(v: Views):
    """The fifty largest projections above a minimum."""
    rows = X.player_games(v.shots).groupBy("player_id").agg(F.round(F.avg("sog"), 2).alias("expected"), F.count("*").alias("n"))
    return rounded(top_projections(rows, "expected", 0.5, 50, ["player_id"]))


@query("leaderboard", f"""WITH t AS (SELECT team_id, {r("avg(won)", "rating")} FROM sides GROUP BY team_id),
top AS (SELECT *, row_number() OVER (ORDER BY rating DESC, team_id) AS place FROM t QUALIFY place <= 32)
SELECT place, team_id, rating, {r("avg(rating) OVER ()", "mean_rating")}, max(rating) OVER () AS top_rating, min(rating) OVER () AS bottom_rating FROM top""")
def leaderboard(v: Views):
    """Top 32 teams with rank, mean and range."""
    from foretrace.plans.reports import leaderboard as board

    ratings = v.sides.groupBy("team_id").agg(F.round(F.avg("won"), 6).alias("rating"))
    return rounded(board(ratings, "rating", 32))


@query("entity_recap", f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY season DESC, game_num DESC, game_id DESC) AS back FROM facts),
t AS (SELECT team_id, count(*) AS n_games, CAST(sum(won) AS BIGINT) AS wins, CAST(count(*) - sum(won) AS BIGINT) AS losses, {r("avg(goals_for)", "avg_gf")},
  {r("avg(goals_against)", "avg_ga")}, {r("avg(xgf_pct)", "avg_xgf_pct")} FROM k WHERE back <= 10 GROUP BY team_id),
s AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY season DESC, game_num DESC, game_id DESC) AS back FROM goalie_games WHERE is_starter),
l AS (SELECT team_id, goalie_id FROM s WHERE back = 1),
g AS (SELECT s.team_id, s.goalie_id, s.save_pct, row_number() OVER (PARTITION BY s.team_id ORDER BY season DESC, game_num DESC, game_id DESC) AS b
  FROM s JOIN l ON s.team_id = l.team_id AND s.goalie_id = l.goalie_id)
SELECT t.*, x.goalie_id, x.goalie_sv_pct_l10 FROM t LEFT JOIN (SELECT team_id, goalie_id, {r("avg(save_pct)", "goalie_sv_pct_l10")} FROM g WHERE b <= 10
  GROUP BY team_id, goalie_id) x ON t.team_id = x.team_id""")
def entity_recap(v: Views):
    """Last ten games of each team and its last starter's form."""
    from foretrace.plans.reports import entity_recap as recap

    return rounded(recap(team_facts(v), X.goalie_games(v.shots).where("is_starter"), 10))


@query("freshness_check", """WITH p AS (SELECT season, count(DISTINCT game_id) AS played FROM shots GROUP BY season),
d AS (SELECT season, count(*) AS dated FROM matches WHERE game_id % 3 > 0 GROUP BY season)
SELECT season, played, coalesce(dated, 0) AS dated, coalesce(dated, 0) < played AS stale FROM p LEFT JOIN d USING (season)""")
def freshness_check(v: Views):
    """Dated games against played games, per season."""
    from foretrace.plans.reports import freshness

    return freshness(v.shots, v.matches.where("game_id % 3 > 0"))

"""Composite queries: slates, projections and reports end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretrace.catalog.models import model_columns, model_rows, team_context
from foretrace.catalog.ratings import _CHAIN, _LAST
from foretrace.catalog.registry import RAW, query, r, rounded
from foretrace.catalog.scalars import division_table
from foretrace.catalog.scores import _SUMMARY, scored
from foretrace.catalog.tables import price_index
from foretrace.operators import facts as X
from foretrace.operators import features as Y
from foretrace.operators import forecasts as C
from foretrace.operators import models as M
from foretrace.plans import matrix as A
from foretrace.plans import projections as P
from foretrace.plans import reports as R
from foretrace.plans import slate as L
from foretrace.session import stored
from foretrace.sources.views import Views

# The slate is what is left of the newest season from the first of May on.
SEASON = "(SELECT max(season) FROM matches)"
DAY, OPENER = (f"make_date(CAST({SEASON} AS BIGINT), {m}, 1)" for m in (5, 1))


def _day(v: Views, month: int = 5):
    return F.lit(f"{v.newest_season}-{month:02d}-01").cast("date")


def _slate(v: Views):
    """Every game still to be played in the season, from the cut-off day on."""
    return v.matches.where((F.col("season") == v.newest_season) & (F.col("game_date") >= _day(v))).select(
        "game_id", "season", "home_id", "away_id")


def _slate_rows(v: Views):
    return L.slate_matrix(_slate(v), v.shots, v.matches, v.sides, v.newest_season, _day(v), _day(v, 1), row_bound=v.match_bound,
                          shot_bound=v.shot_bound, groups=division_table(v))


_SLATE = f"""slate AS (SELECT game_id, home_id, away_id FROM matches WHERE season = {SEASON} AND game_date >= {DAY}),
last AS (SELECT team_id, max(game_date) AS d FROM sides WHERE game_date < {DAY} GROUP BY team_id),
past AS (SELECT least(home_id, away_id) AS a, greatest(home_id, away_id) AS b, home_win,
  row_number() OVER (PARTITION BY least(home_id, away_id), greatest(home_id, away_id) ORDER BY game_date DESC, game_id DESC) AS k
  FROM matches WHERE game_date < {DAY}),
rate AS (SELECT a, b, avg(home_win) AS w FROM past WHERE k <= 3 GROUP BY a, b)"""


_NEWEST = f"season = {SEASON}"
_BEFORE = f"game_id IN (SELECT game_id FROM matches WHERE game_date < {DAY})"
_BACK = "row_number() OVER (PARTITION BY {} ORDER BY season DESC, game_num DESC, game_id DESC) AS k"


@query("slate_features", f"""WITH {_CHAIN.replace("FROM matches),", f"FROM matches WHERE game_date < {DAY}),", 1)}, {_SLATE},
form AS (SELECT team_id, avg(won) FILTER (k <= 5) AS won5, avg(xgf_pct) FILTER (k <= 10) AS xgf10, count(*) AS gp
  FROM (SELECT *, {_BACK.format("team_id")} FROM facts WHERE {_NEWEST} AND {_BEFORE}) GROUP BY team_id),
starts AS (SELECT *, {_BACK.format("team_id")}, row_number() OVER (PARTITION BY goalie_id ORDER BY season DESC, game_num DESC, game_id DESC) AS g
  FROM goalie_games WHERE is_starter AND {_BEFORE}),
votes AS (SELECT team_id, goalie_id, count(*) AS n, min(k) AS newest FROM starts WHERE k <= 10 GROUP BY ALL),
best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY n DESC, newest) = 1),
keeper AS (SELECT b.team_id, avg(s.save_pct) AS sv5 FROM best b JOIN starts s ON b.goalie_id = s.goalie_id AND s.g <= 5 GROUP BY b.team_id),
power AS (SELECT team_id, avg(pp_xg) AS pp10 FROM (SELECT *, {_BACK.format("team_id")} FROM st_games WHERE {_NEWEST} AND {_BEFORE}) WHERE k <= 10 GROUP BY team_id),
ended AS (SELECT c.* FROM chain c JOIN (SELECT league, max(rn) AS rn FROM played GROUP BY league) m ON c.league = m.league AND c.rn = m.rn),
rated AS (SELECT s.team_id, CASE WHEN e.{_NEWEST} THEN e.post[s.team_id % 16 + 1] ELSE e.post[s.team_id % 16 + 1] * (1 - 0.33) + 1500 * 0.33 END AS elo
  FROM ended e JOIN (SELECT DISTINCT league, team_id FROM sides WHERE game_date < {DAY}) s ON e.league = s.league)
SELECT s.game_id, {r('h.won5', 'home_won_l5')}, {r('a.won5', 'away_won_l5')}, {r('h.won5 - a.won5', 'diff_won_l5')}, {r('h.xgf10 - a.xgf10', 'diff_xgf_pct_l10')},
  coalesce(h.gp, 0) AS home_games_played, {r('k.sv5', 'home_g_save_pct_l5')}, {r('hp.pp10 - ap.pp10', 'diff_st_pp_xg_l10')},
  CAST(date_diff('day', hl.d, {DAY}) AS BIGINT) AS home_rest_days,
  CAST(coalesce(date_diff('day', hl.d, {DAY}), 2) - coalesce(date_diff('day', al.d, {DAY}), 2) AS BIGINT) AS rest_advantage,
  CAST(date_diff('day', {OPENER}, {DAY}) AS BIGINT) AS season_day, {r('rate.w', 'h2h_home_win_rate_l3')}, {r('he.elo - ae.elo', 'diff_elo')}
FROM slate s LEFT JOIN form h ON s.home_id = h.team_id LEFT JOIN form a ON s.away_id = a.team_id LEFT JOIN keeper k ON s.home_id = k.team_id
LEFT JOIN power hp ON s.home_id = hp.team_id LEFT JOIN power ap ON s.away_id = ap.team_id
LEFT JOIN last hl ON s.home_id = hl.team_id LEFT JOIN last al ON s.away_id = al.team_id
LEFT JOIN rate ON rate.a = least(s.home_id, s.away_id) AND rate.b = greatest(s.home_id, s.away_id)
LEFT JOIN rated he ON s.home_id = he.team_id LEFT JOIN rated ae ON s.away_id = ae.team_id""")
def slate_features(v: Views):
    """Snapshots of every family on both sides of the scheduled games."""
    cols = ["home_won_l5", "away_won_l5", "diff_won_l5", "diff_xgf_pct_l10", "home_games_played", "home_g_save_pct_l5",
            "diff_st_pp_xg_l10", "home_rest_days", "rest_advantage", "season_day", "h2h_home_win_rate_l3", "diff_elo"]
    return rounded(_slate_rows(v).select("game_id", *cols))


@query("slate_openers", f"""WITH {_CHAIN}, {_LAST}, day AS (SELECT min(game_date) AS d FROM matches WHERE season = (SELECT max(season) FROM matches)),
before AS (SELECT * FROM chain WHERE rn > 0 AND game_id IN (SELECT game_id FROM matches, day WHERE game_date < d)),
newest AS (SELECT b.* FROM before b JOIN (SELECT league, max(rn) AS rn FROM before GROUP BY league) m ON b.league = m.league AND b.rn = m.rn),
entered AS (SELECT s.team_id, n.post[s.team_id % 16 + 1] * (1 - 0.33) + 1500 * 0.33 AS elo FROM newest n
  JOIN (SELECT DISTINCT league, team_id FROM sides, day WHERE game_date < d) s ON n.league = s.league)
SELECT m.game_id, CAST(0 AS BIGINT) AS home_games_played, CAST(0 AS BIGINT) AS away_games_played, CAST(NULL AS DOUBLE) AS home_won_l5,
  {r('h.elo', 'home_elo')}, {r('a.elo', 'away_elo')}, TRUE AS season_opener, h.elo IS NOT NULL AND a.elo IS NOT NULL AS usable
FROM matches m JOIN day ON m.game_date = day.d LEFT JOIN entered h ON m.home_id = h.team_id LEFT JOIN entered a ON m.away_id = a.team_id""")
def slate_openers(v: Views):
    """The newest season's opening day: no form yet, ratings carried over, openers flagged."""
    season = v.matches.agg(F.max("season")).first()[0]
    day = F.lit(v.matches.where(F.col("season") == season).agg(F.min("game_date")).first()[0])
    slate = v.matches.where(F.col("game_date") == day).select("game_id", "season", "home_id", "away_id")
    rows = L.slate_matrix(slate, v.shots, v.matches, v.sides, season, day, day, row_bound=v.match_bound, shot_bound=v.shot_bound)
    guarded = L.publish_guard(rows.withColumn("feature_coverage", F.lit(0.0)))
    return rounded(guarded.select("game_id", "home_games_played", "away_games_played", "home_won_l5", "home_elo", "away_elo", "season_opener", "usable"))


@query("slate_context", f"""WITH {_SLATE}
SELECT s.game_id, CAST(date_diff('day', h.d, {DAY}) AS BIGINT) AS home_rest_days, CAST(date_diff('day', a.d, {DAY}) AS BIGINT) AS away_rest_days,
  CAST(coalesce(date_diff('day', h.d, {DAY}) = 1, FALSE) AS BIGINT) AS home_back_to_back,
  CAST(coalesce(date_diff('day', h.d, {DAY}), 2) - coalesce(date_diff('day', a.d, {DAY}), 2) AS BIGINT) AS rest_advantage,
  CAST(date_diff('day', {OPENER}, {DAY}) AS BIGINT) AS season_day, {r('w', 'h2h_home_win_rate_l3')}
FROM slate s LEFT JOIN last h ON s.home_id = h.team_id LEFT JOIN last a ON s.away_id = a.team_id
LEFT JOIN rate ON rate.a = least(s.home_id, s.away_id) AND rate.b = greatest(s.home_id, s.away_id)""")
def slate_context(v: Views):
    """Rest, season day and head-to-head of the scheduled games."""
    out = L.slate_context(_slate(v), v.sides, v.matches, _day(v), _day(v, 1))
    return rounded(out.select("game_id", "home_rest_days", "away_rest_days", "home_back_to_back", "rest_advantage",
                              "season_day", "h2h_home_win_rate_l3"))


@query("slate_scoring")
def slate_scoring(v: Views):
    """Train on the past, score the scheduled games, guard, price and stamp."""
    train = model_rows(v).where(F.col("season") < v.newest_season)
    fit = M.fit_classifier(train, model_columns(v), "logistic")
    out = L.score_slate(_slate_rows(v), fit, v.matches, price_index(v), _day(v), "logistic", F.lit(f"{v.newest_season}-05-01T12:00:00Z"))
    return rounded(out.select("game_id", "model_name", "prob_home_win", "market_prob_home", "feature_coverage", "season_opener"))


@query("player_projections")
def player_projections(v: Views):
    """Expected shots of a roster against its next opponents."""
    columns = [*A.SOG_OWN, *[f"opp_{c}" for c in A.OPP_DEFENCE]]
    context = stored(team_context(v).select("team_id", *Y.CAREER, *A.OPP_DEFENCE), "context")
    rows = stored(A.sog_training(v.shots, v.matches, context, None, v.shot_bound).select("game_id", "season", "sog", *columns))
    fit, _ = M.fit_counts(rows, columns, "sog")
    slate = v.sides.where(F.col("season") == v.newest_season).groupBy("team_id").agg(
        F.max_by("opp_id", F.struct("game_num", "game_id")).alias("opp_id"))
    players = X.player_games(v.shots)
    roster = players.select("player_id", "team_id").distinct().join(slate, "team_id").withColumn(
        "player_name", F.concat(F.lit("Player "), F.col("player_id").cast("string"))).withColumn("position", F.lit("F"))
    opponents = context.groupBy(F.col("team_id").alias("opp_id")).agg(*[
        F.max_by(c, F.struct(*Y.CAREER)).alias(f"opp_{c}") for c in A.OPP_DEFENCE])
    scratched = players.where("player_id % 11 = 0").select("player_id").distinct()
    out = P.player_projections(players, roster, scratched, opponents, fit, min_sog=0.2, row_bound=v.shot_bound)
    return rounded(out.select("player_id", "team_id", "opp_id", "games_played", "sog_l10", "expected", "feature_coverage"))


@query("goalie_projections")
def goalie_projections(v: Views):
    """Expected saves and P(over) of probable starters."""
    context = stored(team_context(v).select("team_id", *Y.CAREER, *dict.fromkeys([*A.OWN_TEAM, *A.OPP_TEAM])), "context")
    columns = [*Y.rolling_columns(Y.GOALIE_PROP_STATS, Y.GOALIE_PROP_WINDOWS), "is_home",
               *[f"own_{c}" for c in A.OWN_TEAM], *[f"opp_{c}" for c in A.OPP_TEAM]]
    rows = stored(A.saves_training(v.shots, v.matches, context, v.shot_bound).select("game_id", "season", "saves", *columns))
    fit, _ = M.fit_counts(rows, columns, "saves")
    fitted = M.predict_counts(fit, rows).select(F.col("saves").cast("double").alias("y"), "pred")
    dispersion = C.nb_dispersion(fitted).first()[0]
    slate = v.sides.where(F.col("season") == v.newest_season).groupBy("team_id").agg(
        F.max_by(F.struct("opp_id", "is_home"), F.struct("game_num", "game_id")).alias("g")).select(
        "team_id", "g.opp_id", F.col("g.is_home").cast("double").alias("is_home"))
    newest = context.groupBy("team_id").agg(
        *[F.max_by(c, F.struct(*Y.CAREER)).alias(f"own_{c}") for c in A.OWN_TEAM],
        *[F.max_by(c, F.struct(*Y.CAREER)).alias(f"opp_{c}") for c in A.OPP_TEAM])
    factor = P.in_season_factor(fit, rows, "saves", v.newest_season)
    out = P.saves_projections(X.goalie_games(v.shots), slate, newest, fit, [0.5, 1.5, 2.5], dispersion, factor, row_bound=v.shot_bound)
    return rounded(out.select("goalie_id", "team_id", "opp_id", "starts", "starter_basis", "in_season_factor", "expected", "p_over_0_5", "p_over_1_5", "p_over_2_5"))


@query("history_report", f"SELECT model_name, {_SUMMARY} FROM scored GROUP BY model_name")
def history_report(v: Views):
    """The summary part of the history report, per model."""
    return rounded(R.history_report(scored(v), ["game_date", "game_id"])["summary"])


def _by_model(name: str) -> str:
    """The SQL of a report per model."""
    sql = RAW[name].replace("SELECT ", "SELECT model_name, ")
    return sql.replace("GROUP BY 1", "GROUP BY ALL") if "GROUP BY 1" in sql else f"{sql} GROUP BY ALL"


def _history(part: str):
    def run(v: Views):
        return rounded(R.history_report(scored(v), ["game_date", "game_id"])[part])

    run.__doc__ = f"The {part} part of the history report."
    return run


for _part, _sql in {
    "by_season": f"SELECT model_name, season, {_SUMMARY} FROM scored GROUP BY model_name, season", "calibration": _by_model("calibration_table"),
    "tiers": _by_model("tier_breakdown"), "market": _by_model("market_comparison"), "edges": _by_model("edge_realization"),
    "clv": _by_model("clv_summary"), "recent": RAW["recent_form"], "coverage": RAW["coverage_stats"],
}.items():
    query(f"history_{_part}", _sql)(_history(_part))


def _edge_frames(v: Views):
    newest = F.col("season") == v.newest_season
    return v.preds.where(newest), scored(v).where(~newest)


@query("edge_report_edges", RAW["edge_ranking"] + f" AND season = {SEASON}")
def edge_report_edges(v: Views):
    """The ranked edges of the edge report."""
    return rounded(R.edge_report(*_edge_frames(v))["edges"])


@query("edge_report_realization", RAW["edge_realization"].replace("GROUP BY 1", f"AND season < {SEASON} GROUP BY 1"))
def edge_report_realization(v: Views):
    """What earlier edges of the edge report came to."""
    return rounded(R.edge_report(*_edge_frames(v))["realization"])


@query("night_games", RAW["day_report"])
def night_games(v: Views):
    """Every pick of the newest played night, from the day report."""
    return rounded(R.day_report(scored(v))["games"])


@query("night_market", RAW["market_comparison"] + " AND game_date = (SELECT max(game_date) FROM scored WHERE actual_home_win IS NOT NULL)")
def night_market(v: Views):
    """Model and market on the newest played night."""
    return rounded(R.day_report(scored(v))["market"])


@query("edge_report", f"""SELECT count(*) AS n, {r("avg(CASE WHEN prob_home_win >= 0.5 THEN closing_prob_home - market_prob_home ELSE market_prob_home - closing_prob_home END)", "mean_clv")},
  {r("avg(CAST(CASE WHEN prob_home_win >= 0.5 THEN closing_prob_home - market_prob_home ELSE market_prob_home - closing_prob_home END > 0 AS DOUBLE))", "beat_close_rate")}
  FROM scored WHERE actual_home_win IS NOT NULL AND closing_prob_home IS NOT NULL AND market_prob_home IS NOT NULL AND season < {SEASON}""")
def edge_report(v: Views):
    """What earlier edges were worth, beside tonight's ranking."""
    return rounded(R.edge_report(*_edge_frames(v))["clv"])


@query("night_summary", f"""SELECT {_SUMMARY} FROM scored
  WHERE game_date = (SELECT max(game_date) FROM scored WHERE actual_home_win IS NOT NULL)""")
def night_summary(v: Views):
    """Record of the newest played night."""
    return rounded(R.day_report(scored(v))["summary"])

"""Queries over model tables, folds and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretrace.catalog.ratings import _CHAIN
from foretrace.catalog.registry import RAW, query, r, rounded
from foretrace.catalog.scalars import division_table
from foretrace.catalog.windows import CAREER_SQL, W1, _avg, team_facts
from foretrace.operators import features as Y
from foretrace.operators import forecasts as C
from foretrace.operators import models as M
from foretrace.operators import trials as T
from foretrace.operators.history import Decayed, Total, with_history
from foretrace.operators import scoring as E
from foretrace.plans import matrix as A
from foretrace.session import fresh_path, stored
from foretrace.sources.views import Views


@query("walk_forward_assign", """WITH s AS (SELECT season, row_number() OVER (ORDER BY season) - 1 AS i FROM (SELECT DISTINCT season FROM matches)),
f AS (SELECT t.i AS fold, t.season AS test_season, u.season FROM s t JOIN s u ON u.i <= t.i WHERE t.i > 0)
SELECT fold, test_season, CASE WHEN m.season = test_season THEN 'test' ELSE 'train' END AS role, count(*) AS n, count(home_win) AS n_known
FROM matches m JOIN f USING (season) GROUP BY ALL""")
def walk_forward_assign(v: Views):
    """Rows per fold and role."""
    return M.walk_forward(v.matches).groupBy("fold", "test_season", "role").agg(
        F.count("*").alias("n"), F.count("home_win").alias("n_known"))


@query("oof_chunks", """WITH p AS (SELECT game_id, row_number() OVER (ORDER BY season, game_num, game_id) - 1 AS position, count(*) OVER () AS n FROM matches)
SELECT game_id, least(position // (n // 3), 2) AS chunk FROM p""")
def oof_chunks(v: Views):
    """Three contiguous chunks in time order."""
    return M.oof_chunks(v.matches, ["season", "game_num", "game_id"], 3, v.rows("orders")).select("game_id", "chunk")


@query("ensemble_mean", f"""SELECT game_id, {r("(prob_home_win + market_prob_home + 0.5) / 3", "prob")}, CAST(3 AS BIGINT) AS n_models FROM preds""")
def ensemble_mean(v: Views):
    """Mean of three forecasts per game."""
    one = v.preds.select("game_id", F.col("prob_home_win").alias("prob"))
    two = v.preds.select("game_id", F.col("market_prob_home").alias("prob"))
    return rounded(M.ensemble_mean([one, two, v.preds.select("game_id", F.lit(0.5).alias("prob"))]))


_IMPUTED = ["xg_for", "xg_against", "goals_against", "sf_pct"]


@query("impute_means", "SELECT season, " + ", ".join(r(f"avg({c})", c) for c in _IMPUTED) + " FROM facts GROUP BY season")
def impute_means(v: Views):
    """Training means per season."""
    return rounded(M.impute_means(team_facts(v), _IMPUTED, ["season"]))


_PCAR, _GCAR = CAREER_SQL.format(key="player_id"), CAREER_SQL.format(key="goalie_id")
_OPP_CTE = "tf AS (SELECT game_id, team_id, " + ", ".join(
    _avg(s, 20, W1) for s in ("sf_pct", "xg_against", "hd_chances_against", "xg_for", "hd_chances_for")) + " FROM facts)"


def team_context(v: Views):
    stats = ["sf_pct", "xg_against", "hd_chances_against", "xg_for", "hd_chances_for"]
    return with_history(team_facts(v), Y.BY_SEASON, Y.IN_SEASON, Y.rolling(stats, [20]), v.match_bound)


@query("sog_training", f"""WITH {_OPP_CTE}, p AS (SELECT game_id, player_id, team_id, sog, {_avg("sog", 10, _PCAR)}, {_avg("xg", 20, _PCAR)},
  row_number() OVER ({_PCAR}) - 1 AS games_played FROM player_games)
SELECT p.game_id, p.player_id, p.team_id, p.sog, p.sog_l10, p.xg_l20, p.games_played,
  t.sf_pct_l20 AS opp_sf_pct_l20, t.xg_against_l20 AS opp_xg_against_l20, t.hd_chances_against_l20 AS opp_hd_chances_against_l20
FROM p JOIN matches m ON p.game_id = m.game_id LEFT JOIN tf t ON p.game_id = t.game_id
  AND t.team_id = CASE WHEN p.team_id = m.home_id THEN m.away_id ELSE m.home_id END WHERE p.games_played >= 5 AND p.player_id > 0""")
def sog_training(v: Views):
    """Shot-model training rows."""
    return rounded(A.sog_training(v.shots, v.matches, team_context(v), None, v.shot_bound).select(
        "game_id", "player_id", "team_id", "sog", "sog_l10", "xg_l20", "games_played", *[f"opp_{c}" for c in A.OPP_DEFENCE]))


@query("saves_training", f"""WITH {_OPP_CTE}, g AS (SELECT game_id, goalie_id, team_id, saves, {_avg("saves", 10, _GCAR)}, {_avg("gsax", 20, _GCAR)},
  row_number() OVER ({_GCAR}) - 1 AS starts FROM goalie_games WHERE is_starter)
SELECT g.game_id, g.goalie_id, g.saves, g.saves_l10, g.gsax_l20, g.starts, CAST(g.team_id = m.home_id AS DOUBLE) AS is_home,
  o.sf_pct_l20 AS own_sf_pct_l20, o.xg_against_l20 AS own_xg_against_l20, o.hd_chances_against_l20 AS own_hd_chances_against_l20,
  t.xg_for_l20 AS opp_xg_for_l20, t.hd_chances_for_l20 AS opp_hd_chances_for_l20, t.sf_pct_l20 AS opp_sf_pct_l20
FROM g JOIN matches m ON g.game_id = m.game_id LEFT JOIN tf o ON g.game_id = o.game_id AND g.team_id = o.team_id
LEFT JOIN tf t ON g.game_id = t.game_id AND t.team_id = CASE WHEN g.team_id = m.home_id THEN m.away_id ELSE m.home_id END WHERE g.starts >= 5""")
def saves_training(v: Views):
    """Saves-model training rows."""
    return rounded(A.saves_training(v.shots, v.matches, team_context(v), v.shot_bound).select(
        "game_id", "goalie_id", "saves", "saves_l10", "gsax_l20", "starts", "is_home",
        *[f"own_{c}" for c in A.OWN_TEAM], *[f"opp_{c}" for c in A.OPP_TEAM]))


_SHOWN = ["home_won_l5", "away_won_l5", "diff_xgf_pct_l10", "home_goals_for_l20", "away_games_played", "home_regulation_win_l10",
          "home_won_vs_strong_l20", "diff_goal_diff_vs_weak_l20", "home_g_save_pct_l5", "away_g_gsax_l10", "diff_st_pp_xg_l10",
          "home_rest_days", "away_back_to_back", "rest_advantage", "season_day", "h2h_home_win_rate_l3", "same_division",
          "home_elo", "diff_elo", "target"]


def _weak(stat: str, flag: int) -> str:
    x = f"CASE WHEN opp_is_strong = {flag} THEN {stat} END"
    over = f"OVER ({W1} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) {over} >= 3 THEN avg({x}) {over} END"


def _p(stat, w):
    return f"avg({stat}) OVER ({W1} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


_MATRIX = f"""WITH {_CHAIN},
elo AS (SELECT game_id, pre[h] AS home_elo, pre[a] AS away_elo FROM chain WHERE rn > 0),
rated AS (SELECT f.*, CAST(coalesce(CASE WHEN f.is_home THEN e.away_elo ELSE e.home_elo END >= 1500, FALSE) AS BIGINT) AS opp_is_strong
  FROM facts f LEFT JOIN elo e ON f.game_id = e.game_id),
tf AS (SELECT game_id, team_id, is_home, won, {_p('won', 5)} AS won_l5, {_p('xgf_pct', 10)} AS xgf_pct_l10, {_p('goals_for', 20)} AS goals_for_l20,
  {_p('regulation_win', 10)} AS regulation_win_l10, row_number() OVER ({W1}) - 1 AS games_played,
  {_weak('won', 1)} AS won_vs_strong_l20, {_weak('goal_diff', 0)} AS goal_diff_vs_weak_l20 FROM rated),
gf AS (SELECT game_id, team_id, avg(save_pct) OVER ({_GCAR} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS save_pct_l5,
  avg(gsax) OVER ({_GCAR} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS gsax_l10 FROM goalie_games WHERE is_starter),
sf AS (SELECT game_id, team_id, {_p('pp_xg', 10)} AS pp_xg_l10 FROM st_games),
rest AS (SELECT game_id, team_id, is_home, CAST(date_diff('day', lag(game_date) OVER (PARTITION BY team_id ORDER BY game_date, game_id), game_date) AS BIGINT) AS days FROM sides),
opener AS (SELECT season, min(game_date) AS d FROM matches GROUP BY season),
h2h AS (SELECT game_id, avg(home_win) OVER (PARTITION BY least(home_id, away_id), greatest(home_id, away_id) ORDER BY game_date, game_id
  ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS w FROM matches),
groups AS (SELECT DISTINCT c_custkey // 16 AS team_id, (c_custkey // 16) % 8 AS division FROM customer WHERE (c_custkey // 16) % 13 > 0)
SELECT m.game_id, {r('h.won_l5', 'home_won_l5')}, {r('a.won_l5', 'away_won_l5')}, {r('h.xgf_pct_l10 - a.xgf_pct_l10', 'diff_xgf_pct_l10')},
  {r('h.goals_for_l20', 'home_goals_for_l20')}, a.games_played AS away_games_played, {r('h.regulation_win_l10', 'home_regulation_win_l10')},
  {r('h.won_vs_strong_l20', 'home_won_vs_strong_l20')}, {r('h.goal_diff_vs_weak_l20 - a.goal_diff_vs_weak_l20', 'diff_goal_diff_vs_weak_l20')},
  {r('hg.save_pct_l5', 'home_g_save_pct_l5')}, {r('ag.gsax_l10', 'away_g_gsax_l10')}, {r('hs.pp_xg_l10 - sa.pp_xg_l10', 'diff_st_pp_xg_l10')},
  hr.days AS home_rest_days, CAST(coalesce(ar.days = 1, FALSE) AS BIGINT) AS away_back_to_back, coalesce(hr.days, 2) - coalesce(ar.days, 2) AS rest_advantage,
  CAST(date_diff('day', o.d, m.game_date) AS BIGINT) AS season_day, {r('x.w', 'h2h_home_win_rate_l3')},
  CAST(coalesce(gh.division = ga.division, FALSE) AS BIGINT) AS same_division, {r('e.home_elo', 'home_elo')}, {r('e.home_elo - e.away_elo', 'diff_elo')}, h.won AS target
FROM matches m JOIN tf h ON m.game_id = h.game_id AND h.is_home JOIN tf a ON m.game_id = a.game_id AND NOT a.is_home
LEFT JOIN gf hg ON m.game_id = hg.game_id AND m.home_id = hg.team_id LEFT JOIN gf ag ON m.game_id = ag.game_id AND m.away_id = ag.team_id
LEFT JOIN sf hs ON m.game_id = hs.game_id AND m.home_id = hs.team_id LEFT JOIN sf sa ON m.game_id = sa.game_id AND m.away_id = sa.team_id
JOIN rest hr ON m.game_id = hr.game_id AND hr.is_home JOIN rest ar ON m.game_id = ar.game_id AND NOT ar.is_home
JOIN opener o ON m.season = o.season JOIN h2h x ON m.game_id = x.game_id JOIN elo e ON m.game_id = e.game_id
LEFT JOIN groups gh ON m.home_id = gh.team_id LEFT JOIN groups ga ON m.away_id = ga.team_id"""


def matrix_of(v: Views):
    return A.feature_matrix(v.shots, v.matches, v.sides, division_table(v), row_bound=v.match_bound, shot_bound=v.shot_bound)


@query("feature_matrix", _MATRIX)
def feature_matrix(v: Views):
    """The full per-game matrix; twenty of its columns are shown."""
    return rounded(matrix_of(v).select("game_id", *_SHOWN))


def _in_sql(f) -> str:
    """A team feature as a window over numbered, rated facts."""
    if isinstance(f, Total):
        return f"row_number() OVER ({W1}) - 1 AS {f.name}"
    if isinstance(f, Decayed):
        over = "OVER (PARTITION BY team_id, season ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        weight = f"power(2.0, rn / {float(f.half_life)})"
        return f"sum({f.source} * {weight}) {over} / sum(CASE WHEN {f.source} IS NOT NULL THEN {weight} END) {over} AS {f.name}"
    over = f"OVER ({W1} ROWS BETWEEN {f.window} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({f.source}) {over} >= {f.min_count} THEN avg({f.source}) {over} END AS {f.name}"


_TEAM = [*Y.team_feature_list(), *Y.strength_feature_list()]


def _three(c: str, prefix: str = "", diff: bool = True, h: str = "h", a: str = "a") -> list[str]:
    if c == "games_played":
        return [f"{h}.{c} AS home_{c}", f"{a}.{c} AS away_{c}", f"{h}.{c} - {a}.{c} AS diff_{c}"]
    out = [r(f"{h}.{c}", f"home_{prefix}{c}"), r(f"{a}.{c}", f"away_{prefix}{c}")]
    return [*out, r(f"{h}.{c} - {a}.{c}", f"diff_{prefix}{c}")] if diff else out


_WIDE = [x for f in _TEAM for x in _three(f.name)] + [x for c in A.GOALIE for x in _three(c, "g_", False, "hg", "ag")] + [
    x for c in A.SPECIAL for x in _three(c, "st_", True, "hs", "sa")]


@query("matrix_columns", f"""WITH {_CHAIN}, elo AS (SELECT game_id, pre[h] AS home_elo, pre[a] AS away_elo FROM chain WHERE rn > 0),
rated AS MATERIALIZED (SELECT f.*, CAST(coalesce(CASE WHEN f.is_home THEN e.away_elo ELSE e.home_elo END >= 1500, FALSE) AS BIGINT) AS opp_is_strong
  FROM (SELECT *, row_number() OVER ({W1}) AS rn FROM facts) f LEFT JOIN elo e ON f.game_id = e.game_id),
tf AS MATERIALIZED (SELECT game_id, is_home, won AS result, {", ".join(_in_sql(f) for f in _TEAM)} FROM rated),
gf AS MATERIALIZED (SELECT game_id, team_id, {", ".join(f"avg({s}) OVER ({_GCAR} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS {s}_l{w}" for s in Y.GOALIE_FORM_STATS for w in Y.GOALIE_FORM_WINDOWS)}
  FROM goalie_games WHERE is_starter),
sf AS MATERIALIZED (SELECT game_id, team_id, {", ".join(f"{_p(s, w)} AS {s}_l{w}" for s in Y.SPECIAL_STATS for w in Y.SPECIAL_WINDOWS)} FROM st_games)
SELECT m.game_id, {", ".join(_WIDE)}
FROM matches m JOIN tf h ON m.game_id = h.game_id AND h.is_home JOIN tf a ON m.game_id = a.game_id AND NOT a.is_home
LEFT JOIN gf hg ON m.game_id = hg.game_id AND m.home_id = hg.team_id LEFT JOIN gf ag ON m.game_id = ag.game_id AND m.away_id = ag.team_id
LEFT JOIN sf hs ON m.game_id = hs.game_id AND m.home_id = hs.team_id LEFT JOIN sf sa ON m.game_id = sa.game_id AND m.away_id = sa.team_id
WHERE h.result IS NOT NULL""")
def matrix_columns(v: Views):
    """Every team, goalie and special-teams column of the matrix."""
    names = [f"{side}_{f.name}" for f in _TEAM for side in ("home", "away", "diff")]
    names += [f"{side}_g_{c}" for c in A.GOALIE for side in ("home", "away")] + [f"{side}_st_{c}" for c in A.SPECIAL for side in ("home", "away", "diff")]
    return rounded(matrix_of(v).select("game_id", *names))


_WRITTEN: dict[tuple, str] = {}


def written(v: Views, name: str, build):
    """A table that several queries read, written to the shared folder once per session and data folder."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir, name)
    if key not in _WRITTEN:
        path = fresh_path(v.spark, name)
        # Hardly a mean comes twice: a large dictionary costs more than writing it, a small one keeps the columns of few values short.
        build(v).write.options(**{"parquet.dictionary.page.size": 1 << 16, "compression": "zstd"}).parquet(path)
        _WRITTEN[key] = path
    return v.spark.read.parquet(_WRITTEN[key])


def model_rows(v: Views):
    """The whole matrix: all its columns are offered to the fits."""
    return written(v, "matrix", matrix_of)


def model_columns(v: Views) -> list[str]:
    return M.feature_columns(model_rows(v))


def some_rows(v: Views):
    """The matrix for a query that reads it once: the written one if there is one, else only the columns asked for are made."""
    return model_rows(v) if (v.spark.sparkContext.applicationId, v.sf_dir, "matrix") in _WRITTEN else matrix_of(v)


# The matrix by family: the SQL of each is light, since only the strength family needs the rating chain.
_NAMED = Y.team_feature_list()
_HOME_AWAY = "FROM matches m JOIN facts hf ON m.game_id = hf.game_id AND hf.is_home AND hf.won IS NOT NULL JOIN facts af ON m.game_id = af.game_id AND NOT af.is_home"


def _family(v: Views, names):
    return rounded(some_rows(v).select("game_id", *names))


@query("matrix_team_columns", f"""WITH tf AS MATERIALIZED (SELECT game_id, is_home, won AS result, {", ".join(_in_sql(f) for f in _NAMED)}
  FROM (SELECT *, row_number() OVER ({W1}) AS rn FROM facts))
SELECT h.game_id, {", ".join(x for f in _NAMED for x in _three(f.name))}
FROM (SELECT * FROM tf WHERE is_home) h JOIN (SELECT * FROM tf WHERE NOT is_home) a ON h.game_id = a.game_id WHERE h.result IS NOT NULL""")
def matrix_team_columns(v: Views):
    """Form of both teams: rolling, decayed and venue means, and games played."""
    return _family(v, [f"{side}_{f.name}" for f in _NAMED for side in ("home", "away", "diff")])


@query("matrix_goalie_columns", f"""WITH gf AS MATERIALIZED (SELECT game_id, team_id, {", ".join(f"avg({s}) OVER ({_GCAR} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS {s}_l{w}" for s in Y.GOALIE_FORM_STATS for w in Y.GOALIE_FORM_WINDOWS)}
  FROM goalie_games WHERE is_starter)
SELECT m.game_id, {", ".join(x for c in A.GOALIE for x in _three(c, "g_", False, "hg", "ag"))}
{_HOME_AWAY} LEFT JOIN gf hg ON m.game_id = hg.game_id AND m.home_id = hg.team_id LEFT JOIN gf ag ON m.game_id = ag.game_id AND m.away_id = ag.team_id""")
def matrix_goalie_columns(v: Views):
    """Form of both starting goalies."""
    return _family(v, [f"{side}_g_{c}" for c in A.GOALIE for side in ("home", "away")])


@query("matrix_special_columns", f"""WITH sf AS MATERIALIZED (SELECT game_id, team_id, {", ".join(f"{_p(s, w)} AS {s}_l{w}" for s in Y.SPECIAL_STATS for w in Y.SPECIAL_WINDOWS)} FROM st_games)
SELECT m.game_id, {", ".join(x for c in A.SPECIAL for x in _three(c, "st_", True, "hs", "sa"))}
{_HOME_AWAY} LEFT JOIN sf hs ON m.game_id = hs.game_id AND m.home_id = hs.team_id LEFT JOIN sf sa ON m.game_id = sa.game_id AND m.away_id = sa.team_id""")
def matrix_special_columns(v: Views):
    """Special-teams form of both teams."""
    return _family(v, [f"{side}_st_{c}" for c in A.SPECIAL for side in ("home", "away", "diff")])


def _split(v: Views):
    """Rows before the newest season, and the newest season's."""
    rows = model_rows(v)
    newest = F.col("season") == v.newest_season
    return rows.where(~newest), rows.where(newest)


# Games that the fits see: both teams have facts and the result is known.
_PAIRED = f"SELECT m.*, hf.won AS target {_HOME_AWAY}"
# The features by their rule: every family on its sides, without games played, and what describes the game itself.
_FEATURES = [f"{side}_{f.name}" for f in _TEAM if f.name != "games_played" for side in ("home", "away", "diff")] + [
    f"{side}_g_{c}" for c in A.GOALIE for side in ("home", "away")] + [f"{side}_st_{c}" for c in A.SPECIAL for side in ("home", "away", "diff")] + [
    "home_rest_days", "away_rest_days", "rest_advantage", "home_back_to_back", "away_back_to_back", "season_day", "h2h_home_win_rate_l3",
    "same_division", "same_conference", "home_elo", "away_elo", "diff_elo"]
_PAST, _NEWEST = (f"season {op} (SELECT max(season) FROM matches)" for op in ("<", "="))


@query("logistic_identity", f"""SELECT count(target) AS n, {r('avg(target)', 'mean_target')}, TRUE AS calibrated FROM ({_PAIRED}) WHERE {_PAST}""")
def logistic_identity(v: Views):
    """With an intercept, a logistic fit's mean probability is the training rows' mean."""
    train = _split(v)[0].where(F.col("target").isNotNull())
    fitted = M.fit_classifier(train, model_columns(v), "logistic").score(train)
    return rounded(fitted.agg(F.count("*").alias("n"), F.avg("target").alias("mean_target"), (F.abs(F.avg("prob") - F.avg("target")) < 1e-3).alias("calibrated")))


@query("feature_names", f"SELECT unnest({_FEATURES}) AS feature, n FROM (SELECT count(target) AS n FROM ({_PAIRED}))")
def feature_names(v: Views):
    """The features of the matrix: numeric, neither identifiers nor targets nor how far a season has come."""
    rows = some_rows(v)
    names = F.array(*[F.lit(c) for c in M.feature_columns(rows)])
    return rows.agg(F.count("target").alias("n")).select(F.explode(names).alias("feature"), "n")


@query("feature_profile")
def feature_profile(v: Views):
    """Known values, mean and spread of every feature, summed in one pass."""
    rows = some_rows(v)
    names = M.feature_columns(rows)
    sums = rows.agg(*[x for c in names for x in (F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n_known"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("spread")) for c in names])
    return rounded(sums.select(F.explode(parts).alias("f")).select("f.*"))


@query("boosted_newest", f"SELECT game_id, CAST(target AS BIGINT) AS target, TRUE AS in_range FROM ({_PAIRED}) WHERE {_NEWEST}")
def boosted_newest(v: Views):
    """Boosted trees fitted on all features of the past score every game of the newest season."""
    train, test = _split(v)
    scored = M.fit_classifier(train, model_columns(v), "boost_shallow").score(test)
    return scored.select("game_id", F.col("target").cast("bigint").alias("target"), F.col("prob").between(0, 1).alias("in_range"))


@query("stacked_newest", f"SELECT game_id, CAST(target AS BIGINT) AS target, CAST(3 AS BIGINT) AS stack_chunks, TRUE AS in_range FROM ({_PAIRED}) WHERE {_NEWEST}")
def stacked_newest(v: Views):
    """A stack of two models over contiguous chunks scores every game of the newest season."""
    train, test = _split(v)
    scored = M.stack(train, test, model_columns(v), ["logistic", "forest"], ["season", "game_num", "game_id"])
    return scored.select("game_id", F.col("target").cast("bigint").alias("target"), "stack_chunks", F.col("prob").between(0, 1).alias("in_range"))


@query("saved_model_scores", f"SELECT count(*) AS n, count(*) AS n_same FROM ({_PAIRED}) WHERE {_NEWEST}")
def saved_model_scores(v: Views):
    """A saved and reloaded fit scores every row as before."""
    train, test = _split(v)
    fit, path = M.fit_classifier(train, model_columns(v), "logistic"), fresh_path(v.spark, "fit")
    M.save_fit(fit, path)
    again = M.load_fit(v.spark, path).score(test).select("game_id", F.col("prob").alias("again"))
    both = fit.score(test).select("game_id", "prob").join(again, "game_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("prob") - F.col("again")) < 1e-12).alias("n_same"))


# Numbers of features the selection tries; the last is all of them.
_SIZES = [20, 30, 50, 80, len(_FEATURES)]


def _swept(v: Views):
    train, test = _split(v)
    return T.sweep(train, test, model_columns(v), _SIZES, "forest")


@query("feature_sweep", f"SELECT size, size AS n_features, n AS n_scored FROM (SELECT unnest({_SIZES})::BIGINT AS size, n FROM (SELECT count(target) AS n FROM ({_PAIRED}) WHERE {_NEWEST}))")
def feature_sweep(v: Views):
    """How many of the best features are used by each size, ranked in the training seasons, and the games scored."""
    return written(v, "sweep", _swept).select("size", F.size("features").cast("bigint").alias("n_features"), "n_scored")


@query("feature_sweep_scores")
def feature_sweep_scores(v: Views):
    """Brier of each size with the features it takes, best first."""
    return rounded(written(v, "sweep", _swept).select("size", "brier", F.array_join("features", ",").alias("features")))


_TRIALS, _RUNGS = 50, 3


def _searched(v: Views):
    train, held = M.search_split(model_rows(v))
    return T.halving_search(train, held, model_columns(v), "forest", T.FOREST_SPACE, _TRIALS, rungs=_RUNGS)


@query("search_best", f"""SELECT rung::BIGINT AS rung, trials::BIGINT AS trials, survivors::BIGINT AS survivors, budget::BIGINT AS budget, n AS n_scored FROM (VALUES (0, 50, 17, 23), (1, 17, 6, 67), (2, 6, 1, 200)) t(rung, trials, survivors, budget),
(SELECT count(target) AS n FROM ({_PAIRED}) WHERE season = (SELECT max(season) FROM matches WHERE {_PAST}))""")
def search_best(v: Views):
    """Fifty trials of forests over the whole space: trials, survivors, trees and games scored at every rung."""
    return written(v, "search", _searched).groupBy("rung").agg(
        F.count("*").alias("trials"), F.count_if("survived").alias("survivors"), F.max("budget").alias("budget"), F.max("n_scored").alias("n_scored"))


@query("search_trials")
def search_trials(v: Views):
    """Every trial's settings, score and fate at every rung."""
    return rounded(written(v, "search", _searched))


def _permuted(v: Views):
    train, test = _split(v)
    return T.permutation_table(M.fit_classifier(train, model_columns(v), "logistic"), test)


@query("permutation_features", f"SELECT unnest({_FEATURES}) AS feature, n_scored FROM (SELECT count(target) AS n_scored FROM ({_PAIRED}) WHERE {_NEWEST})")
def permutation_features(v: Views):
    """Every feature of the fit and the games scored with it shuffled."""
    return written(v, "permuted", _permuted).select("feature", "n_scored")


@query("permutation_scores")
def permutation_scores(v: Views):
    """Rise in Brier when a feature is shuffled, one row per feature of the matrix."""
    return rounded(written(v, "permuted", _permuted))


@query("metrics_log", f"SELECT run, model_name, season, n_test FROM ({RAW['fold_metrics']}) f, (VALUES ('first'), ('second')) t(run)")
def metrics_log(v: Views):
    """Fold metrics of two runs appended to one table."""
    folds, path = E.fold_metrics(v.preds, ["model_name"], "season", v.rows("orders")), fresh_path(v.spark, "metrics")
    for run in ("first", "second"):
        M.log_metrics(folds, path, run)
    return v.spark.read.parquet(path).select("run", "model_name", "season", "n_test")


@query("counts_identity", f"""SELECT count(*) AS n, {r('avg(sog)', 'mean_sog')}, TRUE AS calibrated FROM ({RAW['sog_training']}) s JOIN matches m USING (game_id) WHERE {_NEWEST}""")
def counts_identity(v: Views):
    """After the drift factor, the mean forecast of the newest season is its actual mean."""
    columns = [*A.SOG_OWN, *[f"opp_{c}" for c in A.OPP_DEFENCE]]
    rows = stored(A.sog_training(v.shots, v.matches, team_context(v), None, v.shot_bound).select("game_id", "season", "sog", *columns))
    fit, _ = M.fit_counts(rows, columns, "sog")
    newest = M.predict_counts(fit, rows.where(F.col("season") == v.newest_season))
    return rounded(newest.agg(F.count("*").alias("n"), F.avg("sog").alias("mean_sog"), (F.abs(F.avg("pred") - F.avg("sog")) < 1e-6).alias("calibrated")))


@query("refresh_counts", """SELECT 'results' AS name, count(*) AS n FROM matches WHERE game_state = 'OFF' AND home_win IS NOT NULL UNION ALL
SELECT 'team_games', count(*) FROM facts UNION ALL SELECT 'player_games', count(*) FROM player_games UNION ALL SELECT 'goalie_games', count(*) FROM goalie_games UNION ALL
SELECT 'ratings', count(*) FROM (SELECT DISTINCT league, team_id FROM sides) UNION ALL SELECT 'log', count(*) FROM preds UNION ALL
SELECT 'lineups', 2 * count(*) FROM shots""")
def refresh_counts(v: Views):
    """Rows of every table that the daily refresh writes, the matrix aside."""
    from foretrace.catalog.documents import box_documents
    from foretrace.plans.refresh import refresh

    results = v.matches.where("game_state = 'OFF' AND home_win IS NOT NULL").select("game_id", "season", "home_win")
    paths = refresh(v.spark, fresh_path(v.spark, "refresh"), v.shots, v.matches, v.sides, results, division_table(v), v.preds, box_documents(v))
    parts = [v.spark.read.parquet(p).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, p in paths.items() if name != "matrix"]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("logistic_walk_forward")
def logistic_walk_forward(v: Views):
    """Out-of-sample logistic probabilities, scored per season."""
    scored = M.run_walk_forward(model_rows(v), model_columns(v), "logistic")
    return rounded(scored.where(F.col("target").isNotNull()).groupBy("season").agg(
        F.count("*").alias("n"), F.avg(F.pow(F.col("prob") - F.col("target"), F.lit(2))).alias("brier"), F.avg("prob").alias("mean_prob")))


@query("calibrated_forest")
def calibrated_forest(v: Views):
    """A forest calibrated on the newest part, scored on the newest season."""
    train, test = _split(v)
    older, newest = M.split_newest(train.where(F.col("target").isNotNull()), ["season", "game_num", "game_id"])
    fit = M.calibrate(M.fit_classifier(older, model_columns(v), "forest"), newest)
    return rounded(fit.score(test).select("game_id", "target", "prob"))


@query("poisson_walk_forward")
def poisson_walk_forward(v: Views):
    """Out-of-sample shot-count forecasts against climatology, per line."""
    rows = A.sog_training(v.shots, v.matches, team_context(v), None, v.shot_bound)
    columns = [*A.SOG_OWN, *[f"opp_{c}" for c in A.OPP_DEFENCE]]
    out = M.counts_walk_forward(stored(rows.select("game_id", "season", "sog", *columns)), columns, "sog")
    return rounded(C.count_scoring(out, [1.5, 2.5, 3.5]))

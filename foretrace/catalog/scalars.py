"""Queries over column rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretrace.catalog.registry import query, r, rounded
from foretrace.catalog.windows import team_facts
from foretrace.functions import odds as O
from foretrace.functions import scalars as S
from foretrace.functions import seasons as T
from foretrace.operators import facts as X
from foretrace.operators import features as Y
from foretrace.sources.views import Views


@query("season_formats", """SELECT game_id, CAST(season AS VARCHAR) || '-' || CAST(season + 1 AS VARCHAR) AS label,
  CAST(season AS VARCHAR) || CAST(season + 1 AS VARCHAR) AS api,
  CASE WHEN game_id % 5 = 4 THEN NULL ELSE season END AS parsed FROM matches""")
def season_formats(v: Views):
    """Labels of a season and the year read back from four spellings."""
    label, api = T.season_label(F.col("season")), T.season_api(F.col("season"))
    text = F.when(F.col("game_id") % 5 == 0, label).when(F.col("game_id") % 5 == 1, api).when(
        F.col("game_id") % 5 == 2, F.col("season").cast("string")).when(
        F.col("game_id") % 5 == 3, F.concat(F.lit(" "), label)).otherwise("season?")
    return v.matches.select("game_id", label.alias("label"), api.alias("api"), T.season_year(text).alias("parsed"))


@query("season_of_date", """SELECT game_id, CAST(year(game_date) - CASE WHEN month(game_date) < 9 THEN 1 ELSE 0 END AS BIGINT)
  AS season_year FROM matches""")
def season_of_date(v: Views):
    """Season a date belongs to, rolling over in September."""
    return v.matches.select("game_id", T.season_of_date(F.col("game_date")).cast("bigint").alias("season_year"))


def _event_id(v: Views):
    return F.concat(F.col("season").cast("string"), F.when(F.col("game_type") == "P", "03").otherwise("02"),
                    F.lpad((F.col("game_id") % 10000).cast("string"), 4, "0"))


@query("game_sort_key", """SELECT game_id, CASE WHEN game_type = 'P' THEN 30000 ELSE 20000 END + game_id % 10000 AS sort_key FROM matches""")
def game_sort_key(v: Views):
    """Chronological key of an id; playoffs sort after the regular season."""
    return v.matches.select("game_id", T.sequence_key(_event_id(v)).alias("sort_key"))


@query("canonical_id", """SELECT game_id, CAST(season AS VARCHAR) || '0' || CAST(20000 + game_id % 1271 AS VARCHAR) AS canonical FROM matches""")
def canonical_id(v: Views):
    """Float source id to the ten-character id."""
    source = (20000 + F.col("game_id") % 1271).cast("double").cast("string")
    return v.matches.select("game_id", T.canonical_id(F.col("season"), source).alias("canonical"))


# Schedule shapes (from year, games, days) of the check below.
SHAPES = [(1996, 1271, 191), (1999, 1312, 192)]
_TOTAL = "CASE WHEN season >= 1999 THEN 1312 ELSE 1271 END"
_DAYS = "CASE WHEN season >= 1999 THEN 192 ELSE 191 END"
_OPEN = "CASE WHEN season = 1997 THEN DATE '1997-10-01' ELSE make_date(season, 10, 8) END"


def _opener():
    known = F.when(F.col("season") == 1997, F.lit("1997-10-01").cast("date"))
    return T.season_opener(F.col("season"), known)


@query("approx_date", f"""WITH k AS (SELECT *, CASE WHEN game_type = 'P' THEN 30000 ELSE 20000 END + game_id % 1271 AS num FROM matches)
SELECT game_id, CAST({_OPEN} + CAST(CASE WHEN num // 10000 = 3
    THEN {_DAYS} + 3 + (greatest((num % 10000) // 100, 1) - 1) * 14 + (greatest(num % 10, 1) - 1) * 2
    ELSE floor(CAST(num % 10000 AS DOUBLE) / {_TOTAL} * {_DAYS}) END AS INTEGER) AS DATE) AS approx FROM k""")
def approx_date(v: Views):
    """Date estimated from the sequence number."""
    num = F.when(F.col("game_type") == "P", 30000).otherwise(20000) + F.col("game_id") % 1271
    total, days = T.shape_as_of(F.col("season"), SHAPES)
    return v.matches.select("game_id", T.approximate_date(_opener(), num, total, days).alias("approx"))


@query("season_dim", f"""WITH s AS (SELECT CAST(range AS BIGINT) AS season FROM range(
    (SELECT min(season) FROM matches), (SELECT max(season) + 1 FROM matches))),
n AS (SELECT season, count(*) AS n_games FROM matches GROUP BY season)
SELECT season, CAST(season AS VARCHAR) || '-' || CAST(season + 1 AS VARCHAR) AS label, {_OPEN} AS opener,
  CAST({_TOTAL} AS BIGINT) AS total_games, CAST({_DAYS} AS BIGINT) AS season_days, coalesce(n_games, 0) AS n_games
FROM s LEFT JOIN n USING (season)""")
def season_dim(v: Views):
    """Season list between the first and last season played, with opener and shape."""
    span = v.matches.agg(F.min("season").alias("lo"), F.max("season").alias("hi"))
    years = span.select(F.explode(F.sequence("lo", "hi")).alias("season"))
    played = v.matches.groupBy("season").agg(F.count("*").alias("n_games"))
    total, days = T.shape_as_of(F.col("season"), SHAPES)
    return years.join(played, "season", "left").select(
        "season", T.season_label(F.col("season")).alias("label"), _opener().alias("opener"),
        total.cast("bigint").alias("total_games"), days.cast("bigint").alias("season_days"),
        F.coalesce("n_games", F.lit(0)).alias("n_games"))


@query("mmss_seconds", """SELECT game_id, CAST(CASE WHEN game_id % 6 = 5 THEN 0 ELSE (game_id % 60) * 60 + game_id % 59 END AS DOUBLE)
  AS seconds FROM matches""")
def mmss_seconds(v: Views):
    """'MM:SS' to seconds; malformed text counts as zero."""
    text = F.when(F.col("game_id") % 6 == 5, "n/a").otherwise(
        F.concat((F.col("game_id") % 60).cast("string"), F.lit(":"), F.lpad((F.col("game_id") % 59).cast("string"), 2, "0")))
    return v.matches.select("game_id", S.mmss_seconds(text).alias("seconds"))


_ML = "CASE WHEN {0} > 0 THEN 100.0 / ({0} + 100) ELSE abs({0}) / CAST(abs({0}) + 100 AS DOUBLE) END"


@query("ml_prob", f"""SELECT game_id, book, {r(f"CAST({_ML.format('home_ml')} AS DOUBLE)", "home_raw")},
  {r(f"CAST({_ML.format('away_ml')} AS DOUBLE)", "away_raw")} FROM quotes""")
def ml_prob(v: Views):
    """Implied probability of both moneylines."""
    return rounded(v.quotes.select("game_id", "book", O.implied_prob(F.col("home_ml")).alias("home_raw"),
                                   O.implied_prob(F.col("away_ml")).alias("away_raw")))


@query("ml_prob_sql_udf", f"""SELECT game_id, book, {r(f"CAST({_ML.format('home_ml')} AS DOUBLE)", "home_raw", 4)} FROM quotes""")
def ml_prob_sql_udf(v: Views):
    """The same through a SQL function, which the optimizer inlines."""
    O.register_sql_functions(v.spark)
    return rounded(v.quotes.select("game_id", "book", F.expr("ml_to_prob(CAST(home_ml AS INT))").alias("home_raw")), 4)


_H, _A = (f"CAST({_ML.format(c)} AS DOUBLE)" for c in ("home_ml", "away_ml"))


@query("no_vig", f"""SELECT game_id, book, {r(f"{_H} / ({_H} + {_A})", "home_fair")}, {r(f"{_A} / ({_H} + {_A})", "away_fair")},
  {r(f"round({_H}, 4) / (round({_H}, 4) + round({_A}, 4))", "home_fair_rounded_first")} FROM quotes""")
def no_vig(v: Views):
    """Margin removed, with and without rounding first."""
    home, away = O.fair_pair(F.col("home_ml"), F.col("away_ml"))
    first, _ = O.fair_pair(F.col("home_ml"), F.col("away_ml"), round_first=True)
    return rounded(v.quotes.select("game_id", "book", home.alias("home_fair"), away.alias("away_fair"),
                                   first.alias("home_fair_rounded_first")))


@query("edge_columns", f"SELECT game_id, {r('prob_home_win - market_prob_home', 'home_edge')}, "
       f"{r('(1 - prob_home_win) - (1 - market_prob_home)', 'away_edge')} FROM preds")
def edge_columns(v: Views):
    """Model minus market for both sides."""
    p, m = F.col("prob_home_win"), F.col("market_prob_home")
    return rounded(v.preds.select("game_id", (p - m).alias("home_edge"), ((1 - p) - (1 - m)).alias("away_edge")))


@query("dim_map", """SELECT c_custkey, TRY_CAST(CASE WHEN c_custkey % 7 = 0 THEN 'EVEN' ELSE CAST(c_custkey % 900 - 450 AS VARCHAR) END AS INTEGER) AS line,
  CASE upper(n_name) WHEN 'UNITED STATES' THEN 'USA' WHEN 'UNITED KINGDOM' THEN 'UK' ELSE upper(n_name) END AS code
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def dim_map(v: Views):
    """Text to integer line, and nation to code by a lookup."""
    # The two codes that differ from the name.
    code = F.upper(F.col("n_name"))
    mapped = F.when(code == "UNITED STATES", "USA").when(code == "UNITED KINGDOM", "UK").otherwise(code)
    text = F.when(F.col("c_custkey") % 7 == 0, "EVEN").otherwise((F.col("c_custkey") % 900 - 450).cast("string"))
    named = v.table("customer").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return named.select("c_custkey", O.parse_american(text).alias("line"), mapped.alias("code"))


_RATIOS = ["xgf_pct", "xgf_pct_5v5", "cf_pct", "sf_pct"]


@query("ratio_metrics", f"""SELECT game_id, team_id, {", ".join(r(c) for c in _RATIOS)}, goal_diff,
  CASE WHEN goals_for > goals_against THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS won FROM team_games""")
def ratio_metrics(v: Views):
    """Shares, goal difference and the naive result."""
    return rounded(X.ratios(X.against(X.team_totals(v.shots))).select("game_id", "team_id", *_RATIOS, "goal_diff", "won"))


@query("situation_class", "SELECT situation, game_type, count(*) AS n, CAST(sum(goal) AS BIGINT) AS goals FROM st_shots GROUP BY ALL")
def situation_class(v: Views):
    """Shots and goals per manpower class."""
    own = F.when(F.col("is_home"), F.col("home_skaters")).otherwise(F.col("away_skaters"))
    other = F.when(F.col("is_home"), F.col("away_skaters")).otherwise(F.col("home_skaters"))
    return X.regular(v.shots).groupBy(S.situation(own, other).alias("situation"), "game_type").agg(
        F.count("*").alias("n"), F.sum("goal").alias("goals"))


@query("interactions", f"""WITH r AS (SELECT game_id, team_id, CAST(coalesce(date_diff('day',
    lag(game_date) OVER (PARTITION BY team_id ORDER BY game_date, game_id), game_date) = 1, FALSE) AS BIGINT) AS b2b FROM sides)
SELECT f.game_id, f.team_id, b2b, {r("b2b * goals_for", "b2b_x_goals")}, {r("b2b * xgf_pct", "b2b_x_xgf")} FROM facts f JOIN r
  ON f.game_id = r.game_id AND f.team_id = r.team_id""")
def interactions(v: Views):
    """Back-to-back flag times form columns."""
    rest = Y.rest_days(v.sides, v.match_bound).select("game_id", "team_id", F.col("back_to_back").alias("b2b"))
    facts = team_facts(v).select("game_id", "team_id", "goals_for", "xgf_pct")
    return rounded(facts.join(rest, ["game_id", "team_id"]).select(
        "game_id", "team_id", "b2b", (F.col("b2b") * F.col("goals_for")).cast("double").alias("b2b_x_goals"),
        (F.col("b2b") * F.col("xgf_pct")).alias("b2b_x_xgf")))


_GROUPS = """groups AS (SELECT DISTINCT c_custkey // 16 AS team_id, (c_custkey // 16) % 8 AS division, (c_custkey // 16) % 2 AS conference
  FROM customer WHERE (c_custkey // 16) % 13 > 0)"""


def division_table(v: Views):
    team = F.floor(F.col("c_custkey") / 16).cast("bigint")
    return v.table("customer").select(team.alias("team_id")).where("team_id % 13 > 0").distinct().select(
        "team_id", (F.col("team_id") % 8).alias("division"), (F.col("team_id") % 2).alias("conference"))


@query("group_flags", f"""WITH {_GROUPS}
SELECT m.game_id, CAST(coalesce(h.division = a.division, FALSE) AS BIGINT) AS same_division,
  CAST(coalesce(h.conference = a.conference, FALSE) AS BIGINT) AS same_conference
FROM matches m LEFT JOIN groups h ON m.home_id = h.team_id LEFT JOIN groups a ON m.away_id = a.team_id""")
def group_flags(v: Views):
    """Same division and conference; unlisted teams give zero."""
    return Y.group_flags(v.matches, division_table(v)).select("game_id", "same_division", "same_conference")


_ELO_H, _ELO_A = "(1400 + (home_id * 37) % 200)", "(1400 + (away_id * 37) % 200)"


@query("elo_expected", f"""SELECT game_id, {r(f"1 / (1 + power(10.0, ({_ELO_A} - {_ELO_H} - 50) / 400.0))", "expected_home")},
  {r("CASE WHEN home_win IS NULL THEN NULL WHEN went_to_ot = 0 THEN home_win WHEN home_win = 1 THEN 0.6 ELSE 0.4 END", "actual_home")} FROM matches""")
def elo_expected(v: Views):
    """Expected score of given ratings and the discounted result."""
    home, away = (1400 + (F.col(c) * 37) % 200 for c in ("home_id", "away_id"))
    return rounded(v.matches.select(
        "game_id", S.elo_expected(home + 50, away).alias("expected_home"),
        S.elo_actual(F.col("home_win"), F.col("went_to_ot"), 0.6).alias("actual_home")))


_COV = "(CAST(xg_against IS NOT NULL AS INTEGER) + CAST(xgf_pct IS NOT NULL AS INTEGER) + CAST(goals_for IS NOT NULL AS INTEGER)) / 4.0"


@query("feature_coverage", f"SELECT game_id, team_id, {r(f'CAST({_COV} AS DOUBLE)', 'feature_coverage')} FROM facts")
def feature_coverage(v: Views):
    """Populated share of a feature list with one absent column."""
    facts = team_facts(v)
    return rounded(facts.select("game_id", "team_id", S.coverage(
        ["xg_against", "xgf_pct", "goals_for", "absent"], facts.columns).alias("feature_coverage")))


@query("publish_guard", """SELECT game_id, least(home_gp, away_gp) = 0 AS season_opener,
  CASE WHEN least(home_gp, away_gp) = 0 THEN home_elo IS NOT NULL AND away_elo IS NOT NULL ELSE coverage >= 0.7 END AS usable FROM (
  SELECT game_id, CAST(game_id % 12 AS BIGINT) AS home_gp, CAST(game_id % 7 AS BIGINT) AS away_gp,
    CASE WHEN game_id % 5 > 0 THEN 1500 END AS home_elo, 1500 AS away_elo, feature_coverage AS coverage FROM preds)""")
def publish_guard_query(v: Views):
    """Openers need both ratings, other games enough coverage."""
    from foretrace.plans.slate import publish_guard

    rows = v.preds.select(
        "game_id", (F.col("game_id") % 12).alias("home_games_played"), (F.col("game_id") % 7).alias("away_games_played"),
        F.when(F.col("game_id") % 5 > 0, 1500.0).alias("home_elo"), F.lit(1500.0).alias("away_elo"), "feature_coverage")
    return publish_guard(rows).select("game_id", "season_opener", "usable")


@query("eligibility_filter", """WITH g AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season, game_num, game_id) - 1 AS gp
  FROM player_games) SELECT game_id, player_id, gp AS games_played, sog FROM g WHERE gp >= 5 AND player_id > 0 AND player_id % 20 > 0""")
def eligibility_filter(v: Views):
    """Player rows with enough games, a valid id and a skater position."""
    from foretrace.plans.projections import eligible_players

    position = F.when(F.col("player_id") % 20 == 0, "G").otherwise("F")
    rows = Y.player_features(X.player_games(v.shots), v.shot_bound).withColumn("position", position)
    return eligible_players(rows).select("game_id", "player_id", "games_played", "sog")


@query("mark_started", """SELECT p.game_id, coalesce(s.game_state NOT IN ('FUT', 'PRE'), FALSE) AS already_started
  FROM preds p LEFT JOIN (SELECT game_id, game_state FROM matches WHERE game_id % 8 > 0) s ON p.game_id = s.game_id""")
def mark_started(v: Views):
    """Whether the game had started; no schedule row means not started."""
    from foretrace.plans.slate import mark_started as mark

    return mark(v.preds, v.matches.where("game_id % 8 > 0")).select("game_id", "already_started")

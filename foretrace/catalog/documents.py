"""Queries over nested documents built row by row from the driver tables.

Every document holds a bounded number of entries made from one source row, so
building them shuffles nothing and no group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foretrace.catalog.registry import query, r, rounded
from foretrace.session import fresh_path
from foretrace.sources import documents as D
from foretrace.sources.scans import save_table, scan_season_csv
from foretrace.sources.views import Views


def _abbr(col: str):
    return F.concat(F.lit("T"), F.col(col).cast("string"))


def _id():
    return F.col("season") * 1000000 + F.col("game_num")


def _side(id_col: str, score: str | None = None):
    parts = [_abbr(id_col).alias("abbrev")]
    return F.struct(*parts, *([F.col(score).alias("score")] if score else []))


def box_documents(v: Views):
    """One boxscore page per shot: the shooter, a team-mate without a shot, the goalie."""
    shooter = F.struct(
        F.col("player_id").alias("playerId"),
        F.struct(F.concat(F.lit("P"), F.col("player_id").cast("string")).alias("default")).alias("name"),
        F.lit("C").alias("position"),
        F.concat((F.col("part_no") % 25).cast("string"), F.lit(":"), F.lpad((F.col("supp_no") % 60).cast("string"), 2, "0")).alias("toi"),
        F.col("sog"), F.col("goal").alias("goals"), F.when(F.col("part_no") % 4 > 0, F.col("part_no") % 3).alias("hits"))
    mate = F.struct((F.col("player_id") + 1).alias("playerId"), F.lit("D").alias("position"), F.lit("--").alias("toi"))
    goalie = F.struct(
        F.col("goalie_id").alias("playerId"), F.lit("Goalie").alias("name"), (F.col("supp_no") % 2 == 0).alias("starter"),
        F.lit("60:00").alias("toi"), F.col("sog").alias("shotsAgainst"), (F.col("sog") - F.col("goal")).alias("saves"))
    at_home = F.col("is_home")
    attack = F.struct(F.array(shooter).alias("forwards"), F.array(mate).alias("defense"))
    defence = F.struct(F.array(goalie).alias("goalies"))
    home = F.when(at_home, F.to_json(attack)).otherwise(F.to_json(defence))
    away = F.when(at_home, F.to_json(defence)).otherwise(F.to_json(attack))
    head = F.to_json(F.struct(
        _id().alias("id"), F.concat(F.col("season").cast("string"), (F.col("season") + 1).cast("string")).cast("bigint").alias("season"),
        _side("home_id").alias("homeTeam"), _side("away_id").alias("awayTeam")))
    doc = F.concat(
        F.regexp_replace(head, r"\}$", ""), F.lit(',"playerByGameStats":{"homeTeam":'), home,
        F.lit(',"awayTeam":'), away, F.lit("}}"))
    # Building and parsing cost far more than the small rows they start from suggest: spread them first.
    tasks = 2 * v.spark.sparkContext.defaultParallelism
    return v.shots.repartition(tasks).select("game_id", doc.alias("doc"))


_BOX_ID = "CAST(season * 1000000 + game_num AS VARCHAR) AS game_id, CAST(season AS VARCHAR) || '-' || CAST(season + 1 AS VARCHAR) AS season, (season * 1000000 + game_num) % 1000000 AS game_num"


@query("box_skaters", f"""SELECT {_BOX_ID}, player_id, 'P' || player_id AS player_name, 'T' || team_id AS team, is_home, 'C' AS position,
  CAST((part_no % 25) * 60 + supp_no % 60 AS DOUBLE) AS toi_seconds, sog, goal AS goals, CASE WHEN part_no % 4 > 0 THEN part_no % 3 ELSE 0 END AS hits FROM shots
UNION ALL SELECT {_BOX_ID}, player_id + 1, '', 'T' || team_id, is_home, 'D', CAST(0 AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM shots""")
def box_skaters(v: Views):
    """Boxscore documents to skater rows."""
    return D.skaters(box_documents(v)).select(
        "game_id", "season", "game_num", "player_id", "player_name", "team", "is_home", "position", "toi_seconds", "sog", "goals", "hits")


@query("box_goalies", f"""SELECT {_BOX_ID}, goalie_id AS player_id, 'Goalie' AS player_name, 'T' || def_team_id AS team, NOT is_home AS is_home,
  supp_no % 2 = 0 AS starter, CAST(3600 AS DOUBLE) AS toi_seconds, sog - goal AS saves, sog AS shots_against, CAST(0 AS BIGINT) AS goals_against FROM shots""")
def box_goalies(v: Views):
    """Boxscore documents to goalie rows."""
    return D.goalies(box_documents(v)).select(
        "game_id", "season", "game_num", "player_id", "player_name", "team", "is_home", "starter", "toi_seconds", "saves",
        "shots_against", "goals_against")


def result_documents(v: Views):
    period = F.when(F.col("went_to_ot") == 1, F.when(F.col("game_id") % 3 == 0, "SO").otherwise("OT")).otherwise("REG")
    doc = F.to_json(F.struct(
        F.col("game_id").alias("id"), F.concat(F.col("season").cast("string"), (F.col("season") + 1).cast("string")).cast("bigint").alias("season"),
        F.col("game_date").cast("string").alias("gameDate"), F.col("game_type").alias("gameType"), F.col("game_state").alias("gameState"),
        _side("home_id", "home_score").alias("homeTeam"),
        F.struct(_abbr("away_id").alias("abbrev"), F.when(F.col("game_id") % 19 > 0, F.col("away_score")).alias("score")).alias("awayTeam"),
        F.struct(period.alias("periodType")).alias("periodDescriptor"),
        F.when(F.col("game_id") % 2 == 0, F.struct(period.alias("lastPeriodType"))).alias("gameOutcome")))
    return v.matches.select("game_id", doc.alias("doc"))


_PERIOD = "CASE WHEN went_to_ot = 1 THEN CASE WHEN game_id % 3 = 0 THEN 'SO' ELSE 'OT' END ELSE 'REG' END"


@query("game_results", f"""SELECT CAST(game_id AS VARCHAR) AS game_id, CAST(season AS VARCHAR) || '-' || CAST(season + 1 AS VARCHAR) AS season, game_date, game_type,
  'T' || home_id AS home_team, 'T' || away_id AS away_team, home_score, away_score, home_score > away_score AS home_win,
  {_PERIOD} AS last_period_type, went_to_ot = 1 AS went_to_ot, {_PERIOD} = 'SO' AS went_to_so
  FROM matches WHERE game_state = 'OFF' AND game_id % 19 > 0 AND home_score <> away_score""")
def game_results(v: Views):
    """Final documents to official results."""
    return D.game_results(result_documents(v))


@query("json_scan_missing", """SELECT CASE WHEN game_id % 17 = 0 THEN 'missing' WHEN game_id % 13 = 0 THEN 'corrupt' ELSE 'parsed' END AS status,
  count(*) AS n FROM matches GROUP BY 1""")
def json_scan_missing(v: Views):
    """Requested ids that were parsed, unreadable or missing."""
    docs = result_documents(v).where("game_id % 17 > 0").withColumn(
        "doc", F.when(F.col("game_id") % 13 == 0, F.expr("substring(doc, 1, 25)")).otherwise(F.col("doc")))
    return D.scan_status(v.matches, docs, D.BOX_SCHEMA)


@query("schedule_flatten", """SELECT CAST(game_id AS VARCHAR) AS game_id, game_date, CAST(season AS VARCHAR) AS season, game_type,
  'T' || home_id AS home_team, 'T' || away_id AS away_team, home_score, CASE WHEN game_state = 'OFF' THEN away_score END AS away_score, game_state FROM matches
UNION ALL SELECT CAST(game_id + 1000000000 AS VARCHAR), game_date + 1, CAST(season AS VARCHAR), game_type, 'T' || away_id, 'T' || home_id, NULL, NULL, 'FUT' FROM matches""")
def schedule_flatten(v: Views):
    """Week documents of two days to scheduled games."""
    game = F.struct(
        F.col("game_id").alias("id"), "season", F.col("game_type").alias("gameType"), _side("home_id", "home_score").alias("homeTeam"),
        F.struct(_abbr("away_id").alias("abbrev"), F.when(F.col("game_state") == "OFF", F.col("away_score")).alias("score")).alias("awayTeam"),
        F.col("game_state").alias("gameState"))
    back = F.struct(
        (F.col("game_id") + 1000000000).alias("id"), "season", F.col("game_type").alias("gameType"),
        F.struct(_abbr("away_id").alias("abbrev"), F.lit(None).cast("bigint").alias("score")).alias("homeTeam"),
        F.struct(_abbr("home_id").alias("abbrev"), F.lit(None).cast("bigint").alias("score")).alias("awayTeam"), F.lit("FUT").alias("gameState"))
    day = lambda d, g: F.struct(d.cast("string").alias("date"), F.array(g).alias("games"))
    doc = F.to_json(F.struct(F.array(day(F.col("game_date"), game), day(F.date_add("game_date", 1), back)).alias("gameWeek")))
    return D.schedule(v.matches.select(doc.alias("doc"))).select(
        "game_id", "game_date", "season", "game_type", "home_team", "away_team", "home_score", "away_score", "game_state")


def landing_documents(v: Views):
    """One landing page per shot row."""
    def stat(name, home, away):
        return F.struct(F.lit(name).alias("category"), home.cast("double").alias("homeValue"), away.cast("double").alias("awayValue"))

    goalie = F.struct(
        F.col("goalie_id").alias("playerId"), F.struct(F.concat(F.lit("G"), F.col("goalie_id").cast("string")).alias("default")).alias("name"),
        (F.col("supp_no") % 2 == 0).alias("starter"), F.lit("58:30").alias("toi"),
        (F.col("part_no") % 40).alias("shotsAgainst"), (F.col("part_no") % 40 - F.least(F.col("part_no") % 40, F.col("goal"))).alias("saves"))
    scratch = F.array(F.struct(F.col("player_id").alias("id")), F.struct(F.lit(None).cast("bigint").alias("id")))
    doc = F.to_json(F.struct(
        F.col("game_id").alias("id"), (F.col("period") + 1).alias("period"),
        F.struct(F.when(F.col("period") == 4, F.lit("SO")).otherwise("REG").alias("periodType")).alias("periodDescriptor"),
        F.struct(_abbr("home_id").alias("abbrev"), F.col("sog").alias("score")).alias("homeTeam"),
        F.struct(_abbr("away_id").alias("abbrev"), F.col("goal").alias("score")).alias("awayTeam"),
        F.struct(
            F.array(stat("sog", F.col("part_no") % 45, F.col("supp_no") % 45), stat("hits", F.col("part_no") % 9, F.col("supp_no") % 9),
                    stat("hits", F.col("part_no") % 11, F.col("supp_no") % 11), stat("faceoffWinningPctg", F.col("distance") / 100, 1 - F.col("distance") / 100)).alias("teamGameStats"),
            F.struct(F.array(goalie).alias("awayTeam")).alias("goalieStats"),
            F.struct(F.struct(scratch.alias("scratches")).alias("homeTeam")).alias("gameInfo")).alias("summary")))
    return v.shots.select(doc.alias("doc"))


@query("landing_results", """SELECT CAST(game_id AS VARCHAR) AS game_id, sog AS home_score, goal AS away_score, sog > goal AS home_win,
  period + 1 >= 4 AS went_to_ot, period + 1 >= 5 OR period = 4 AS went_to_so FROM shots""")
def landing_results(v: Views):
    """Landing pages to results."""
    return D.landing_results(landing_documents(v))


@query("landing_goalies", f"""SELECT CAST(game_id AS VARCHAR) AS game_id, goalie_id, coalesce('G' || goalie_id, '') AS goalie_name, 'T' || away_id AS team, supp_no % 2 = 0 AS is_starter,
  part_no % 40 AS shots_against, part_no % 40 - least(part_no % 40, goal) AS saves, least(part_no % 40, goal) AS goals_against,
  {r("CASE WHEN part_no % 40 > 0 THEN round((part_no % 40 - least(part_no % 40, goal)) / CAST(part_no % 40 AS DOUBLE), 4) END", "save_pct")}, CAST(3510 AS DOUBLE) AS toi_seconds FROM shots""")
def landing_goalies(v: Views):
    """Landing pages to goalie rows."""
    return rounded(D.landing_goalies(landing_documents(v)))


@query("landing_team_stats", f"""SELECT CAST(game_id AS VARCHAR) AS game_id, 'T' || home_id AS team, TRUE AS is_home, sog AS goals_for, CAST(part_no % 45 AS DOUBLE) AS shots_for,
  CAST(part_no % 11 AS DOUBLE) AS hits, {r("distance / 100", "faceoff_pct")} FROM shots
UNION ALL SELECT CAST(game_id AS VARCHAR), 'T' || away_id, FALSE, goal, CAST(supp_no % 45 AS DOUBLE), CAST(supp_no % 11 AS DOUBLE), {r("1 - distance / 100", "x")} FROM shots""")
def landing_team_stats(v: Views):
    """A category array pivoted to team columns."""
    return rounded(D.landing_team_stats(landing_documents(v)).select(
        "game_id", "team", "is_home", "goals_for", "shots_for", "hits", "faceoff_pct"))


@query("scratched_players", "SELECT DISTINCT CAST(game_id AS VARCHAR) AS game_id, player_id FROM shots")
def scratched_players(v: Views):
    """Scratched ids of both sides."""
    return D.scratches(landing_documents(v))


@query("gamelog_flatten", """SELECT CAST(game_id AS VARCHAR) AS game_id, game_date, player_id, 'P' || player_id AS player_name, 'T' || team_id AS team,
  'T' || def_team_id AS opponent, CASE WHEN is_home THEN 'H' ELSE 'R' END AS home_road, CAST((part_no % 25) * 60 + 5 AS DOUBLE) AS toi_seconds, goal AS goals, sog,
  CASE WHEN goal = 1 THEN part_no % 2 ELSE 0 END AS pp_goals FROM shots""")
def gamelog_flatten(v: Views):
    """Player logs to rows."""
    game = F.struct(
        F.col("game_id").alias("gameId"), F.col("game_date").cast("string").alias("gameDate"), _abbr("team_id").alias("teamAbbrev"),
        _abbr("def_team_id").alias("opponentAbbrev"), F.when(F.col("is_home"), "H").otherwise("R").alias("homeRoadFlag"),
        F.concat((F.col("part_no") % 25).cast("string"), F.lit(":05")).alias("toi"), F.col("goal").alias("goals"), F.col("sog").alias("shots"),
        F.when(F.col("goal") == 1, F.col("part_no") % 2).alias("powerPlayGoals"))
    doc = F.to_json(F.struct(F.col("player_id").alias("playerId"), F.concat(F.lit("P"), F.col("player_id").cast("string")).alias("playerName"), F.array(game).alias("gameLog")))
    return D.game_logs(v.shots.select(doc.alias("doc"))).select(
        "game_id", "game_date", "player_id", "player_name", "team", "opponent", "home_road", "toi_seconds", "goals", "sog", "pp_goals")


@query("roster_flatten", """SELECT 'T' || c_nationkey AS team, c_custkey * 3 + k AS player_id, c_mktsegment || ' ' || c_name AS player_name,
  CASE k WHEN 0 THEN 'C' WHEN 1 THEN 'D' ELSE '' END AS position FROM customer, (SELECT unnest([0, 1, 2]) AS k)""")
def roster_flatten(v: Views):
    """Three position lists to players."""
    def player(k, code):
        return F.array(F.struct(
            (F.col("c_custkey") * 3 + k).alias("id"), F.struct(F.col("c_mktsegment").alias("default")).alias("firstName"),
            F.struct(F.col("c_name").alias("default")).alias("lastName"), F.lit(code).cast("string").alias("positionCode")))

    doc = F.to_json(F.struct(_abbr("c_nationkey").alias("team"), player(0, "C").alias("forwards"), player(1, "D").alias("defensemen"), player(2, None).alias("goalies")))
    return D.rosters(v.table("customer").select(doc.alias("doc")))


_RAW = "round(CASE WHEN {0} > 0 THEN 100.0 / ({0} + 100) ELSE abs({0}) / CAST(abs({0}) + 100 AS DOUBLE) END, 4)"


@query("odds_flatten", f"""WITH o AS (SELECT q.*, CASE WHEN game_id % 9 > 0 THEN away_ml END AS a FROM quotes q)
SELECT CAST(game_id AS VARCHAR) AS id, 'book' || book AS book, CAST(home_ml AS INTEGER) AS open_home_ml, CAST(a AS INTEGER) AS open_away_ml,
  {r(f"CASE WHEN a IS NOT NULL THEN round_even({_RAW.format('home_ml')} / ({_RAW.format('home_ml')} + {_RAW.format('a')}), 4) END", "open_home_prob")} FROM o""")
def odds_flatten(v: Views):
    """Bookmaker documents to price rows."""
    away = F.when(F.col("game_id") % 9 > 0, F.col("away_ml").cast("string")).otherwise("pending")
    outcomes = F.array(F.struct(F.lit("Home").alias("name"), F.col("home_ml").cast("string").alias("price")),
                       F.struct(F.lit("Away").alias("name"), away.alias("price")))
    markets = F.array(F.struct(F.lit("spreads").alias("key"), F.array(F.struct(F.lit("Home").alias("name"), F.lit("7").alias("price"))).alias("outcomes")),
                      F.struct(F.lit("h2h").alias("key"), outcomes.alias("outcomes")))
    doc = F.to_json(F.struct(
        F.col("game_id").cast("string").alias("id"), F.lit("Home").alias("home_team"), F.lit("Away").alias("away_team"),
        F.array(F.struct(F.concat(F.lit("book"), F.col("book").cast("string")).alias("key"), markets.alias("markets"))).alias("bookmakers")))
    return rounded(D.bookmaker_odds(v.quotes.select(doc.alias("doc"))).select("id", "book", "open_home_ml", "open_away_ml", "open_home_prob"))


_FULL = "(CASE WHEN {0} > 0 THEN 100.0 / ({0} + 100) ELSE abs({0}) / CAST(abs({0}) + 100 AS DOUBLE) END)"


@query("book_lines", f"""SELECT game_id AS id, CASE game_id % 3 WHEN 0 THEN 'TBL' WHEN 1 THEN 'CBJ' ELSE 'BOS' END AS home_team, 'NYR' AS away_team,
  CASE game_id % 4 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'complete' ELSE 'in_progress' END AS status, 'Book' || book AS book, home_ml, away_ml, total,
  CASE WHEN total > 25 THEN CAST(-110 AS BIGINT) END AS total_under_ml, CAST(1.5 AS DOUBLE) AS home_spread,
  {r(f"round_even({_FULL.format('home_ml')} / ({_FULL.format('home_ml')} + {_FULL.format('away_ml')}), 4)", "prob_home_win")}
FROM quotes WHERE book < 4 AND game_id % 6 > 0 AND game_id % 7 > 0""")
def book_lines(v: Views):
    """Market maps to one row per (game, book)."""
    def entry(team, odds, live=False, side=None, value=None):
        return F.struct(F.lit(team).cast("bigint").alias("team_id"), F.lit(side).cast("string").alias("side"),
                        (F.lit(None) if value is None else value).cast("double").alias("value"), odds.cast("bigint").alias("odds"), F.lit(live).alias("is_live"))

    away = F.when(F.col("game_id") % 7 > 0, F.col("away_ml"))
    money = F.array(entry(1, F.col("home_ml")), entry(1, F.lit(9999), True), entry(2, away))
    total = F.filter(F.array(entry(None, F.lit(-105), side="over", value=F.col("total")),
                             F.when(F.col("total") > 25, entry(None, F.lit(-110), side="under"))), lambda e: e.isNotNull())
    spread = F.array(entry(1, F.lit(-120), value=F.lit(1.5)), entry(2, F.lit(100), value=F.lit(-1.5)))
    market = F.struct(F.struct(money.alias("moneyline"), total.alias("total"), spread.alias("spread")).alias("event"))
    code = F.when(F.col("game_id") % 3 == 0, "tb").when(F.col("game_id") % 3 == 1, "CLB").otherwise("Bos")
    status = F.when(F.col("game_id") % 4 == 0, "created").when(F.col("game_id") % 4 == 1, "closed").otherwise("live")
    team = lambda i, c: F.struct(F.lit(i).cast("bigint").alias("id"), c.alias("abbr"))
    doc = F.to_json(F.struct(
        F.col("game_id").alias("id"), F.when(F.col("game_id") % 6 > 0, "reg").otherwise("pre").alias("type"), status.alias("status"),
        F.lit(1).alias("home_team_id"), F.lit(2).alias("away_team_id"), F.array(team(1, code), team(2, F.lit("NYR"))).alias("teams"),
        F.map_from_arrays(F.array(F.col("book").cast("string")), F.array(market)).alias("markets")))
    rows = D.book_lines(v.quotes.select(doc.alias("doc")), {str(k): f"Book{k}" for k in range(4)})
    return rounded(rows.select("id", "home_team", "away_team", "status", "book", "home_ml", "away_ml", "total", "total_under_ml", "home_spread", "prob_home_win"))


@query("event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(v: Views):
    """A scalar read from a JSON column."""
    return v.table("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("scan_csv", f"SELECT season, count(*) AS n, {r('sum(o_totalprice)', 'total', 2)} FROM orders JOIN matches ON o_orderkey = game_id WHERE season >= 1998 GROUP BY season")
def scan_csv(v: Views):
    """Orders written as CSV by season, then scanned with a schema and season pruning."""
    path = fresh_path(v.spark, "csv")
    orders = v.table("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").cast("bigint").alias("season"))
    orders.hint("rebalance", "season").write.option("header", True).partitionBy("season").csv(path)
    rows = scan_season_csv(v.spark, path, "o_orderkey bigint, o_totalprice double, o_orderstatus string", ["o_orderkey", "o_totalprice"])
    return rounded(rows.where("season >= 1998").groupBy("season").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("save_parquet", f"SELECT season, count(*) AS n FROM matches GROUP BY season")
def save_parquet(v: Views):
    """Matches written by season, one season overwritten, then read back."""
    path = fresh_path(v.spark, "parquet")
    save_table(v.matches, path)
    save_table(v.matches.where("season = 1999"), path)
    return v.spark.read.parquet(path).groupBy(F.col("season").cast("bigint").alias("season")).agg(F.count("*").alias("n"))

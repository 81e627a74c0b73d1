"""Nested JSON documents to flat rows.

Parsers take a frame with a text column ``doc`` and use a fixed schema: no
inference pass, and fields a parser does not read are never materialised. One
document becomes many rows through ``inline``; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretrace.functions import scalars as S
from foretrace.functions.odds import fair_pair, implied_prob, parse_american
from foretrace.functions.seasons import season_label, sequence_key

# Source field -> column, as the feeds name them.
SKATER_FIELDS = {
    "sog": "sog", "goals": "goals", "assists": "assists", "points": "points", "pim": "pim", "hits": "hits",
    "blockedShots": "blocked_shots", "giveaways": "giveaways", "takeaways": "takeaways", "shifts": "shifts",
    "plusMinus": "plus_minus", "powerPlayGoals": "pp_goals",
}
GOALIE_FIELDS = {"saves": "saves", "shotsAgainst": "shots_against", "goalsAgainst": "goals_against", "pim": "pim"}
TEAM_CATEGORIES = {
    "shots_for": "sog", "pp_opportunities": "powerPlayPctg", "pp_goals": "powerPlayGoals", "pim": "pim",
    "hits": "hits", "blocked_shots": "blockedShots", "faceoff_pct": "faceoffWinningPctg",
}
GAME_LOG_FIELDS = {
    "goals": "goals", "assists": "assists", "points": "points", "shots": "sog", "powerPlayGoals": "pp_goals",
    "powerPlayPoints": "pp_points",
}
SCHEDULED, COMPLETE = ["scheduled", "created"], ["complete", "closed", "final"]
TEAM_CODES = {"TB": "TBL", "NJ": "NJD", "SJ": "SJS", "LA": "LAK", "CLB": "CBJ"}

_SKATER = "array<struct<playerId: bigint, name: string, position: string, toi: string, " + ", ".join(
    f"{f}: bigint" for f in SKATER_FIELDS) + ">>"
_GOALIE = "array<struct<playerId: bigint, name: string, starter: boolean, toi: string, " + ", ".join(
    f"{f}: bigint" for f in GOALIE_FIELDS) + ">>"
_SIDE = f"struct<forwards: {_SKATER}, defense: {_SKATER}, goalies: {_GOALIE}>"
BOX_SCHEMA = (
    "id: bigint, season: bigint, gameDate: string, gameType: string, gameState: string, "
    "homeTeam: struct<abbrev: string, score: bigint>, awayTeam: struct<abbrev: string, score: bigint>, "
    "periodDescriptor: struct<periodType: string>, gameOutcome: struct<lastPeriodType: string>, "
    f"playerByGameStats: struct<homeTeam: {_SIDE}, awayTeam: {_SIDE}>"
)
SCHEDULE_SCHEMA = (
    "gameWeek: array<struct<date: string, games: array<struct<id: bigint, season: bigint, gameType: string, "
    "homeTeam: struct<abbrev: string, score: bigint>, awayTeam: struct<abbrev: string, score: bigint>, "
    "gameState: string, startTimeUTC: string, gameOutcome: struct<lastPeriodType: string>>>>>"
)
_LANDING_GOALIE = ("array<struct<playerId: bigint, name: struct<default: string>, starter: boolean, toi: string, "
                   "shotsAgainst: bigint, saves: bigint>>")
LANDING_SCHEMA = (
    "id: bigint, period: bigint, periodDescriptor: struct<periodType: string>, "
    "homeTeam: struct<abbrev: string, score: bigint>, awayTeam: struct<abbrev: string, score: bigint>, "
    "summary: struct<teamGameStats: array<struct<category: string, homeValue: double, awayValue: double>>, "
    f"goalieStats: struct<homeTeam: {_LANDING_GOALIE}, awayTeam: {_LANDING_GOALIE}>, "
    "gameInfo: struct<homeTeam: struct<scratches: array<struct<id: bigint>>>, awayTeam: struct<scratches: array<struct<id: bigint>>>>>"
)
GAME_LOG_SCHEMA = (
    "playerId: bigint, playerName: string, gameLog: array<struct<gameId: bigint, gameDate: string, teamAbbrev: string, "
    "opponentAbbrev: string, homeRoadFlag: string, toi: string, " + ", ".join(f"{f}: bigint" for f in GAME_LOG_FIELDS) + ">>"
)
_ROSTER = ("array<struct<id: bigint, firstName: struct<default: string>, lastName: struct<default: string>, "
           "positionCode: string>>")
ROSTER_SCHEMA = f"team: string, forwards: {_ROSTER}, defensemen: {_ROSTER}, goalies: {_ROSTER}"
ODDS_SCHEMA = (
    "id: string, home_team: string, away_team: string, commence_time: string, bookmakers: array<struct<key: string, "
    "markets: array<struct<key: string, outcomes: array<struct<name: string, price: string>>>>>>"
)
_LINE = "array<struct<team_id: bigint, side: string, value: double, odds: bigint, is_live: boolean>>"
LINES_SCHEMA = (
    "id: bigint, type: string, status: string, start_time: string, home_team_id: bigint, away_team_id: bigint, "
    "teams: array<struct<id: bigint, abbr: string>>, "
    f"markets: map<string, struct<event: struct<moneyline: {_LINE}, total: {_LINE}, spread: {_LINE}>>>"
)


def with_corrupt(schema: str) -> T.StructType:
    """The parsed schema plus the column that receives unreadable text."""
    return T.StructType.fromDDL(schema).add("_corrupt", T.StringType())


def read_documents(docs: DataFrame, schema: str, fields: Sequence[str] = ()) -> DataFrame:
    """Parse ``doc`` into the fields of ``schema``; unreadable text lands in ``_corrupt``.

    The whole schema is parsed, so the same texts are unreadable for every
    reader; only ``fields`` (none named: all) and ``_corrupt`` become columns,
    since copying nested fields that nobody reads costs as much as parsing.

    The parse sits inside a generator. A filter or a field reference above it
    then reads the parsed row; in a plain projection the optimizer would copy
    the parse into each of them. Rows without a document are told by a flag
    that the generator makes, so ``doc`` itself is named, and built, once.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_json("doc", with_corrupt(schema), options)
    keep = [c for c in docs.columns if c != "doc"]
    names = [n for n in with_corrupt(schema).names if not fields or n in {*fields, "_corrupt"}]
    flagged = F.transform(F.array(parsed), lambda p: F.when(p.isNotNull(), F.struct(*[p[n].alias(n) for n in names], F.lit(True).alias("_read"))))
    return docs.select(*keep, F.inline_outer(flagged)).where("_read").drop("_read")


def readable(docs: DataFrame, schema: str, fields: Sequence[str] = ()) -> DataFrame:
    return read_documents(docs.select("doc"), schema, fields).where(F.col("_corrupt").isNull()).drop("_corrupt")


def scan_status(requested: DataFrame, docs: DataFrame, schema: str) -> DataFrame:
    """How many requested ids were parsed, unreadable or missing.

    A generated row's size is a guess that is far too small, so the join is
    merged: every status would else be broadcast by the driver.
    """
    state = read_documents(docs.select("game_id", "doc"), schema).select(
        "game_id", F.when(F.col("_corrupt").isNotNull(), "corrupt").otherwise("parsed").alias("status"))
    state = state.groupBy("game_id").agg(F.max("status").alias("status"))
    found = requested.select("game_id").join(state.hint("merge"), "game_id", "left")
    return found.groupBy(F.coalesce("status", F.lit("missing")).alias("status")).agg(F.count("*").alias("n"))


def _name(field: Column) -> Column:
    """A name given as text or as an object with a default spelling."""
    return F.coalesce(F.when(field.startswith("{"), F.get_json_object(field, "$.default")), field, F.lit(""))


def _season_text(api: Column) -> Column:
    text = api.cast("string")
    return F.when(F.length(text) == 8, season_label(F.substring(text, 1, 4).cast("bigint"))).otherwise(text)


# What the player lists of a boxscore are read from.
LISTED = ["id", "season", "homeTeam", "awayTeam", "playerByGameStats"]


def _players(box: DataFrame, groups: list[str]) -> DataFrame:
    """One row per listed player of both sides, before field mapping."""
    def side(name: str, home: bool) -> Column:
        lists = [F.coalesce(F.col(f"playerByGameStats.{name}.{g}"), F.array()) for g in groups]
        return F.transform(F.concat(*lists) if len(lists) > 1 else lists[0], lambda p: F.struct(
            F.coalesce(F.col(f"{name}.abbrev"), F.lit("")).alias("team"), F.lit(home).alias("is_home"), p.alias("p")))

    listed = F.concat(side("homeTeam", True), side("awayTeam", False))
    return box.select(
        F.col("id").cast("string").alias("game_id"), _season_text(F.col("season")).alias("season"),
        sequence_key(F.col("id")).alias("game_num"), F.inline(listed))


def skaters(docs: DataFrame) -> DataFrame:
    """Every dressed skater of each boxscore, zero lines included."""
    p = F.col("p")
    return _players(readable(docs, BOX_SCHEMA, LISTED), ["forwards", "defense"]).select(
        "game_id", "season", "game_num", p["playerId"].alias("player_id"), _name(p["name"]).alias("player_name"),
        "team", "is_home", F.coalesce(p["position"], F.lit("")).alias("position"),
        S.mmss_seconds(p["toi"]).alias("toi_seconds"),
        *[F.coalesce(p[f], F.lit(0)).alias(c) for f, c in SKATER_FIELDS.items()])


def goalies(docs: DataFrame) -> DataFrame:
    """Goalie lines with the starter flag."""
    p = F.col("p")
    return _players(readable(docs, BOX_SCHEMA, LISTED), ["goalies"]).select(
        "game_id", "season", "game_num", p["playerId"].alias("player_id"), _name(p["name"]).alias("player_name"),
        "team", "is_home", F.coalesce(p["starter"], F.lit(False)).alias("starter"),
        S.mmss_seconds(p["toi"]).alias("toi_seconds"),
        *[F.coalesce(p[f], F.lit(0)).alias(c) for f, c in GOALIE_FIELDS.items()])


def game_results(docs: DataFrame) -> DataFrame:
    """Official results: final, both scores known, not level."""
    home, away = F.col("homeTeam.score"), F.col("awayTeam.score")
    last = F.coalesce("gameOutcome.lastPeriodType", "periodDescriptor.periodType")
    final = readable(docs, BOX_SCHEMA).where(F.col("gameState").isin(S.FINAL_STATES) & (home != away))
    return final.select(
        F.col("id").cast("string").alias("game_id"), _season_text(F.col("season")).alias("season"),
        F.col("gameDate").try_cast("date").alias("game_date"), F.coalesce("gameType", F.lit("")).alias("game_type"),
        F.coalesce("homeTeam.abbrev", F.lit("")).alias("home_team"), F.coalesce("awayTeam.abbrev", F.lit("")).alias("away_team"),
        home.alias("home_score"), away.alias("away_score"), (home > away).alias("home_win"),
        last.alias("last_period_type"), F.coalesce(last.isin("OT", "SO"), F.lit(False)).alias("went_to_ot"),
        F.coalesce(last == "SO", F.lit(False)).alias("went_to_so"))


def schedule(docs: DataFrame) -> DataFrame:
    """Week documents to one row per scheduled game."""
    week = readable(docs, SCHEDULE_SCHEMA).select(F.inline("gameWeek"))
    return week.select("date", F.inline("games")).select(
        F.col("id").cast("string").alias("game_id"), F.col("date").try_cast("date").alias("game_date"),
        F.col("season").cast("string").alias("season"), F.col("gameType").alias("game_type"),
        F.col("homeTeam.abbrev").alias("home_team"), F.col("awayTeam.abbrev").alias("away_team"),
        F.col("homeTeam.score").alias("home_score"), F.col("awayTeam.score").alias("away_score"),
        F.col("gameState").alias("game_state"), F.col("startTimeUTC").alias("start_time_utc"),
        F.col("gameOutcome.lastPeriodType").alias("last_period_type"))


def landing_results(docs: DataFrame) -> DataFrame:
    """Scores and overtime flags of a landing page."""
    home, away = F.col("homeTeam.score"), F.col("awayTeam.score")
    period = F.coalesce("period", F.lit(0))
    shootout = F.coalesce(F.col("periodDescriptor.periodType") == "SO", F.lit(False))
    return readable(docs, LANDING_SCHEMA, ["id", "period", "periodDescriptor", "homeTeam", "awayTeam"]).select(
        F.col("id").cast("string").alias("game_id"), home.alias("home_score"), away.alias("away_score"),
        (home > away).alias("home_win"), (period >= 4).alias("went_to_ot"), ((period >= 5) | shootout).alias("went_to_so"))


def landing_goalies(docs: DataFrame) -> DataFrame:
    """Goalie rows of a landing page; the save share is null without shots."""
    def side(name: str) -> Column:
        return F.transform(F.coalesce(F.col(f"summary.goalieStats.{name}"), F.array()), lambda g: F.struct(
            F.coalesce(F.col(f"{name}.abbrev"), F.lit("")).alias("team"), g.alias("g")))

    g = F.col("g")
    shots, saves = F.coalesce(g["shotsAgainst"], F.lit(0)), F.coalesce(g["saves"], F.lit(0))
    return readable(docs, LANDING_SCHEMA).select(
        F.col("id").cast("string").alias("game_id"), F.inline(F.concat(side("homeTeam"), side("awayTeam")))
    ).select(
        "game_id", g["playerId"].alias("goalie_id"), F.coalesce(g["name"]["default"], F.lit("")).alias("goalie_name"), "team",
        F.coalesce(g["starter"], F.lit(False)).alias("is_starter"), shots.alias("shots_against"), saves.alias("saves"),
        (shots - saves).alias("goals_against"), F.bround(F.try_divide(saves, shots), 4).alias("save_pct"),
        S.mmss_seconds(g["toi"]).alias("toi_seconds"))


def landing_team_stats(docs: DataFrame) -> DataFrame:
    """Two rows per game from an array of categories; the last of a name wins."""
    def value(category: str, field: str) -> Column:
        hits = F.filter("summary.teamGameStats", lambda s: s["category"] == category)
        return F.try_element_at(hits, F.lit(-1))[field]

    def side(name: str, field: str, home: bool) -> Column:
        return F.struct(
            F.coalesce(F.col(f"{name}.abbrev"), F.lit("")).alias("team"), F.lit(home).alias("is_home"),
            F.col(f"{name}.score").alias("goals_for"),
            *[value(category, field).alias(c) for c, category in TEAM_CATEGORIES.items()])

    return readable(docs, LANDING_SCHEMA).select(F.col("id").cast("string").alias("game_id"), F.inline(F.array(
        side("homeTeam", "homeValue", True), side("awayTeam", "awayValue", False))))


def scratches(docs: DataFrame) -> DataFrame:
    """Distinct (game, player) scratched on either side; entries without id are ignored."""
    both = F.concat(*[F.coalesce(F.col(f"summary.gameInfo.{s}.scratches"), F.array()) for s in ("homeTeam", "awayTeam")])
    return readable(docs, LANDING_SCHEMA).select(F.col("id").cast("string").alias("game_id"), F.inline(both)).where(
        F.col("id").isNotNull()).select("game_id", F.col("id").alias("player_id")).distinct()


def game_logs(docs: DataFrame) -> DataFrame:
    """A player's log to one row per game."""
    return readable(docs, GAME_LOG_SCHEMA).select("playerId", "playerName", F.inline("gameLog")).select(
        F.col("gameId").cast("string").alias("game_id"), F.col("gameDate").try_cast("date").alias("game_date"),
        F.col("playerId").alias("player_id"), F.col("playerName").alias("player_name"),
        F.coalesce("teamAbbrev", F.lit("")).alias("team"), F.coalesce("opponentAbbrev", F.lit("")).alias("opponent"),
        F.coalesce("homeRoadFlag", F.lit("")).alias("home_road"), S.mmss_seconds(F.col("toi")).alias("toi_seconds"),
        *[F.coalesce(f, F.lit(0)).alias(c) for f, c in GAME_LOG_FIELDS.items()])


def rosters(docs: DataFrame) -> DataFrame:
    """Three position lists to one row per player."""
    lists = F.concat(*[F.coalesce(F.col(g), F.array()) for g in ("forwards", "defensemen", "goalies")])
    return readable(docs, ROSTER_SCHEMA).select("team", F.inline(lists)).select(
        "team", F.col("id").alias("player_id"), F.concat_ws(" ", "firstName.default", "lastName.default").alias("player_name"),
        F.coalesce("positionCode", F.lit("")).alias("position"))


def bookmaker_odds(docs: DataFrame) -> DataFrame:
    """(game, bookmaker) rows with both opening prices and fair probabilities.

    This feed rounds the raw probabilities before removing the margin.
    """
    books = readable(docs, ODDS_SCHEMA).select("id", "home_team", "away_team", "commence_time", F.inline("bookmakers"))
    h2h = F.try_element_at(F.filter("markets", lambda m: m["key"] == "h2h"), F.lit(-1))["outcomes"]

    def price(team: str) -> Column:
        return parse_american(F.try_element_at(F.filter("outcomes", lambda o: o["name"] == F.col(team)), F.lit(-1))["price"])

    rows = books.select("id", "home_team", "away_team", "commence_time", F.col("key").alias("book"), h2h.alias("outcomes"))
    rows = rows.select("id", "home_team", "away_team", "commence_time", "book",
                       price("home_team").alias("open_home_ml"), price("away_team").alias("open_away_ml"))
    home, away = fair_pair(F.col("open_home_ml"), F.col("open_away_ml"), round_first=True, digits=4)
    both = implied_prob(F.col("open_home_ml"), 4).isNotNull() & implied_prob(F.col("open_away_ml"), 4).isNotNull()
    return rows.select("*", F.when(both, home).alias("open_home_prob"), F.when(both, away).alias("open_away_prob"))


def book_lines(docs: DataFrame, books: Mapping[str, str]) -> DataFrame:
    """(game, book) rows from a map of markets.

    Live moneylines are dropped, unknown books and books without both
    moneylines are skipped, totals and spreads are read per side, statuses and
    team codes are normalised.
    """
    def last(entries: Column, test) -> Column:
        return F.try_element_at(F.filter(entries, test), F.lit(-1))

    def code(team_id: str) -> Column:
        abbr = F.upper(F.coalesce(last(F.col("teams"), lambda t: t["id"] == F.col(team_id))["abbr"], F.lit("")))
        out = abbr
        for source, target in TEAM_CODES.items():
            out = F.when(abbr == source, target).otherwise(out)
        return out

    status = F.when(F.col("status").isin(SCHEDULED), "scheduled").when(
        F.col("status").isin(COMPLETE), "complete").otherwise("in_progress")
    games = readable(docs, LINES_SCHEMA).where(F.col("type").isin("reg", "post")).select(
        "id", code("home_team_id").alias("home_team"), code("away_team_id").alias("away_team"), status.alias("status"),
        "start_time", "home_team_id", "away_team_id", F.explode("markets").alias("book_id", "market"))
    name = F.lit(None).cast("string")
    for book_id, book in books.items():
        name = F.when(F.col("book_id") == book_id, book).otherwise(name)

    def team(market: str, side: str, live_too: bool = True) -> Column:
        return last(F.col(f"market.event.{market}"), lambda e: (e["team_id"] == F.col(f"{side}_team_id"))
                    & (F.lit(live_too) | ~F.coalesce(e["is_live"], F.lit(False))))

    def total(side: str) -> Column:
        return last(F.col("market.event.total"), lambda e: e["side"] == side)

    rows = games.select(
        "id", "home_team", "away_team", "status", "start_time", name.alias("book"),
        team("moneyline", "home", False)["odds"].alias("home_ml"), team("moneyline", "away", False)["odds"].alias("away_ml"),
        total("over")["value"].alias("total"), total("over")["odds"].alias("total_over_ml"),
        total("under")["odds"].alias("total_under_ml"),
        *[team("spread", s)[f].alias(f"{s}_spread{suffix}") for s in ("home", "away") for f, suffix in (("value", ""), ("odds", "_ml"))])
    rows = rows.where(F.col("book").isNotNull() & F.col("home_ml").isNotNull() & F.col("away_ml").isNotNull())
    home, away = fair_pair(F.col("home_ml"), F.col("away_ml"), digits=4)
    return rows.select("*", home.alias("prob_home_win"), away.alias("prob_away_win"))

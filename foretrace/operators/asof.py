"""As-of merges: what was known of an entity at the time of each question.

Questions and events are one table, sorted once by (key, time). Each event
carries its newest values, and the window takes the last ones seen down to the
questions that follow. So any number of serving times costs one shuffle and one
sort, no range join. A hot key is cut into chunks like any history, and a chunk
starts with the last values of the chunks before it.

An event at the very time of a question is not yet known. Questions with a null
key or time find nothing; events with one are never found. Questions may repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.functions import scalars as S
from foretrace.operators.features import DEFAULT_REST, PAIR_WINDOW
from foretrace.operators.history import Latest, Recent, with_history
from foretrace.session import bounded


def known_before(
    questions: DataFrame, events: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], name: str, newest: int = 1,
    ties: Sequence[str] = (), **sizes,
) -> DataFrame:
    """``questions`` with ``name``: structs of ``values`` of the ``newest`` events before each, the newest last.

    ``time`` and ``keys`` are columns of both; ``ties`` order events of one time
    and must make their order total. Null where no event is known. ``sizes`` go to
    ``with_history``.
    """
    keys = list(keys)
    placed = F.col(time).isNotNull()
    for k in keys:
        placed = placed & F.col(k).isNotNull()
    tie = F.struct(*[F.col(t) for t in ties]) if ties else F.struct(F.lit(0))
    past = events.where(placed).select(*keys, F.col(time).alias("_time"), F.lit(1).alias("_kind"), tie.alias("_tie"), F.struct(*values).alias("_values"))
    if newest > 1:
        past = with_history(past, keys, ["_time", "_tie"], [Recent("_before", "_values", newest - 1)], **sizes)
        past = past.withColumn("_values", F.concat("_before", F.array("_values"))).drop("_before")
    else:
        past = past.withColumn("_values", F.array("_values"))
    asked = F.struct(*[F.col(f"`{c}`") for c in questions.columns])
    # A question sorts before the events of its own time.
    asks = questions.where(placed).select(*keys, F.col(time).alias("_time"), F.lit(0).alias("_kind"), asked.alias("_question"))
    both = past.unionByName(asks, allowMissingColumns=True)
    found = with_history(both, keys, ["_time", "_kind", "_tie"], [Latest("_found", "_values")], **sizes)
    found = found.where(F.col("_question").isNotNull()).select("_question.*", F.col("_found").alias(name))
    nothing = questions.where(~placed).withColumn(name, F.lit(None).cast(found.schema[name].dataType))
    return found.unionByName(nothing)


def rest_days(legs: DataFrame, sides: DataFrame, **sizes) -> DataFrame:
    """``legs`` (team_id, game_date, ...) with rest_days since the team's last event before each date."""
    days = sides.select("team_id", "game_date").distinct()
    found = known_before(legs, days.withColumn("last_date", F.col("game_date")), ["team_id"], "game_date", ["last_date"], "_last", **sizes)
    return found.withColumn("rest_days", F.datediff("game_date", F.col("_last")[0]["last_date"]).cast("bigint")).drop("_last")


def meeting_rate(slate: DataFrame, matches: DataFrame, n: int = PAIR_WINDOW, **sizes) -> DataFrame:
    """``slate`` (home_id, away_id, game_date, ...) with the home win rate of the pair's last ``n`` meetings before each date.

    The ``n`` newest are taken first and unknown results dropped afterwards.
    """
    pair = S.pair_key(F.col("home_id"), F.col("away_id"))
    known = F.col("home_id").isNotNull() & F.col("away_id").isNotNull()
    asks = slate.withColumn("_pair", F.when(known, pair))
    past = matches.where(known).select(pair.alias("_pair"), "game_date", F.col("game_id").alias("_past"), "home_win")
    found = known_before(asks, past, ["_pair"], "game_date", ["home_win"], "_met", n, ["_past"], **sizes)
    wins = F.filter(F.transform("_met", lambda m: m["home_win"]), lambda w: w.isNotNull())
    rate = F.when(F.size(wins) > 0, F.aggregate(wins, F.lit(0.0), lambda a, w: a + w) / F.size(wins))
    return found.withColumn(f"h2h_home_win_rate_l{n}", rate).drop("_pair", "_met")


def slate_contexts(slate: DataFrame, sides: DataFrame, matches: DataFrame, openers: DataFrame, **sizes) -> DataFrame:
    """``slate_context`` of games on any number of days, each as known before its own ``game_date``.

    ``openers`` has (season, season_opener), a row a season. ``game_id`` is unique in ``slate``.
    """
    legs = slate.select("game_id", "game_date", F.inline(F.array(*[
        F.struct(F.lit(s).alias("_side"), F.col(f"{s}_id").alias("team_id")) for s in ("home", "away")])))
    rested = rest_days(legs, sides, **sizes)
    rested = rested.groupBy("game_id").agg(*[
        F.max(F.when(F.col("_side") == s, F.col("rest_days"))).alias(f"{s}_rest_days") for s in ("home", "away")])
    rows = meeting_rate(slate, matches, **sizes).join(rested, "game_id").join(bounded(openers), "season", "left")
    return rows.select(
        *slate.columns, "home_rest_days", "away_rest_days",
        *[F.coalesce(F.col(f"{s}_rest_days") == 1, F.lit(False)).cast("bigint").alias(f"{s}_back_to_back") for s in ("home", "away")],
        (F.coalesce("home_rest_days", F.lit(DEFAULT_REST)) - F.coalesce("away_rest_days", F.lit(DEFAULT_REST))).alias("rest_advantage"),
        F.datediff("game_date", "season_opener").cast("bigint").alias("season_day"), f"h2h_home_win_rate_l{PAIR_WINDOW}")

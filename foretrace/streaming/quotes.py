"""Event-time consensus of perishable prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.functions.odds import fair_pair, mean_half_even


def windowed_consensus(quotes: DataFrame, width: str = "1 day", delay: str = "1 day", stamp: str = "quoted_at") -> DataFrame:
    """Consensus per game and time window from each book's latest quote.

    Two aggregations in a row: the newest quote per (window, game, book), then
    the mean over books. The watermark closes windows and frees their state.
    Works on a stream and on a batch alike.
    """
    home, away = fair_pair(F.col("home_ml"), F.col("away_ml"), digits=4)
    newest = (
        quotes.withWatermark(stamp, delay)
        .groupBy(F.window(stamp, width), "game_id", "book")
        .agg(F.max_by(F.struct(home.alias("h"), away.alias("a")), stamp).alias("q"))
    )
    return (
        newest.groupBy(F.window(F.window_time("window"), width).alias("window"), "game_id")
        .agg(mean_half_even(F.col("q.h"), 4).alias("prob_home_win"), mean_half_even(F.col("q.a"), 4).alias("prob_away_win"),
             F.count("*").alias("n_books"))
        .select(F.col("window.start").alias("window_start"), "game_id", "prob_home_win", "prob_away_win", "n_books")
    )

"""Studies on scored rows: resampled differences, pairs of players, reports by experience."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.functions import scalars as S
from foretrace.operators.scoring import edge_realization_rows
from foretrace.session import ship_by_value

ship_by_value(__name__)

EXPERIENCE_EDGES = [0, 10, 20, 40]
# Cumulative Poisson(1) probabilities of 0, 1, 2, ... draws.
POISSON_STEPS = [0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173, 0.999405815182]


def experience(games: Column, edges: Sequence[int] = EXPERIENCE_EDGES) -> Column:
    """Bucket of games played, named by its lower edge."""
    out = F.lit(None).cast("bigint")
    for edge in edges:
        out = F.when(games >= edge, F.lit(edge).cast("bigint")).otherwise(out)
    return out


def by_experience(scored: DataFrame, games: str = "games_played") -> DataFrame:
    """Brier of played rows and feature coverage of all, per bucket of games played."""
    rows = scored.where(F.col(games).isNotNull())
    return rows.groupBy(experience(F.col(games)).alias("bucket")).agg(
        F.count("*").alias("n"), F.count("brier").alias("n_played"), F.avg("brier").alias("brier"), F.avg("feature_coverage").alias("mean_coverage"),
        F.avg((F.col("feature_coverage") >= S.MIN_FEATURE_COVERAGE).cast("double")).alias("share_covered"))


# Multipliers of a published 32-bit finalizer, and 2^32 over the golden ratio.
MIX = (0x85EBCA6B, 0xC2B2AE35)
GOLDEN = 0x9E3779B1
# Rows weighed at once.
BOOTSTRAP_ROWS = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """32-bit numbers, every bit of the result depending on every bit of the input."""
    low = np.uint64(0xFFFFFFFF)
    x = (x ^ (x >> np.uint64(16))) * np.uint64(MIX[0]) & low
    x = (x ^ (x >> np.uint64(13))) * np.uint64(MIX[1]) & low
    return x ^ (x >> np.uint64(16))


def bootstrap_weights(keys: np.ndarray, replicates: int) -> np.ndarray:
    """How often each resample draws each row: Poisson(1) of a hash of (row, replicate). Column 0 is the sample itself."""
    low, k = np.uint64(0xFFFFFFFF), keys.astype(np.int64).view(np.uint64)
    row = mixed(mixed((k >> np.uint64(32)) + np.uint64(GOLDEN) & low) ^ (k & low))
    u = mixed(row[:, None] + np.arange(replicates + 1, dtype=np.uint64) * np.uint64(GOLDEN) & low) / 2.0 ** 32
    weights = np.searchsorted(POISSON_STEPS, u, side="right")
    weights[:, 0] = 1
    return weights


def replicate_sums(rows: DataFrame, replicates: int) -> DataFrame:
    """(n, sums, weights): one row a task, arrays by replicate; ``rows`` has (d, k)."""
    def run(batches):
        n, sums, weights = 0, np.zeros(replicates + 1), np.zeros(replicates + 1, np.int64)
        for batch in batches:
            d, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, len(d), BOOTSTRAP_ROWS):
                drawn = bootstrap_weights(k[at:at + BOOTSTRAP_ROWS], replicates)
                sums += d[at:at + BOOTSTRAP_ROWS] @ drawn
                weights += drawn.sum(0)
            n += len(d)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([sums]), "weights": pa.array([weights])})

    return rows.select("d", "k").mapInArrow(run, "n bigint, sums array<double>, weights array<bigint>")


def brier_difference(scored: DataFrame, replicates: int = 200, price: str = "closing_prob_home", key: str = "game_id") -> DataFrame:
    """Mean Brier difference to the market and its bootstrap interval, one row.

    No row is copied: a task keeps one array of sums by replicate, and only these
    arrays are shuffled. ``key`` is a whole number (null counts as 0).
    """
    played = scored.where(F.col("brier").isNotNull() & F.col(price).isNotNull() & F.col("actual_home_win").isNotNull())
    d = F.col("brier") - F.pow(F.col(price) - F.col("actual_home_win"), F.lit(2))
    tasks = replicate_sums(played.select(d.cast("double").alias("d"), F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("k")), replicates)
    apart = tasks.select("n", F.posexplode(F.arrays_zip("sums", "weights")).alias("replicate", "x"))
    means = apart.groupBy("replicate").agg(F.sum("n").alias("n"), F.try_divide(F.sum("x.sums"), F.sum("x.weights")).alias("mean"))
    again = F.when(F.col("replicate") > 0, F.col("mean"))
    return means.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max(F.when(F.col("replicate") == 0, F.col("mean"))).alias("difference"),
        F.percentile(again, F.lit(0.025)).alias("low"), F.percentile(again, F.lit(0.975)).alias("high"))


def pair_lift(players: DataFrame, stat: str = "sog", least_games: int = 5) -> DataFrame:
    """Correlation of two team-mates' counts and how much oftener both have one than by chance.

    The self join meets players of one team in one game only and is summed at
    once; a game has a bounded number of them.
    """
    rows = players.where(F.col("player_id").isNotNull()).select("game_id", "team_id", "player_id", F.col(stat).cast("double").alias("x"))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, F.expr("a.game_id = b.game_id AND a.team_id = b.team_id AND a.player_id < b.player_id"))
    hit_a, hit_b = (F.col("a.x") >= 1).cast("double"), (F.col("b.x") >= 1).cast("double")
    out = met.groupBy(F.col("a.player_id").alias("p1"), F.col("b.player_id").alias("p2")).agg(
        F.count("*").alias("n"), F.avg(hit_a * hit_b).alias("both"), F.avg(hit_a).alias("h1"), F.avg(hit_b).alias("h2"),
        F.avg(F.col("a.x") * F.col("b.x")).alias("xy"), F.avg("a.x").alias("mx"), F.avg("b.x").alias("my"),
        F.avg(F.pow(F.col("a.x"), F.lit(2))).alias("xx"), F.avg(F.pow(F.col("b.x"), F.lit(2))).alias("yy"))
    spread = F.sqrt(F.greatest((F.col("xx") - F.col("mx") * F.col("mx")) * (F.col("yy") - F.col("my") * F.col("my")), F.lit(0.0)))
    return out.where(F.col("n") >= least_games).select(
        "p1", "p2", "n", F.when(spread > 1e-9, (F.col("xy") - F.col("mx") * F.col("my")) / spread).alias("correlation"),
        F.try_divide(F.col("both"), F.col("h1") * F.col("h2")).alias("lift"))


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value, by a rational approximation of the error function (error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return series * F.exp(-x * x)


def edge_p_values(scored: DataFrame, price: str = "closing_prob_home") -> DataFrame:
    """Per bucket of claimed edge: wins against what the price expected, with a p-value."""
    rows = edge_realization_rows(scored, price)
    sums = rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("won").alias("wins"), F.sum("market_p").alias("expected"), F.sum(F.col("market_p") * (1 - F.col("market_p"))).alias("variance"))
    z = F.try_divide(F.col("wins") - F.col("expected"), F.sqrt("variance"))
    return sums.select("bucket", "n", "wins", "expected", z.alias("z"), two_sided_p(z).alias("p_value"))

"""Reports composed from scored rows and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretrace.operators import scoring as E
from foretrace.operators.features import CAREER
from foretrace.operators.history import first_per_group
from foretrace.session import bounded, pin


def leaderboard(ratings: DataFrame, value: str, top: int) -> DataFrame:
    """Top entities with rank, mean and range. Windows see ``top`` rows only."""
    best = ratings.orderBy(F.desc(value), "team_id").limit(top)
    everyone = Window.partitionBy(F.lit(0))
    ranked = Window.partitionBy(F.lit(0)).orderBy(F.desc(value), "team_id")
    return best.select(
        F.row_number().over(ranked).cast("bigint").alias("place"), "team_id", value,
        F.avg(value).over(everyone).alias(f"mean_{value}"), F.max(value).over(everyone).alias(f"top_{value}"),
        F.min(value).over(everyone).alias(f"bottom_{value}"))


def entity_recap(facts: DataFrame, starts: DataFrame, n: int = 10) -> DataFrame:
    """Record and means of each team's last ``n`` games, with its last starter.

    Losses are counted, so a team with fewer games gets its true record.
    """
    newest = [F.desc(c) for c in CAREER]
    recent = first_per_group(facts, ["team_id"], newest, n).groupBy("team_id").agg(
        F.count("*").alias("n_games"), F.sum("won").cast("bigint").alias("wins"),
        (F.count("*") - F.sum("won")).cast("bigint").alias("losses"), F.avg("goals_for").alias("avg_gf"),
        F.avg("goals_against").alias("avg_ga"), F.avg("xgf_pct").alias("avg_xgf_pct"))
    last = starts.groupBy("team_id").agg(F.max_by("goalie_id", F.struct(*CAREER)).alias("goalie_id"))
    form = first_per_group(starts.join(last, ["team_id", "goalie_id"], "left_semi"), ["team_id", "goalie_id"], newest, n)
    form = form.groupBy("team_id", "goalie_id").agg(F.avg("save_pct").alias("goalie_sv_pct_l10"))
    return recent.join(form, "team_id", "left")


def freshness(played: DataFrame, dated: DataFrame) -> DataFrame:
    """Flag seasons where fewer games are dated than played."""
    p = played.groupBy("season").agg(F.countDistinct("game_id").alias("played"))
    d = dated.groupBy("season").agg(F.count("*").alias("dated"))
    out = p.join(d, "season", "left").withColumn("dated", F.coalesce("dated", F.lit(0)))
    return out.withColumn("stale", F.col("dated") < F.col("played"))


def history_report(scored: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """Every log report, per model and season where that makes sense.

    The log is scored and written out once; each report is one aggregate over that.
    """
    by, scored = ["model_name"], pin(scored)
    return {
        "summary": E.summarize(scored, by), "by_season": E.summarize(scored, [*by, "season"]),
        "calibration": E.calibration_table(scored, by), "tiers": E.tier_breakdown(scored, by),
        "market": E.market_comparison(scored, by=by), "edges": E.edge_realization(scored, by=by),
        "clv": E.clv_summary(scored, by), "recent": E.recent_form(scored, order),
        "coverage": E.coverage_stats(scored),
    }


def edge_report(slate: DataFrame, scored: DataFrame, min_edge: float = E.MIN_EDGE) -> dict[str, DataFrame]:
    """Tonight's ranked disagreements, with what earlier ones were worth."""
    return {"edges": E.edge_ranking(slate, min_edge), "realization": E.edge_realization(scored), "clv": E.clv_summary(scored)}


def day_report(scored: DataFrame, day: DataFrame | None = None) -> dict[str, DataFrame]:
    """Record, market comparison, picks and strong misses of one night."""
    day = E.latest_played_date(scored) if day is None else day
    night = scored.join(bounded(day), "game_date", "left_semi")
    games = E.day_games(scored, day)
    return {"summary": E.summarize(night), "market": E.market_comparison(night), "games": games,
            "strong_misses": games.where("strong_miss")}

"""Table merges as joins, and logs that keep the newest row per key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the largest ``order`` per key.

    An aggregate over a struct: it combines on the map side, so a key that
    holds a large part of the rows costs one row per task after the first pass.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def oldest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the smallest ``order`` per key (keep-first)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def insert_only(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` whose key is new join the target; the rest is dropped."""
    return target.unionByName(source.join(target.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def _outer(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(f"t.{k}") == F.col(f"s.{k}"))
    return t.join(s, condition, "full_outer")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], policy: str = "replace",
           always: Sequence[str] = ()) -> DataFrame:
    """Merge ``source`` (one row per key) into ``target``.

    ``replace``: source values win wherever a source row exists, nulls too.
    ``coalesce``: a non-null source value wins; columns in ``always`` are
    replaced regardless. Columns the source lacks keep the target's value.
    """
    joined = _outer(target, source, keys)
    out: list[Column] = []
    for c in target.columns:
        if c in keys:
            value = F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}"))
        elif c not in source.columns:
            value = F.col(f"t.{c}")
        elif policy == "replace" or c in always:
            value = F.when(F.col("s._s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))
        elif policy == "coalesce":
            value = F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}"))
        else:
            raise ValueError(f"unknown policy {policy}")
        out.append(value.alias(c))
    return joined.select(*out)


def update_only(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overwrite matched rows; source rows without a target are dropped."""
    changed = [c for c in source.columns if c not in keys]
    s = source.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in changed], F.lit(True).alias("_hit"))
    joined = target.join(s, list(keys), "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
        for c in target.columns
    ])


def keep_latest(log: DataFrame, batch: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """Append ``batch`` and keep the newest row per key; the batch wins ties."""
    both = log.withColumn("_seq", F.lit(0)).unionByName(batch.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return newest(both, keys, [stamp, "_seq"]).drop("_seq")


def by_priority(sources: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """First source with a non-null ``value`` per key, in list order."""
    ranked = [df.select(*keys, value, F.lit(i).alias("_p")) for i, df in enumerate(sources)]
    union = ranked[0]
    for other in ranked[1:]:
        union = union.unionByName(other)
    return union.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, "_p").alias(value))


def catch_up_start(results: DataFrame, opener: date, overlap_days: int = 7) -> date:
    """Date to read from again: a week before the newest result, never before the opener.

    One date reaches the driver; as a literal it prunes files and partitions.
    """
    known = results.where(F.col("home_win").isNotNull() & (F.col("game_date") >= F.lit(opener)))
    newest_day = known.agg(F.max("game_date")).first()[0]
    return opener if newest_day is None else max(opener, newest_day - timedelta(days=overlap_days))


def finished(schedule: DataFrame, states: Sequence[str], types: Sequence[str] = ("R", "P")) -> DataFrame:
    """Final regular-season and playoff games with both scores, one row per game."""
    done = schedule.where(
        F.col("game_state").isin(list(states)) & F.col("game_type").isin(list(types))
        & F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    return done.dropDuplicates(["game_id"])

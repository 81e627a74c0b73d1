"""The prediction log as a stream: append, drop late rows, keep the newest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.sources.merge import newest


class PredictionLog:
    """An append-only table of batches with a keep-latest view.

    Each micro-batch overwrites its own folder, so a batch that is delivered
    twice is stored once. Nothing already stored is rewritten; ``latest``
    reduces on read and ``compact`` writes a reduced copy.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("game_id", "model_name"), stamp: str = "predicted_at"):
        self.spark, self.path, self.keys, self.stamp = spark, path, list(keys), stamp

    def append(self, batch: DataFrame, batch_id: int) -> None:
        reduced = newest(batch, self.keys, [self.stamp])
        reduced.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def latest(self) -> DataFrame:
        rows = self.spark.read.option("basePath", self.path).option("mergeSchema", True).parquet(self.path)
        return newest(rows, self.keys, [self.stamp, "batch"]).drop("batch")

    def compact(self, path: str) -> None:
        self.latest().write.mode("overwrite").parquet(f"{path}/batch=0")


def before_start(predictions: DataFrame, schedule: DataFrame, stamp: str = "predicted_at", delay: str | None = None) -> DataFrame:
    """Keep predictions stamped before their event starts.

    ``schedule`` is static with (game_id, start_time); an event that is not on
    it is kept. With ``delay`` repeated deliveries of the same row are dropped
    within that watermark, which also bounds the state.
    """
    rows = predictions
    if delay:
        rows = rows.withWatermark(stamp, delay).dropDuplicatesWithinWatermark(["game_id", "model_name", "run"])
    starts = schedule.groupBy("game_id").agg(F.min("start_time").alias("_start"))
    joined = rows.join(starts, "game_id", "left")
    return joined.where(F.col("_start").isNull() | (F.col(stamp) < F.col("_start"))).drop("_start")

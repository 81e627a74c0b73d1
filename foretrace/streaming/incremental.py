"""Pre-event features by micro-batch, without Python state.

Where a single entity may fill a micro-batch, keyed state would order all its
rows in one task. Here each micro-batch is joined by the last rows of every
entity and runs through ``with_history``, which splits hot keys into chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.operators.history import Decayed, Feature, Total, first_per_group, reach_of, with_history
from foretrace.session import pin


class RollingBatches:
    """Features of bounded reach over an unbounded stream of events.

    ``rows/batch=N`` holds the output of micro-batch N, ``tails/batch=N`` the
    last rows of each entity after it. Both are overwritten when a batch is
    delivered again, and a batch reads the tails of the one before, so the
    result does not depend on retries.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], features: Sequence[Feature],
                 split_rows: int | None = None, chunk_rows: int | None = None):
        if any(isinstance(f, (Decayed, Total)) for f in features):
            raise ValueError("only features with a bounded frame can run from tails")
        self.spark, self.path, self.features = spark, path, list(features)
        self.keys, self.order = list(keys), list(order)
        self.sizes = {"split_rows": split_rows, "chunk_rows": chunk_rows}

    def append(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_new", F.lit(True))
        if batch_id > 0:
            before = self.spark.read.schema(batch.schema).parquet(f"{self.path}/tails/batch={batch_id - 1}")
            rows = rows.unionByName(before.withColumn("_new", F.lit(False)))
        rows = pin(rows)
        rolled = with_history(rows, self.keys, self.order, self.features, **self.sizes)
        rolled.where("_new").drop("_new").write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
        newest = first_per_group(rows.drop("_new"), self.keys, [F.desc(c) for c in self.order], reach_of(self.features))
        newest.write.mode("overwrite").parquet(f"{self.path}/tails/batch={batch_id}")

    def rows(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows").drop("batch")

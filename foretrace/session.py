"""Session helpers: shared checkpoint folder, null handling, plan inspection."""

from __future__ import annotations

import io
import re
import sys
import tempfile
import uuid
from contextlib import redirect_stdout

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and landed tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    local session gets a temporary folder; on a cluster it is an error, since
    other machines couldn't read such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foretrace-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; nothing is ever overwritten there."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ship_by_value(module_name: str) -> None:
    """Send a module's functions to the Python workers with the job itself.

    Executors then need numpy and pandas but no copy of this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def pin(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that survives executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str = "rows") -> DataFrame:
    """The same rows as a compressed table under the shared folder.

    For wide rows that are read more than once: a checkpoint holds them
    uncompressed, and a reader of a few columns reads them all.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


BROADCAST_BYTES = 8 << 20


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a small aggregate after measuring it; leave a large one to AQE.

    Meant for lookups keyed by few values (seasons, folds): shuffling the large
    side on such a key would pile it onto a few tasks. The table is pinned, so
    it is computed once.
    """
    table = pin(df)
    wide = [F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)) for c, t in table.dtypes if t in ("string", "binary") or "<" in t]
    size = table.agg(F.count("*").alias("rows"), sum(wide, F.lit(0)).alias("bytes")).first()
    return F.broadcast(table) if size["rows"] * 8 * (1 + len(table.columns)) + size["bytes"] <= limit else table


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column, once, at the source."""
    floating = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(
        *[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in floating else F.col(c) for c in df.columns]
    )


def explained(df: DataFrame) -> str:
    """The formatted physical plan as text, for plan assertions."""
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()

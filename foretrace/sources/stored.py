"""Histories stored by entity, so that windows over them need no shuffle.

A table bucketed by its entity has every row of an entity in one file. Spark
then knows where rows are: windows, aggregates and joins of equally bucketed
tables on the entity, alone or with more columns, read without an exchange. One
shuffle is paid when the table is written instead of one per query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def save_bucketed(df: DataFrame, path: str, name: str, keys: Sequence[str], order: Sequence[str], buckets: int) -> DataFrame:
    """Write ``df`` as table ``name`` in ``path``, one sorted file per bucket, and return it.

    Rows are first dealt by the function that numbers the buckets, so that no
    task writes to several. Rows with a null key share a bucket. An existing
    table or folder is an error.
    """
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys, *order)
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *order).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def bucketed_table(spark: SparkSession, path: str, name: str, keys: Sequence[str], order: Sequence[str], buckets: int) -> DataFrame:
    """The table ``name``; a session whose catalog lacks it learns the layout of the files in ``path``.

    ``keys``, ``order`` and ``buckets`` must be those it was written with: file
    names carry the bucket number, and Spark relies on it.
    """
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        listed = [", ".join(f"`{c}`" for c in names) for names in (keys, [*keys, *order])]
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({listed[0]}) SORTED BY ({listed[1]}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)

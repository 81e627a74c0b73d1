"""Merges into a stored, partitioned table that touch what they must.

Only partitions that the source has rows for are read and written again; the
others are neither listed as input nor replaced. Inside a touched partition,
rows that can't match pass by the join: small key sets are broadcast, larger
ones become a bitmap of hashed keys, 16 bits a key, that lets about one row in
16 through by mistake, which the join then finds unmatched. Beyond
``FILTER_BYTES`` all rows of the touched partitions are joined.

The merged rows are written aside first and then replace their partitions, so a
run that fails leaves the table as it was. An insert reads keys alone and
appends. A key's rows stay in one partition, so the partition column counts as
part of the key; null keys match nothing. The source has one row per key. Its
distinct partition values reach the driver, at most the partitions of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.session import bounded, fresh_path, pin
from foretrace.sources.merge import update_only, upsert
from foretrace.sources.scans import save_table

FILTER_BYTES = 64 << 20
BITS_PER_KEY = 16
# Bits in one bitmap of ``bitmap_construct_agg``.
BITMAP_BITS = 32768


def in_partitions(table: DataFrame, by: str, values: Sequence) -> DataFrame:
    """Rows of the given partitions; a literal filter, so others are pruned before any file is opened."""
    chosen = F.col(by).isin([v for v in values if v is not None])
    return table.where(chosen | F.col(by).isNull() if None in values else chosen)


def _slot(keys: Sequence[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1


def key_bitmaps(source: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """(bucket, bitmap) of the hashed keys, 4 KB each, at most bits / 32,768 rows."""
    slots = source.select(_slot(keys, bits).alias("slot"))
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))


def split_by_keys(rows: DataFrame, source: DataFrame, keys: Sequence[str], n: int, broadcast_bytes: int, filter_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows that may match a key of the source, rows that can't); None where no filter is worth its size."""
    keys = list(keys)
    if n * 32 * len(keys) <= broadcast_bytes:
        wanted = bounded(source.select(*keys), broadcast_bytes)
        return rows.join(wanted, keys, "left_semi"), rows.join(wanted, keys, "left_anti")
    bits = max(BITMAP_BITS, 1 << (BITS_PER_KEY * n - 1).bit_length())
    if bits // 8 > filter_bytes:
        return rows, None
    bitmaps = bounded(key_bitmaps(source, keys, bits), 2 * filter_bytes)
    slot = _slot(keys, bits)
    placed = rows.withColumn("bucket", F.bitmap_bucket_number(slot)).withColumn("_bit", F.bitmap_bit_position(slot))
    byte = F.conv(F.hex(F.expr("substring(bitmap, CAST(_bit div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(_byte, CAST(_bit % 8 AS INT)) & 1") == 1, F.lit(False))
    marked = placed.join(bitmaps, "bucket", "left").withColumn("_byte", byte).withColumn("_hit", hit)
    return marked.where("_hit").select(*rows.columns), marked.where("NOT _hit").select(*rows.columns)


def merge_stored(
    spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], by: str = "season", policy: str = "replace", always: Sequence[str] = (),
    broadcast_bytes: int = 8 << 20, filter_bytes: int = FILTER_BYTES,
) -> list:
    """Merge ``source`` into the table at ``path``, partitioned by ``by``; the touched partitions.

    ``policy``: ``replace`` and ``coalesce`` as in ``upsert``, ``update`` as in
    ``update_only``, ``insert`` as in ``insert_only``.
    """
    source = pin(source)
    touched = [r[0] for r in source.select(by).distinct().collect()]
    if not touched:
        return []
    stored = spark.read.parquet(path)
    rows = in_partitions(stored, by, touched)
    rows = rows.withColumn(by, F.col(by).cast(source.schema[by].dataType))
    match = [*[k for k in keys if k != by], by]
    if policy == "insert":
        source.join(rows.select(*match), match, "left_anti").write.mode("append").partitionBy(by).parquet(path)
        return touched
    may, rest = split_by_keys(rows, source, match, source.count(), broadcast_bytes, filter_bytes)
    merged = update_only(may, source, match) if policy == "update" else upsert(may, source, match, policy, always)
    aside = fresh_path(spark, "merged")
    (merged if rest is None else merged.unionByName(rest)).write.partitionBy(by).parquet(aside)
    save_table(spark.read.schema(merged.schema).parquet(aside), path, (by,))
    return touched

"""Helpers the training-data operators share: words, Arrow columns, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from foretrace.session import ship_by_value

ship_by_value(__name__)

# Rows of texts in an Arrow batch, where a query or stage sets it.
BATCH_ROWS = 500
# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def words(text: Column) -> Column:
    """All words of a text as an array (null text: null)."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without(text: Column, characters) -> Column:
    """The text with every one of the given characters removed."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once, however often body reads it.

    The optimizer inlines a column that a lambda names once, although the
    lambda runs per element; a lambda variable is never inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replacing(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns; those of the same name in any case are replaced."""
    taken = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(n) for n, c in columns.items()])


def prepare(spark: SparkSession) -> None:
    """Send Python workers at most ``BATCH_ROWS`` rows at a time, for queries and stages over texts.

    Texts make rows long; the default of 10,000 rows would be held several
    times over by the JVM and by every worker. This is a setting of the
    session, so the application makes it; operators leave it alone.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def arrow_columns(
    df: DataFrame, keep: list[str], fields: list[StructField], prepare: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    gathered: bool = False,
) -> DataFrame:
    """Columns ``keep`` plus new ones that Python makes of each Arrow batch.

    ``prepare`` runs once per task and returns a function of a batch of ``df``;
    with ``gathered`` it gets small batches joined up to the size of a slice.
    Kept columns named like a new one (in any case) are dropped.
    """
    new = {f.name.lower() for f in fields}
    keep = [k for k in keep if k.lower() not in new]
    schema = StructType([df.schema[k] for k in keep] + fields)
    place = [df.columns.index(k) for k in keep]
    names = keep + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepare()
        for whole in joined(batches) if gathered else batches:
            for batch in slices(whole):
                made = work(batch)
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in place] + made, names=names)

    return df.mapInArrow(run, schema)


SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded bytes, a single long row staying whole."""
    rows = batch.num_rows
    if rows <= 1 or batch.nbytes <= most_bytes:
        yield batch
        return
    half = rows // 2
    yield from slices(batch.slice(0, half), most_bytes)
    yield from slices(batch.slice(half), most_bytes)


def joined(batches: Iterator[pa.RecordBatch], most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches in order, small ones joined as long as they hold no more bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(x.nbytes for x in held) + batch.nbytes > most_bytes:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


# Rows of a few numbers that one task reads at least.
TASK_ROWS = 1 << 18


def gathered(table: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table of short rows in no more partitions than its number of rows needs.

    Every exchange writes files per task; a small table that came out of many
    tasks would carry them through all that follows. Nothing is shuffled.
    """
    rows = table.count() if rows is None else rows
    return table.coalesce(max(1, -(-rows // TASK_ROWS)))


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def sampled(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most ``rows`` rows, always the same ones for the same table, by a hash of the key.

    Rows are counted, and a hash lets about half as many again as wanted pass
    before they are ordered: what meets in one task doesn't grow with the table.
    """
    total = df.count()
    if total > 2 * rows:
        df = df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 31)) < int((1 << 31) * 1.5 * rows / total))
    return df.orderBy(F.xxhash64(F.lit(1), *key), *key).limit(rows)

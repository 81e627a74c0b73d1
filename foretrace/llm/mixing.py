"""Mixing sources to target weights along a time-varying curriculum.

Each source has a schedule, its weight as a piecewise linear function of
training time, knots at strictly growing times from 0 to 1. Its integral is the source's share of all words; shares
stop at ``most_epochs`` times what the source has, and the excess goes to the
others by their share until none is above. The cumulative demand of a source is
its target times the integral of its schedule up to a time. Documents stand in
an order by hash within their source, each epoch after the other; inverting the
cumulative demand at the middle of a document's words gives its training
position. Documents are range-sorted by that position.

A source is cut into buckets of the order's hash. Sizes are summed per (source,
bucket) before any shuffle, buckets get their offsets from the small table of
sums, and only inside a bucket rows are ordered, so no source meets in one task.
The words taken of the last document end at the target's word, so a source
gives its target to the word (rounded to whole words). Its text is cut there in
``training_order``, or stays whole with the taken words beside it.

Defined results: null and empty texts have size 0 and take nothing; they have
no position and sort last. Null is a source of its own, the last in rank.
Repeated rows are documents of their own; rows that agree in id and text are
interchangeable. A table without words takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.llm.common import replacing, word_count

EPOCHS = 2
ROWS_PER_BUCKET = 5_000
# One word with the white space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def schedules(sources: DataFrame, cycle: list[list[tuple[float, float]]]) -> DataFrame:
    """Sources by code point, null last, with the schedules of ``cycle`` in turn, as knots (t, w)."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    knots = F.array(*[F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in one]) for one in cycle])
    return sources.withColumn("knots", F.get(knots, F.pmod(rank, F.lit(len(cycle)))))


def segments(knots: Column) -> Column:
    """Pieces of a schedule: start and end time, weights there, integral before and inside."""
    return F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: F.struct(
        F.get(knots, i - 1)["t"].alias("t0"), F.get(knots, i)["t"].alias("t1"), F.get(knots, i - 1)["w"].alias("w0"), F.get(knots, i)["w"].alias("w1"),
        F.aggregate(F.slice(knots, F.lit(1), i), F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("t"), F.lit(None).cast("double").alias("w")), lambda a, k: F.struct(
            (a["sum"] + F.coalesce((a["w"] + k["w"]) / 2 * (k["t"] - a["t"]), F.lit(0.0))).alias("sum"), k["t"].alias("t"), k["w"].alias("w")))["sum"].alias("before"),
    ))


def integral(pieces: Column) -> Column:
    """Integral of a whole schedule."""
    return F.aggregate(pieces, F.lit(0.0), lambda a, p: a + (p["w0"] + p["w1"]) / 2 * (p["t1"] - p["t0"]))


def inverse(pieces: Column, area: Column) -> Column:
    """The time at which the integral of a schedule reaches ``area``."""
    piece = F.get(F.filter(pieces, lambda p: p["before"] <= area), F.size(F.filter(pieces, lambda p: p["before"] <= area)) - 1)
    slope = (piece["w1"] - piece["w0"]) / (piece["t1"] - piece["t0"])
    rest = area - piece["before"]
    # rest = w0 x + slope x^2 / 2, in the form that stays exact as the slope goes to 0
    root = F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * slope * rest, F.lit(0.0)))
    return piece["t0"] + F.when(rest <= 0, F.lit(0.0)).otherwise(F.try_divide(2 * rest, piece["w0"] + root))


def targets(sources: DataFrame, share_percent: int = 150, most_epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, knots) with pieces, weight and target.

    The level at which weights fill up: with sources by the level that caps
    them, those up to some rank are full and the rest share what is left; the
    first rank that its level doesn't fill gives the level, which only falls from
    there on.
    """
    weighed = sources.withColumn("pieces", segments(F.col("knots"))).withColumn("weight", integral(F.col("pieces")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
    whole = Window.partitionBy()
    before = Window.orderBy(F.try_divide("cap", "weight").asc_nulls_last(), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole) * F.lit(share_percent / 100.0)
    filled = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = weighed.withColumn("level", F.try_divide(total - filled, open_weight))
    reached = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(whole)
    filling = level.withColumn("reached", reached)
    target = F.least("cap", F.coalesce(F.col("reached") * F.col("weight"), F.col("cap")))
    return filling.select("source", "source_size", "pieces", "weight", target.alias("target"))


def mix(
    docs: DataFrame, cycle: list[list[tuple[float, float]]], share_percent: int = 150, most_epochs: int = EPOCHS, text: str = "text",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``docs`` with size, source_size, target, taken and takes.

    ``takes`` has, for each epoch that takes words of the document, how many
    and the training position (0 to 1).
    """
    digest = F.md5(F.col(text).cast("binary"))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), digest, F.lit("")).cast("binary"))
    sized = replacing(docs, size=word_count(F.col(text)), _order=order, _text=digest)
    buckets = max(1, docs.count() // rows_per_bucket)
    sized = sized.withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * F.lit(buckets)).cast("int"))
    summed = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("bucket_size"))
    sources = summed.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    plan = targets(schedules(sources, cycle), share_percent, most_epochs).alias("p")
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = summed.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).alias("o")
    placed = offsets.join(plan, F.expr("o.source <=> p.source")).select("o.source", "o._bucket", "offset", "source_size", "pieces", "weight", "target").alias("o")
    taken = {"size", "source_size", "target", "taken", "takes"}
    keep = [c for c in docs.columns if c.lower() not in taken]
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "_text", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = sized.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
    joined = ordered.join(placed, F.expr("d.source <=> o.source AND d._bucket = o._bucket")).select(
        *[F.col(f"d.`{c}`") for c in keep], "d.size", (F.col("d._inside") + F.col("o.offset")).alias("_from"), "o.source_size", "o.pieces", "o.weight", "o.target")
    words = lambda epoch: F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - epoch * F.col("source_size") - F.col("_from")))
    takes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most_epochs - 1)), lambda epoch: F.struct(
        words(epoch).alias("words"),
        inverse(F.col("pieces"), F.least(F.lit(1.0), F.try_divide(epoch * F.col("source_size") + F.col("_from") + words(epoch) / 2, F.col("target"))) * F.col("weight")).alias("position"),
    )), lambda x: x["words"] > 0)
    return joined.select(*keep, "size", "source_size", "target", takes.alias("takes")).withColumn(
        "taken", F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"]))


def by_position(mixed: DataFrame) -> DataFrame:
    """Documents range-sorted by the position at which they first occur; those not taken last."""
    first = F.coalesce(F.get("takes", F.lit(0))["position"], F.lit(2.0))
    return mixed.withColumn("_first", first).repartitionByRange("_first", "doc_id").sortWithinPartitions("_first", "doc_id").drop("_first")


def training_order(mixed: DataFrame, text: str = "text", whole: bool = False) -> DataFrame:
    """One row for each time a document is taken, range-sorted by position.

    The text is cut where the target ends; with ``whole`` it stays as it is, and
    ``words`` tells how much of it the target asks for.
    """
    kept = [c for c in mixed.columns if c not in ("takes", "taken")]
    rows = mixed.select(*[f"`{c}`" for c in kept], F.inline("takes"))
    if whole:
        return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    rows = rows.withColumn(text, F.when(F.col("words") < F.col("size"), cut).otherwise(F.col(text)))
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")

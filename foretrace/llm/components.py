"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import gathered
from foretrace.session import fresh_path


def pairs(rows: DataFrame, *structs: Column) -> DataFrame:
    """Several (a, b) of each row, in the row's own partition: a union would double the partitions."""
    return rows.select(F.inline(F.array(*structs)))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node linked to the least of the node and its neighbours."""
    both = pairs(edges, F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours linked to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = [F.struct(F.col(c).alias("a"), F.col("m").alias("b")) for c in ("b", "a")]
    return pairs(down.join(least, "a"), *moved).where("a <> b").distinct()


def written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The links written to the shared folder, read by as many tasks as their number needs, and their count and sum."""
    path = fresh_path(edges.sparkSession, "links")
    edges.write.parquet(path)
    stored = edges.sparkSession.read.schema("a " + edges.schema["a"].dataType.simpleString() + ", b " + edges.schema["b"].dataType.simpleString()).parquet(path)
    seen = stored.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return gathered(stored, seen[0]), seen


def roots(links: DataFrame) -> DataFrame:
    """(a, b) for every linked node a that isn't the least of its component, b.

    The number of rounds grows with the logarithm of the longest path; each star
    is written to the shared folder, so that the next one is planned by its true
    size: few links are read by one task and need no shuffle.
    """
    edges, seen = written(links.where("a <> b").select("a", "b").distinct())
    while seen[0]:
        edges, now = written(small_star(written(large_star(edges))[0]))
        if now == seen:
            break
        seen = now
    return edges

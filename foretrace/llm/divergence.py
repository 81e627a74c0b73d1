r"""Source divergence audit with a frequent-pattern tree of term rows.

How far do the sources of a language differ in their use of words? Every source
and every language gives each kept term a smoothed share in parts of 10^9, and
two shares p, q differ by floor((p - q)^2 / (p + q)). A pair of sources sums
that over all kept terms; a source's most typical terms are those that it uses
more than its language does.

Most terms are absent from most sources, so a pair's sum is taken as

    all terms absent from both  +  corrections of terms that one of them has
                                +  corrections of terms that both have

The first two follow from the sizes of the sources and from how many terms a
source has how often. The last comes from the tree. A term's row lists its
nonzero counts in order of source; equal rows are one row with a multiplicity.
Rows are sorted, so rows with the same beginning are neighbours and a node, a
(source, count) after a given beginning, is a run of rows. Its correction with
each ancestor is made once, times the number of terms in the run. A batch of
rows is taken depth by depth, all its nodes of a depth at once. A run that the
border of a batch or partition cuts is two nodes whose terms add up to the same.

Texts never leave their task: tasks emit (language, source, term) counts of
chunks. The row of one term has an entry per source at most, and the result has a row
for each pair of sources; nothing else grows with the square of anything.
All arithmetic is in whole numbers: shares are divided as decimals of 38 digits.

Defined results: null text, language or source is ''; repeated rows count as
often as they occur; a source without terms has pairs but no typical terms; a
language without kept terms has value 0 for all pairs; ties rank by the item's
bytes; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from foretrace.llm.common import slices
from foretrace.session import bounded, pin, ship_by_value

ship_by_value(__name__)

# Letters of ASCII and all bytes of other characters, as UTF-8.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
# A chunk's counts are emitted when they hold so many terms, or come from so many bytes of text.
CHUNK_TERMS = 300_000
CHUNK_BYTES = 32 << 20
# Places in a table of rows by depth.
TABLE_ENTRIES = 1 << 20
# Entries of a row that range borders are drawn from.
BORDER_ENTRIES = 4
# Parts that the terms of one language are dealt into where they meet its sources.
SALTS = 16


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term."""
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    schema = StructType([StructField("lang", StringType()), StructField("source", StringType()), StructField("term", StringType()),
                         StructField("n", LongType()), StructField("docs", LongType())])

    def rows(counts: dict):
        for (lang, source), (total, held) in counts.items():
            n = len(total)
            yield pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(lang), n), pa.repeat(pa.scalar(source), n), pa.array(list(total), pa.binary()).cast(pa.string()),
                pa.array(total.values(), pa.int64()), pa.array(map(held.__getitem__, total), pa.int64())], names=schema.names)

    def count(batches):
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        terms = size = 0
        for whole in batches:
            for batch in slices(whole):
                for text, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
                    total, held = counts.setdefault((lang, source), (Counter(), Counter()))
                    found = TERM.findall((text or b"").lower())
                    terms -= len(total)
                    total.update(found)
                    held.update(set(found))
                    terms += len(total)
                    size += len(text or b"")
                    if terms > CHUNK_TERMS or size > CHUNK_BYTES:
                        yield from rows(counts)
                        counts, terms, size = {}, 0, 0
        yield from rows(counts)

    # bytes.lower() changes A-Z alone.
    parts = docs.select(F.col(f"`{text}`").cast("binary").alias("text"), *columns).mapInArrow(count, schema)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), null where nothing is kept."""
    whole = lambda x: x.cast("decimal(28,0)")
    over = whole(F.lit(2) * terms) + whole(total)
    made = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (whole(n) + F.lit(2).cast("decimal(1,0)")), over)
    return F.when(over > 0, made + 1)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares; below 10^9, its square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def differences(p, q):
    """``apart`` of numpy numbers."""
    return (p - q) ** 2 // (p + q)


def node_corrections(source: np.ndarray, p: np.ndarray, absent: np.ndarray, length: np.ndarray, times: np.ndarray):
    """(ancestor source, node source, value) sums of the tree of sorted rows of one language, depth by depth.

    The rows are flat: ``length`` entries each. At a depth a new node begins
    wherever a row differs from the row before at or above it; its terms are
    those of all rows up to the next such place.
    """
    rows, depth = len(length), int(length.max(initial=0))
    filled = np.arange(depth) < length[:, None]

    def table(values):
        out = np.full((rows, depth), -1, np.int64)
        out[filled] = values
        return out

    source, p, absent = table(source), table(p), table(absent)
    same = (source[1:] == source[:-1]) & (p[1:] == p[:-1]) & filled[1:]
    shared = np.concatenate([[0], np.cumprod(same, axis=1).sum(1)]) if rows else np.zeros(0, int)
    for d in range(1, depth):
        begin = np.flatnonzero(shared <= d)
        terms = np.add.reduceat(times, begin)
        real = filled[begin, d]
        begin, terms = begin[real], terms[real]
        own, none = p[begin, d][:, None], absent[begin, d][:, None]
        above, empty = p[begin, :d], absent[begin, :d]
        both = differences(above, own) - differences(above, none) - differences(empty, own) + differences(empty, none)
        pair, place = np.unique((source[begin, :d] << 32) + source[begin, d][:, None], return_inverse=True)
        sums = np.zeros(len(pair), np.int64)
        np.add.at(sums, place.ravel(), (both * terms[:, None]).ravel())
        yield pair >> 32, pair & 0xFFFFFFFF, sums


def joint_corrections(paths: DataFrame) -> DataFrame:
    """(lang, source, item, value), source before item, of terms that both have; ``paths`` is sorted within partitions."""
    schema = "lang string, source string, item string, value bigint"

    def corrections(lang: str, rows: pa.RecordBatch):
        entries = rows.column(2).flatten()
        names = entries.field("source").dictionary_encode()
        flat = [entries.field(c).to_numpy() for c in ("p", "absent")]
        length, times = (x.to_numpy().astype(np.int64) for x in (pc.list_value_length(rows.column(2)), rows.column(1)))
        for above, node, value in node_corrections(names.indices.to_numpy().astype(np.int64), *flat, length, times):
            yield pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(lang), len(value)), names.dictionary.take(pa.array(above)), names.dictionary.take(pa.array(node)), pa.array(value)],
                names=["lang", "source", "item", "value"])

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                langs = batch.column(0).dictionary_encode()
                for code, lang in enumerate(langs.dictionary.to_pylist()):
                    mine = batch.filter(pc.equal(langs.indices, code))
                    most = max(1, TABLE_ENTRIES // pc.max(pc.list_value_length(mine.column(2))).as_py())
                    for at in range(0, mine.num_rows, most):
                        yield from corrections(lang, mine.slice(at, most))

    return paths.select("lang", "times", "path").mapInArrow(run, schema)


def salted_pairs(left: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of ``left`` (lang, source) with every other source of the language as ``item`` and its share of absent terms as ``other``."""
    others = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("other"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return left.withColumn("salt", F.pmod(F.hash(*left.columns), F.lit(SALTS))).join(others, ["lang", "salt"]).where("source <> item").drop("salt")


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources of a language, and each source's most typical terms."""
    counts = term_counts(docs, text, lang, source)
    # One row a term: its language's totals and its nonzero counts by source.
    terms = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("row"))
    terms = pin(terms.where(F.col("docs") >= least_documents).drop("docs"))

    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"))
    name = lambda c, n: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
    occurring = docs.select(name(lang, "lang"), name(source, "source")).distinct()
    sizes = terms.select("lang", F.inline("row")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    zero = F.lit(0).cast("long")
    groups = occurring.join(sizes, ["lang", "source"], "left").join(langs, ["lang"], "left").select(
        "lang", "source", F.coalesce("size", zero).alias("size"), F.coalesce("terms", zero).alias("terms"), F.coalesce("lang_size", zero).alias("lang_size"))
    groups = bounded(groups.withColumn("absent", share(zero, F.col("size"), F.col("terms"))))

    held = terms.select("lang", "term", "total", F.inline("row")).join(groups, ["lang", "source"])
    held = pin(held.select(
        "lang", "source", "term", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), "absent",
        share(F.col("total"), F.col("lang_size"), F.col("terms")).alias("q")))

    typical = held.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    typical = typical.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)

    # Terms with equal rows are one row of the tree.
    rows = held.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "absent"))).alias("path"))
    paths = pin(rows.groupBy("lang", "path").agg(F.count("*").alias("times")))
    borders = paths.withColumn("beginning", F.slice("path", 1, BORDER_ENTRIES)).repartitionByRange("lang", "beginning")
    both = joint_corrections(borders.sortWithinPartitions("lang", "path"))
    both = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    uses = held.groupBy("lang", "source", "p", "absent").agg(F.count("*").alias("times"))
    one = salted_pairs(uses, groups).select(
        "lang", "source", "item", (F.col("times") * (apart(F.col("p"), F.col("other")) - apart(F.col("absent"), F.col("other")))).alias("value"))
    one = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    none = salted_pairs(groups.select("lang", "source", "terms", "absent"), groups).select(
        "lang", "source", "item", F.coalesce(F.col("terms") * apart(F.col("absent"), F.col("other")), zero).alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    every = none.unionByName(one).unionByName(turned(one)).unionByName(both).unionByName(turned(both))
    pairs = every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    return pairs.unionByName(typical)

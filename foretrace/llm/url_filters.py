r"""URL filters as a sort-merge range join of canonical keys with nested rules.

A host's labels are reversed and closed by a separator that no host can hold,
so a domain and its subdomains share a key prefix; host key, a NUL and the path
make a rule's key, and all urls it fits form one interval of sorted keys. A url
gives one probe for each of its trailing domains (no longer than the longest
rule host has labels). Probes and rules are dealt into ranges of keys, sorted,
and swept: a stack holds the rules whose interval is open, the innermost on
top. Of a url's matches the longest rule wins.

The ranges come from a bounded sample of probe keys. A key that is frequent
occurs several times among the range ends; its probes are spread over all those
ranges, and every rule is copied to each range its interval touches, so
frequent hosts and paths don't meet in one task. Each (host, path) is judged
once and joined back to its rows.

Defined results: a null url or one without ``://`` has empty host and path; a
url that no rule fits gets a null rule and the default verdict; of rules with
equal host and path ``block`` counts, of equally long rules the one that sorts
first; an empty rule table leaves all to the default. A rule with a null host,
path or action is left out, rule hosts fit in any case. Rule paths begin with
``/`` or are empty. Columns of the results' names are replaced, others kept.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from foretrace.llm.common import arrow_columns, replacing, sampled
from foretrace.session import ship_by_value

ship_by_value(__name__)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Sampled keys for each range: the most that the driver holds.
SAMPLE_PER_RANGE = 20


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels_of(host: Column) -> Column:
    """The host's labels, the last first."""
    return F.reverse(F.split(host, r"\.", -1))


def key_of(labels: Column, path: Column) -> Column:
    """Canonical key of reversed labels and a path."""
    return F.concat(F.array_join(labels, "/"), F.lit("/\0"), path)


def range_ends(probes: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges - 1`` sorted keys that deal the probes evenly; frequent keys repeat."""
    found = sorted(r["key"] for r in sampled(probes.select("key", "host"), SAMPLE_PER_RANGE * ranges, "key", "host").collect())
    return [found[i * len(found) // ranges] for i in range(1, ranges)] if len(found) >= ranges else []


def dealt_probes(probes: DataFrame, ends: list[str]) -> DataFrame:
    """Probes with their range; those of a key among the ends are spread by host and path."""
    places = [probes.columns.index(c) for c in ("key", "host", "path")]

    def prepare():
        def place(key, host, path):
            low, high = bisect_left(ends, key), bisect_right(ends, key)
            return low if low == high else low + zlib.crc32(f"{host}\0{path}".encode()) % (high - low + 1)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = zip(*(batch.column(i).to_pylist() for i in places))
            return [pa.array((place(*r) for r in rows), pa.int32())]

        return work

    return arrow_columns(probes, probes.columns, [StructField("part", IntegerType())], prepare)


def dealt_rules(rules: DataFrame, ends: list[str]) -> DataFrame:
    """Each rule once for every range that its interval touches."""
    column = rules.columns.index("key")

    def prepare():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            keys = batch.column(column).to_pylist()
            return [pa.array((bisect_left(ends, k) for k in keys), pa.int32()),
                    pa.array((bisect_right(ends, k + "\U0010ffff") for k in keys), pa.int32())]

        return work

    spans = arrow_columns(rules, rules.columns, [StructField("first", IntegerType()), StructField("last", IntegerType())], prepare)
    return spans.select(*rules.columns, F.explode(F.sequence("first", "last")).alias("part"))


def sweep(batches):
    """Matches of sorted rows (part, key, is_probe, host, path, rule, action): the innermost open rule."""
    part, stack = None, []
    for batch in batches:
        out = {"host": [], "path": [], "rule": [], "action": []}
        for p, key, is_probe, host, path, rule, action in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_probe:
                stack.append((key, rule, action))
            elif stack:
                for name, value in zip(out, (host, path, *stack[-1][1:])):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.string()) for n, v in out.items()})


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", ranges: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has host, path and action."""
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    located = replacing(pages, host=host_of(F.col(f"`{url}`")), path=path_of(F.col(f"`{url}`")))
    # A rule with a null says nothing; hosts are compared without case, as those of urls.
    usable = rules.select(F.translate("host", ascii_uppercase, ascii_lowercase).alias("host"), "path", "action").dropna()
    listed = usable.groupBy("host", "path").agg(F.max("action").alias("action")).select(
        key_of(labels_of(F.col("host")), F.col("path")).alias("key"), F.size(labels_of(F.col("host"))).alias("n_labels"),
        F.concat("host", "path").alias("rule"), "action")
    deepest = listed.agg(F.max("n_labels")).first()[0] or 0
    labels = labels_of(F.col("host"))
    depths = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(deepest, 1))))
    keys = F.transform(depths, lambda i: key_of(F.slice(labels, F.lit(1), i), F.col("path")))
    probes = located.select("host", "path").distinct().select("host", "path", F.explode(keys).alias("key"))
    ends = range_ends(probes, ranges)
    nothing = F.lit(None).cast("string")
    rows = dealt_probes(probes, ends).select("part", "key", F.lit(True).alias("is_probe"), "host", "path", nothing.alias("rule"), nothing.alias("action")).unionByName(
        dealt_rules(listed.select("key", "rule", "action"), ends).select(
            "part", "key", F.lit(False).alias("is_probe"), nothing.alias("host"), nothing.alias("path"), "rule", "action"))
    schema = StructType([StructField(n, StringType()) for n in ("host", "path", "rule", "action")])
    matches = rows.repartition(ranges, "part").sortWithinPartitions("part", "key", "is_probe").mapInArrow(sweep, schema)
    best = matches.groupBy("host", "path").agg(F.min(F.struct((-F.char_length("rule")).alias("n"), "rule", "action")).alias("best"))
    kept = [c for c in located.columns if c.lower() not in ("rule", "verdict")]
    return located.select(*[f"`{c}`" for c in kept]).join(best, ["host", "path"], "left").select(
        *[f"`{c}`" for c in kept], F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))

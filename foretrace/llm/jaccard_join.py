r"""N-gram Jaccard join by token-combination prefixes, with exact results.

A document is the set of its distinct word shingles as 64-bit hashes. Tokens
are ordered rare class first, each class by hash. A set of n tokens can miss
tau of them and still have a partner, so of any prefix that *covers* tau + 1
mismatches, a partner shares a signature:

- rare tokens are indexed alone, each covers one mismatch;
- where a set has too few rare tokens its prefix is extended by frequent ones.
  Those are dealt into hash classes, indexed as pairs inside a class, and cover
  one mismatch fewer than a class has tokens. The number of classes depends on
  a band of set sizes; sets near a band's end are indexed for both bands.

A token is frequent where more than ``rare_limit`` sets have it in their prefix
by hash. Sets of which a tenth of that prefix is frequent (parts of passages
that many documents share, large groups of copies) have all their tokens
counted, so the extension meets known classes. The driver holds at most
``frequent_capacity`` frequent tokens; if there are more, the limit is raised.
Any class assignment gives exact results, only the work differs.

Candidates pass a size and a position filter, then a parity bitmap (of sets
with d tokens in one only, bitmaps differ in at most d bits), then the sets are
intersected. Postings of up to ``rare_limit`` sets give all their pairs. Larger
ones first link each set to the posting's least. Once those components are
known, postings that still hold several are dealt into blocks, and sets of
different components are compared by finer bitmaps inside the blocks' tasks;
only pairs that pass leave them. So no group gives all its pairs, yet no link
between components is missed. Links inside a component are not all made for
that; ``links`` gives all of them.

Equal sets are one class from the start: copies of a text cost one row each.
Rows: a null or empty text has no tokens and is its own component; repeated
rows belong to one class; a null id counts after all others as the least of its
component; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from foretrace.llm import components
from foretrace.llm.common import arrow_columns, gathered, replacing, slices
from foretrace.llm.shingles import U64, mixed, set_key, shingle_set
from foretrace.session import bounded, pin, ship_by_value

ship_by_value(__name__)

RARE_LIMIT = 16
FREQUENT_CAPACITY = 1 << 20
HUB_ROWS = 10_000
# Sets of a posting that are compared with each other, or with another block, in one task.
BLOCK_ROWS = 1000
FINE_BITS = 4
# Signatures by which a pair's first common posting is told; a pair may come twice where they don't suffice.
FIRST_SIGNATURES = 16
SEEN_KEYS = 1 << 18
TOKENS = StructType([StructField("token", LongType())])


class Rule:
    """Similarity rule in whole numbers: 100 * intersection >= percent * union."""

    def __init__(self, width: int, percent: int):
        self.width, self.percent = width, percent

    def missing(self, n: int) -> int:
        """Tokens that a set of n can have outside a partner."""
        return n + (-self.percent * n // 100)

    def has_partners(self, n: int) -> bool:
        """Whether a different set can be similar to one of n tokens."""
        return 100 * n >= self.percent * (n + 1)

    def bands(self, n: int) -> set[int]:
        """Size bands that the set shares with any partner."""
        return {n.bit_length() - 1, (100 * n // self.percent).bit_length() - 1}

    def classes(self, band: int) -> int:
        """Hash classes of frequent tokens: half of what the band's smallest sets can miss."""
        return max(1, self.missing(1 << band) // 2)

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * shared >= self.percent * (len(a) + len(b) - shared)


def is_frequent(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Flags of tokens in a sorted array."""
    if not len(frequent):
        return np.zeros(len(tokens), bool)
    at = np.searchsorted(frequent, tokens)
    return frequent[np.minimum(at, len(frequent) - 1)] == tokens


def signatures(tokens: np.ndarray, frequent: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set and their positions in its order (0 for pairs)."""
    n = len(tokens)
    if not rule.has_partners(n):
        return np.empty(0, U64), np.empty(0, np.int64)
    need = rule.missing(n) + 1
    common = is_frequent(tokens, frequent)
    rare = tokens[~common][:need]
    found, place = [rare], [np.arange(len(rare))]
    if len(rare) < need:
        often = tokens[common]
        for band in rule.bands(n):
            group = (mixed(often) % U64(rule.classes(band))).astype(np.int64)
            # Cover after each token: those so far less the classes begun.
            new = np.zeros(len(often), bool)
            new[np.unique(group, return_index=True)[1]] = True
            reached = np.flatnonzero(len(rare) + np.cumsum(~new) >= need)
            end = int(reached[0]) + 1 if len(reached) else len(often)
            order = np.argsort(group[:end], kind="stable")
            sorted_group, chosen = group[:end][order], often[:end][order]
            step = 1
            while True:
                same = np.flatnonzero(sorted_group[step:] == sorted_group[:-step])
                if not len(same):
                    break
                pair = mixed(chosen[same] * U64(0x9E3779B97F4A7C15) + mixed(chosen[same + step]) + U64(band + 1))
                found.append(pair)
                place.append(np.zeros(len(pair), np.int64))
                step += 1
    return np.concatenate(found), np.concatenate(place)


def parity_bitmap(tokens: np.ndarray, per_token: int = 1) -> bytes:
    """Bits that tell whether an odd number of tokens fall on them; at least ``per_token`` bits for each token."""
    bits = max(64, 1 << (per_token * len(tokens) - 1).bit_length()) if len(tokens) else 64
    odd = np.bincount((tokens & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, the longer folded to the shorter's length."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def short_key(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def exploded(docs: DataFrame, text: str, rule: Rule, schema: StructType, make) -> DataFrame:
    """Rows that ``make(tokens, key)`` gives of each set, as arrays of the schema's columns.

    Copies within a task count once, as long as a bounded table of keys holds them.
    """
    names, kinds = schema.names, [pa.int64() if isinstance(f.dataType, LongType) else pa.binary() for f in schema.fields]

    def run(batches):
        seen = set()

        def first_of_its_kind(text):
            tokens = shingle_set(text, rule.width)
            key = set_key(tokens)
            if key in seen or not rule.has_partners(len(tokens)):
                return None
            if len(seen) >= SEEN_KEYS:
                seen.clear()
            seen.add(key)
            return make(tokens, key)

        for whole in batches:
            for batch in slices(whole):
                made = [m for t in batch.column(0) if t.is_valid for m in [first_of_its_kind(t.as_py())] if m is not None]
                columns = [np.concatenate(c) if k == pa.int64() else [v for part in c for v in part] for c, k in zip(zip(*made), kinds)] if made else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(text).mapInArrow(run, schema)


def profiles(docs: DataFrame, text: str, rule: Rule) -> DataFrame:
    """doc_id, text digest, set size, set key and parity bitmap of every row."""
    def prepare():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            sets = [shingle_set(t.as_py() or "", rule.width) for t in batch.column(1)]
            return [pa.array(map(len, sets), pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([short_key(set_key(s)) if len(s) else None for s in sets], pa.int64()),
                    pa.array([parity_bitmap(s) if rule.has_partners(len(s)) else None for s in sets], pa.binary())]

        return work

    rows = docs.select("doc_id", F.col(text).alias("text"), F.md5(F.col(text).cast("binary")).alias("digest"))
    fields = [StructField("n", LongType()), StructField("key", BinaryType()), StructField("short", LongType()), StructField("bitmap", BinaryType())]
    return arrow_columns(rows, ["doc_id", "digest"], fields, prepare)


def frequent_tokens(docs: DataFrame, text: str, rule: Rule, rare_limit: int, capacity: int) -> np.ndarray:
    """Sorted tokens that more than ``rare_limit`` sets have in their prefix, at most ``capacity``."""

    def counted(make) -> np.ndarray:
        counts = pin(exploded(docs, text, rule, TOKENS, make).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > rare_limit))
        by_size = counts.groupBy(F.floor(F.log2("n")).alias("log")).agg(F.count("*").alias("n")).collect()
        least, room = rare_limit, capacity
        for row in sorted(by_size, reverse=True):
            room -= row["n"]
            if room < 0:
                least = 2 ** (row["log"] + 1) - 1
                break
        found = counts.where(F.col("n") > least).select("token").toArrow().column(0).to_numpy()
        return np.sort(found.astype(np.int64).view(U64))

    def prefix(tokens, key):
        return (tokens[:rule.missing(len(tokens)) + 1].view(np.int64),)

    first = counted(prefix)
    if not len(first):
        return first
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def all_of_shared(tokens, key):
        head = tokens[:rule.missing(len(tokens)) + 1]
        return (tokens.view(np.int64),) if 10 * is_frequent(head, shared.value).sum() > len(head) else None

    return np.union1d(first, counted(all_of_shared))


def postings(docs: DataFrame, text: str, rule: Rule, frequent: np.ndarray) -> DataFrame:
    """(signature, short, n, place, size, least) of signatures that several classes have."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = StructType([StructField(c, LongType()) for c in ("signature", "short", "packed")])

    def make(tokens, key):
        found, place = signatures(tokens, shared.value, rule)
        packed = (np.int64(len(tokens)) << np.int64(32)) + place
        return found.view(np.int64), np.full(len(found), short_key(key), np.int64), packed

    rows = exploded(docs, text, rule, schema, make)
    # Copies in several tasks: one row of each class. The windows share one shuffle and sort.
    earlier = F.lag("short").over(Window.partitionBy("signature").orderBy("short", "packed"))
    rows = rows.withColumn("earlier", earlier).where("earlier IS NULL OR earlier <> short")
    per = Window.partitionBy("signature")
    sized = rows.select("*", F.count("*").over(per).alias("size"), F.min("short").over(per).alias("least"), F.max("short").over(per).alias("most"))
    return sized.where("least <> most").select(
        "signature", "short", F.shiftright("packed", 32).alias("n"), F.col("packed").bitwiseAND(0xFFFFFFFF).alias("place"), "size", "least")


def fits(rule: Rule, x: str, y: str) -> str:
    """Size and position filter of two postings, as SQL."""
    p = rule.percent
    return (f"100 * least({x}.n, {y}.n) >= {p} * greatest({x}.n, {y}.n) AND "
            f"{100 + p} * least({x}.n - {x}.place, {y}.n - {y}.place) >= {p} * ({x}.n + {y}.n)")


def pairs_of(rows: DataFrame, others: DataFrame, rule: Rule, more: str) -> DataFrame:
    """Candidate pairs (a < b) of postings with one signature, as often as they share one."""
    joined = rows.alias("x").join(others.alias("y"), F.expr(f"x.signature = y.signature AND x.short <> y.short AND {more} AND {fits(rule, 'x', 'y')}"))
    return joined.select(F.least("x.short", "y.short").alias("a"), F.greatest("x.short", "y.short").alias("b"))


def likely(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose parity bitmaps differ in no more bits than similar sets can."""
    bits = classes.where("bitmap IS NOT NULL").select("short", "n", "bitmap")
    x, y = (bits.select(F.col("short").alias(k), F.col("n").alias(f"n_{k}"), F.col("bitmap").alias(f"bits_{k}")) for k in "ab")
    percent = rule.percent

    def test(batches):
        for batch in batches:
            # |x| + |y| - 2 |x and y| is at most this share of |x| + |y|.
            keep = [(100 + percent) * differing_bits(u, v) <= (100 - percent) * (n + m)
                    for n, m, u, v in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(test, schema)


def needed_texts(docs: DataFrame, text: str, keys: DataFrame, classes: DataFrame) -> DataFrame:
    """One text of each class whose short key is listed, found by its digest."""
    digests = bounded(keys.select("short").distinct().join(classes, "short").select(F.col("first.digest").alias("digest")).distinct())
    marked = docs.select(F.col(text).alias("text"), F.md5(F.col(text).cast("binary")).alias("digest"))
    return marked.join(digests, "digest", "left_semi").select("text")


def needed_sets(docs: DataFrame, text: str, rule: Rule, keys: DataFrame, classes: DataFrame) -> DataFrame:
    """(short, sets) of the listed classes; sets has the tokens of each class of that short key."""
    schema = StructType([StructField("short", LongType()), StructField("tokens", BinaryType())])
    rows = exploded(needed_texts(docs, text, keys, classes), "text", rule, schema, lambda tokens, key: ([short_key(key)], [tokens.tobytes()]))
    return rows.groupBy("short").agg(F.collect_set("tokens").alias("sets"))


def verified(docs: DataFrame, text: str, rule: Rule, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b), class keys, of the pairs that are similar.

    A class with very many pairs is met by copies of its set, each with a share
    of the pairs.
    """
    sets = needed_sets(docs, text, rule, pairs.select(F.explode(F.array("a", "b")).alias("short")), classes)
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("shares"))
    x = pairs.join(sets.select(F.col("short").alias("a"), F.explode("sets").alias("x")), "a")
    dealt = x.join(shares, "b").withColumn("share", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int")).drop("shares")
    y = sets.select(F.col("short").alias("b"), F.explode("sets").alias("y")).join(shares, "b").select(
        "b", "y", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))

    def test(batches):
        for whole in batches:
            for batch in slices(whole):
                a, b = [], []
                for u, v in zip(*(c.to_pylist() for c in batch.columns)):
                    p, q = np.frombuffer(u, U64), np.frombuffer(v, U64)
                    if rule.similar(p, q):
                        a.append(set_key(p))
                        b.append(set_key(q))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    schema = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])
    return dealt.join(y, ["b", "share"]).select("x", "y").mapInArrow(test, schema)


def hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of every row of x and every row of y, bitmaps of one length."""
    out = np.empty((len(x), len(y)), np.int64)
    step = max(1, (1 << 20) // max(1, y.size))
    for at in range(0, len(x), step):
        out[at:at + step] = np.bitwise_count(x[at:at + step, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
    return out


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of one length folded to fewer words."""
    while rows.shape[1] > words:
        rows = rows[:, :rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2:]
    return rows


def block_pairs(rule: Rule, signature: int, first: list, second: list | None) -> set[tuple[int, int]]:
    """Pairs of different components that may be similar, in a block or between two.

    Rows are (short, n, place, part, bits, firsts). Those of the most frequent
    component are met by the others only. A pair that shares an earlier posting
    is left to that one, as far as ``firsts`` tells.
    """
    found: set[tuple[int, int]] = set()
    parts = [r[3] for r in first + (second or [])]
    largest = max(set(parts), key=parts.count)
    sides = [([r for r in first if r[3] != largest], first)] if second is None else [
        ([r for r in first if r[3] != largest], second), ([r for r in first if r[3] == largest], [r for r in second if r[3] != largest])]
    for left, right in sides:
        by_length = [{k: [r for r in rows if len(r[4]) == k] for k in {len(r[4]) for r in rows}} for rows in (left, right)]
        for p, xs in by_length[0].items():
            for q, ys in by_length[1].items():
                if max(p, q) > 2 * min(p, q):
                    continue  # sizes too far apart
                words = min(p, q) // 8
                x, y = (folded(np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1), words) for rows in (xs, ys))
                n, m = (np.array([r[1] for r in rows]) for rows in (xs, ys))
                left_n, left_m = n - [r[2] for r in xs], m - [r[2] for r in ys]
                total = n[:, None] + m
                near = 100 * np.minimum(n[:, None], m) >= rule.percent * np.maximum(n[:, None], m)
                near &= (100 + rule.percent) * np.minimum(left_n[:, None], left_m) >= rule.percent * total
                near &= np.array([r[3] for r in xs], object)[:, None] != np.array([r[3] for r in ys], object)
                near &= (100 + rule.percent) * hamming(x, y) <= (100 - rule.percent) * total
                for i, j in zip(*np.nonzero(near)):
                    if any(s < signature and s in ys[j][5] for s in xs[i][5]):
                        continue
                    found.add((min(xs[i][0], ys[j][0]), max(xs[i][0], ys[j][0])))
    return found


def open_pairs(docs: DataFrame, text: str, rule: Rule, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) between components of large postings.

    A posting of m rows makes blocks of about BLOCK_ROWS; each row goes to the
    task of every pair of blocks that holds its own.
    """
    schema = StructType([StructField("short", LongType()), StructField("bits", BinaryType())])
    fine = exploded(needed_texts(docs, text, rows, classes), "text", rule, schema,
                    lambda tokens, key: ([short_key(key)], [parity_bitmap(tokens, FINE_BITS)])).dropDuplicates(["short"])
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    # Order of signatures as unsigned numbers, the tokens' order: a pair passes the position filter at its first.
    unsigned = F.col("signature").bitwiseXOR(F.lit(-(1 << 63)))
    firsts = rows.groupBy("short").agg(F.slice(F.sort_array(F.collect_set(unsigned)), 1, FIRST_SIGNATURES).alias("firsts"))
    dealt = rows.join(fine, "short").join(firsts, "short").withColumn("signature", unsigned).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("short"), F.col("blocks")).cast("int"))
    placed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "signature", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "short", "n", "place", "part", "bits", "firsts")

    def compare(batches):
        key, first, second = None, [], []

        def pairs():
            return block_pairs(rule, key[0], first, None if key[1] == key[2] else second) if key and first and (second or key[1] == key[2]) else ()

        def batch_of(found):
            found = sorted(found)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            out = set()
            for signature, low, high, own, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (signature, low, high) != key:
                    out.update(pairs())
                    key, first, second = (signature, low, high), [], []
                (first if own == low else second).append(row)
            yield batch_of(out)
        yield batch_of(pairs())

    out = StructType([StructField("a", LongType()), StructField("b", LongType())])
    keys = ["signature", "low", "high"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, out).distinct()


def distinct_sets(rows: DataFrame) -> DataFrame:
    """key, short, n, bitmap and ``first``, the least row, of each class of equal sets."""
    return pin(rows.where("n > 0").groupBy("key", "short").agg(
        F.first("n").alias("n"), F.first("bitmap").alias("bitmap"),
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("first")))


def members(
    docs: DataFrame, text: str = "text", width: int = 4, percent: int = 85, rare_limit: int = RARE_LIMIT, frequent_capacity: int = FREQUENT_CAPACITY,
) -> DataFrame:
    """Every row's doc_id, digest (of its text), n (set size) and ``first``, the least row of its component."""
    rule = Rule(width, percent)
    rows = pin(profiles(docs, text, rule))
    classes = distinct_sets(rows)
    found = gathered(pin(postings(docs, text, rule, frequent_tokens(docs, text, rule, rare_limit, frequent_capacity))))
    small, large = found.where(F.col("size") <= rare_limit), found.where(F.col("size") > rare_limit)
    hubs = large.where("short = least")
    tried = gathered(pin(likely(pairs_of(small, small, rule, "x.short < y.short").unionByName(pairs_of(large, hubs, rule, "true")).distinct(), classes, rule)))
    links = gathered(pin(verified(docs, text, rule, tried, classes)))
    root = components.roots(links)
    # Large postings once more: sets of different components that weren't compared.
    group = classes.select("short", "key").join(root.select(F.col("a").alias("key"), "b"), "key", "left").select("short", F.coalesce("b", "key").alias("part"))
    placed = large.join(group, "short")
    several = placed.groupBy("signature").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("signature")
    open_rows = gathered(pin(placed.join(several, "signature")))
    if not open_rows.isEmpty():
        rest = gathered(pin(open_pairs(docs, text, rule, open_rows, classes).join(tried, ["a", "b"], "left_anti")))
        if not rest.isEmpty():
            root = components.roots(links.unionByName(verified(docs, text, rule, rest, classes)))
    return joined(rows, classes, root)


def joined(rows: DataFrame, classes: DataFrame, root: DataFrame) -> DataFrame:
    """Rows with the least row of their component."""
    labelled = classes.join(root.select(F.col("a").alias("key"), F.col("b").alias("part")), "key", "left").select(
        "key", F.coalesce("part", "key").alias("part"), "first")
    least = labelled.groupBy("part").agg(F.min("first").alias("first"))
    per_class = labelled.select("key", "part").join(least, "part").select("key", "first")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    return rows.join(per_class, "key", "left").select("doc_id", "digest", "n", F.coalesce("first", own).alias("first"))


def links(
    docs: DataFrame, text: str = "text", width: int = 4, percent: int = 85, rare_limit: int = RARE_LIMIT, frequent_capacity: int = FREQUENT_CAPACITY,
) -> DataFrame:
    """(a, b, n_a, n_b) of every pair of similar, different sets, once: doc_id of each set's least row, and set sizes.

    Large postings are compared in blocks as if each set were a component of
    its own, so the work and the result grow with the square of a group.
    """
    rule = Rule(width, percent)
    classes = distinct_sets(profiles(docs, text, rule))
    found = gathered(pin(postings(docs, text, rule, frequent_tokens(docs, text, rule, rare_limit, frequent_capacity))))
    small, large = found.where(F.col("size") <= rare_limit), found.where(F.col("size") > rare_limit)
    alone = large.join(classes.select("short", F.col("key").alias("part")), "short")
    tried = likely(pairs_of(small, small, rule, "x.short < y.short").distinct(), classes, rule).unionByName(open_pairs(docs, text, rule, alone, classes))
    similar = verified(docs, text, rule, pin(tried.distinct()), classes).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x, y = (classes.select(F.col("key").alias(k), F.struct("first", "n").alias(f"of_{k}")) for k in "ab")
    pairs = similar.join(x, "a").join(y, "b").select(F.least("of_a", "of_b").alias("x"), F.greatest("of_a", "of_b").alias("y"))
    return pairs.select(F.col("x.first.doc_id").alias("a"), F.col("y.first.doc_id").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))


def component_ids(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return members(docs, **options).select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are the least of their component; rows equal in id and text count once."""
    # One key without nulls: the join and the removal of repeated rows then share a shuffle of the texts.
    row_key = lambda digest: F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(digest, F.lit("null"))).cast("binary"))
    least = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("digest").eqNullSafe(F.col("first.digest"))
    kept = members(docs, text, **options).where(least).select(row_key(F.col("digest")).alias("_row"))
    marked = replacing(docs, _row=row_key(F.md5(F.col(text).cast("binary"))))
    return marked.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*[f"`{c}`" for c in docs.columns])

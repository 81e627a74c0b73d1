r"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text: its words, symbols, repeated lines and repeated
8-word windows. The method looks across documents: lines are normalised and
hashed, distinct texts that hold a line are counted per host, lines in more of
them than the limits allow are removed, and a document that keeps too small a
part of its words is rejected as depleted. The share that a line needs grows
with its host; ``enough_documents`` sets a number of texts above which a line
goes whatever the host's size.

Exact copies of a text count as one document of the host, so a page that is
copied often doesn't make its own lines boilerplate. Counts form partial sums
before the shuffle, spread over (host, line); per text, only hashes of its lines
are shuffled, never the text.

Defined results: a null or empty text has no words and fails the base rules;
a null host is a host of its own; rows with equal host and text get equal
verdicts; an empty table gives no rows. Columns of the results' names are
replaced, others kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import SPACES, bound, replacing, without, words
from foretrace.session import bounded

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
# A line is removed where more than so many texts of its host, and more than this share of them, hold it.
LINE_DOCUMENTS = 10
LINE_PERCENT = 10
# A document is depleted below this share of its words.
LEAST_LEFT_PERCENT = 30


def lines_with_words(text: Column) -> Column:
    """Lines split at line feeds that hold at least one word."""
    return F.filter(F.split(text, "\n", -1), lambda line: F.char_length(without(line, SPACES)) > 0)


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur at least twice in the text, the first included.

    Only texts with two equal window hashes take the second half: positions
    sorted by hash, those with an equal neighbour kept, and each covering the
    words up to the next.
    """
    count = F.size(tokens)
    starts = F.when(count > window, F.sequence(F.lit(1), count - window + 1)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, F.lit(window))))

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def equal_neighbours(placed: Column) -> Column:
            near = lambda x, k: F.coalesce(F.get(placed, k)["h"] == x["h"], F.lit(False))
            twice = F.filter(placed, lambda x, k: near(x, k - 1) | near(x, k + 1))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def words_up_to_next(positions: Column) -> Column:
            width = F.transform(positions, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(positions, k + 1) - p, F.lit(window))))
            return F.aggregate(width, F.lit(0).cast("long"), lambda total, x: total + x)

        return bound(bound(placed, equal_neighbours), words_up_to_next)

    return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def base_measures(text: Column) -> Column:
    """Struct of word and symbol counts, repeated lines and repeated words of a text."""
    whole = F.coalesce(text, F.lit(""))
    lines = lines_with_words(whole)
    length = F.char_length(whole)
    return F.struct(
        bound(words(whole), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.char_length(without(whole, SPACES)).cast("long").alias("word_chars"),
        (length - F.char_length(without(whole, SYMBOLS))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )


def line_key(line: Column) -> Column:
    """Hash of a line in lower case with single spaces and zeros for digits."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.trim(F.lower(line)), r"\s+", " "), "[0-9]", "0"))


def line_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def distinct_texts(docs: DataFrame, text: str, host: str) -> DataFrame:
    """(host, digest, keys) of each distinct text of a host, with its lines' distinct keys."""
    keys = F.array_distinct(F.transform(lines_with_words(F.col(text)), line_key))
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(host).alias("host"), F.md5(F.col(text).cast("binary")).alias("digest"), keys.alias("keys"))
    return rows.groupBy("host", "digest").agg(F.first("keys").alias("keys"))


def frequent_lines(texts: DataFrame, least: int = LINE_DOCUMENTS, percent: int = LINE_PERCENT, enough: int | None = None) -> DataFrame:
    """(host, key) of lines in more than ``least`` texts and more than ``percent`` of the host's, or in more than ``enough``."""
    counted = texts.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    hosts = texts.groupBy("host").agg(F.count("*").alias("texts"))
    if enough is not None and enough <= least:
        return counted.where(F.col("n") > enough).select("host", "key")
    over = counted.where(F.col("n") > least).alias("l").join(hosts.alias("h"), F.expr("l.host <=> h.host"))
    frequent = 100 * F.col("n") > percent * F.col("texts")
    if enough is not None:
        frequent |= F.col("n") > enough
    return over.where(frequent).select("l.host", "l.key")


def removed_lines(docs: DataFrame, text: str, host: str, frequent: DataFrame) -> DataFrame:
    """(host, digest, removed_keys, removed_words) of texts that lose lines; lines of copies meet at their place."""
    held = docs.where(F.col(text).isNotNull()).select(
        F.col(host).alias("host"), F.md5(F.col(text).cast("binary")).alias("digest"), F.posexplode(lines_with_words(F.col(text))).alias("place", "line"))
    held = held.withColumn("key", line_key(F.col("line"))).alias("t")
    hit = held.join(frequent.alias("f"), F.expr("t.host <=> f.host AND t.key = f.key")).withColumn("n", line_words(F.col("t.line")))
    once = hit.groupBy("t.host", "t.digest", "t.place").agg(F.first("t.key").alias("key"), F.first("n").alias("n"))
    return once.groupBy("host", "digest").agg(F.collect_set("key").alias("removed_keys"), F.sum("n").cast("long").alias("removed_words"))


def judge(
    docs: DataFrame, text: str = "text", host: str = "source", line_documents: int = LINE_DOCUMENTS, line_percent: int = LINE_PERCENT,
    least_left_percent: int = LEAST_LEFT_PERCENT, enough_documents: int | None = None,
) -> DataFrame:
    """``docs`` with the base measures, base_failed, removed_words, clean_text, depleted and kept."""
    # Counted once; broadcast only if it is small, else joined by shuffle.
    frequent = bounded(frequent_lines(distinct_texts(docs, text, host), line_documents, line_percent, enough_documents))
    removed = removed_lines(docs, text, host, frequent)
    measured = replacing(docs, _m=base_measures(F.col(text)), _d=F.md5(F.col(text).cast("binary"))).alias("d")
    joined = measured.join(removed.alias("r"), F.expr(f"d.`{host}` <=> r.host AND d._d = r.digest"), "left")
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "clean_text", "depleted", "kept")
    keep = [F.col(f"d.`{c}`") for c in docs.columns if c.lower() not in results]
    n_words, repeat = F.col("d._m.w.n_words"), F.col("d._m.w.n_repeat_words")
    gone = F.coalesce("r.removed_words", F.lit(0).cast("long"))
    base_failed = (n_words < LEAST_WORDS) | (100 * repeat > MOST_REPEATED_PERCENT * n_words)
    depleted = 100 * (n_words - gone) < least_left_percent * n_words
    left = F.filter(F.split(F.col(f"d.`{text}`"), "\n", -1), lambda x: ~F.array_contains("r.removed_keys", line_key(x)))
    clean = F.when(F.col("r.removed_keys").isNull(), F.col(f"d.`{text}`")).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *keep, n_words.alias("n_words"), F.col("d._m.word_chars").alias("word_chars"), F.col("d._m.n_symbols").alias("n_symbols"),
        F.col("d._m.n_dup_lines").alias("n_dup_lines"), repeat.alias("n_repeat_words"), base_failed.alias("base_failed"),
        gone.alias("removed_words"), clean.alias("clean_text"), depleted.alias("depleted"), (~base_failed & ~depleted).alias("kept"),
    )

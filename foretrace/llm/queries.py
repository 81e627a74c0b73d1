"""The registered queries of the training-data operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.llm.common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) and, where it exists, its SQL twin."""

    def register(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
# Mean weights 5, 2 and 1: the first falls, the second is level, the third rises.
CURRICULUM = [[(0.0, 6.0), (0.5, 5.0), (1.0, 4.0)], [(0.0, 2.0), (1.0, 2.0)], [(0.0, 0.5), (1.0, 1.5)]]


@query("op1_mixing", rf"""
WITH sized AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(doc_id::VARCHAR) AS o, md5(text) AS x FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, 2.0::DOUBLE * source_size AS cap, [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS weight FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (SELECT *, least(cap, max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.rank % 3 AS kind,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o, s.x, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
taken AS (
  SELECT *, greatest(0, least(size, round(target)::BIGINT - first)) AS once, greatest(0, least(size, round(target)::BIGINT - source_size - first)) AS twice
  FROM placed),
areas AS (SELECT *, least(1.0::DOUBLE, (first + once / 2.0::DOUBLE) / target) AS a FROM taken)
SELECT doc_id, size, source_size, round(target, 6) AS target, (once + twice)::BIGINT AS taken,
       round(CASE WHEN once = 0 THEN NULL
                  WHEN kind = 1 THEN a
                  WHEN kind = 0 THEN CASE WHEN a * 5 < 2.75 THEN 2 * a * 5 / (6 + sqrt(36 - 4 * a * 5))
                                          ELSE 0.5 + 2 * (a * 5 - 2.75) / (5 + sqrt(greatest(25 - 4 * (a * 5 - 2.75), 0))) END
                  ELSE 2 * a / (0.5 + sqrt(0.25 + 2 * a)) END, 6) AS first_position
FROM areas""")
def op1_mixing(spark, sf_dir):
    """All documents mixed by source weights 5, 2, 1 that change over training, range-sorted by position."""
    from foretrace.llm import mixing

    mixed = mixing.mix(table(spark, sf_dir, "documents"), CURRICULUM)
    return mixing.by_position(mixed).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken",
        F.round(F.get("takes", F.lit(0))["position"], 6).alias("first_position"))


@query("op2_quality_rules", rf"""
WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS text, md5(text) AS digest, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: md5(array_to_string(w[i:i + 7], ' ')))) AS h
  FROM texts WHERE len(w) >= 8),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1), (SELECT unnest(range(8)) AS k) GROUP BY 1),
held AS (
  SELECT source, digest, md5(regexp_replace(regexp_replace(trim(lower(x), ' '), '[ \t\n\x0B\f\r]+', ' ', 'g'), '[0-9]', '0', 'g')) AS k,
         len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT source, digest, unnest(lines) AS x FROM (SELECT DISTINCT source, digest, lines FROM texts))),
hosts AS (SELECT source, count(DISTINCT digest) AS texts FROM texts GROUP BY 1),
frequent AS (
  SELECT h.source, h.k FROM held h JOIN hosts USING (source) GROUP BY h.source, h.k, texts
  HAVING count(DISTINCT digest) > 20 OR (count(DISTINCT digest) > 10 AND 100 * count(DISTINCT digest) > 10 * texts)),
gone AS (SELECT source, digest, sum(n)::BIGINT AS n FROM held JOIN frequent USING (source, k) GROUP BY 1, 2),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(g.n, 0)::BIGINT AS removed_words
  FROM texts t LEFT JOIN repeats r USING (doc_id) LEFT JOIN gone g USING (source, digest)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
       NOT base_failed AND 100 * (n_words - removed_words) >= 30 * n_words AS kept
FROM failed""")
def op2_quality_rules(spark, sf_dir):
    """Base rules and cross-document line frequency per source over all documents."""
    from foretrace.llm import quality_rules

    return quality_rules.judge(table(spark, sf_dir, "documents"), enough_documents=20).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op3_url_filters", rf"""
WITH rules(rule_host, rule_path, action) AS (VALUES {', '.join(map(str, RULES))}),
located AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
fits AS (
  SELECT l.host, l.path, rule_host || rule_path AS rule, action
  FROM (SELECT DISTINCT host, path FROM located) l JOIN rules ON (l.host = rule_host OR ends_with(l.host, '.' || rule_host)) AND starts_with(l.path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY l.host, l.path ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path) = 1)
SELECT page_id, l.host, l.path, rule, coalesce(action, 'allow') AS verdict FROM located l LEFT JOIN fits USING (host, path)""")
def op3_url_filters(spark, sf_dir):
    """Every page's url judged by nested host and path rules."""
    from foretrace.llm import url_filters

    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op4_jaccard_join")
def op4_jaccard_join(spark, sf_dir):
    """Components of all documents under Jaccard similarity of 4-word shingles, at 85 percent."""
    from foretrace.llm import jaccard_join

    return jaccard_join.component_ids(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_quality_classifier")
def op5_quality_classifier(spark, sf_dir):
    """Every document's quality, voted by labelled documents outside the held-out fifth."""
    from foretrace.llm import quality_classifier
    from foretrace.llm.common import remainder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fitted(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    scored = quality_classifier.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    """Every document's probabilities of low quality and, later in the chain, of toxicity."""
    from foretrace.llm import toxicity
    from foretrace.llm.common import remainder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")
    chain = toxicity.fitted(docs, labels, ["poor", "toxic"], remainder(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, chain, ["p_poor", "p_toxic"], keep=["doc_id"])
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "p_poor", "p_toxic", (F.col("p_toxic") >= 0.5).cast("int").alias("toxic"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark, sf_dir):
    """Token ids of every whole text and the bytes they decode to, as digests."""
    import public_tokenizers

    from foretrace.llm import byte_bpe

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.digests(byte_bpe.code_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, keep=["doc_id"]))


CONTROL_TEXT = "</s>[INST] ok [/INST]"
ESCAPED = r"replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')"


@query("op8_chat", rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}'))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(17 + length(replace({ESCAPED.replace('text', 'role')}, chr(10), '&nl;')) + length({ESCAPED}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""")
def op8_chat(spark, sf_dir):
    """All conversations rebuilt from an event log, rendered, and read back from the rendering."""
    from foretrace.llm import chat

    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{CONTROL_TEXT}'), (-1L, 1L, 'assistant', '{CONTROL_TEXT}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.read_back(chat.render(chat.fold_events(chat.event_log(turns)))))


@query("op9_media")
def op9_media(spark, sf_dir):
    """Every text stored as a medium, referred to by a page, resolved by digest and read back."""
    from foretrace.llm import media

    pages = media.page_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    stored = media.store_media(pages, keep=["digest"])
    known = media.describe_media(stored, keep=["digest", "n_bytes"])
    parts = media.resolve(media.interleave(pages.select("doc_id", "html"), keep=["doc_id"]), known)
    return parts.where("kind = 'media'").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    """Every document's language by segmentation-marginalised unigrams, a quarter held out."""
    import public_tokenizers

    from foretrace.llm import language_id
    from foretrace.llm.common import remainder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pieces = language_id.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = language_id.fitted(docs, pieces, remainder(F.col("doc_id"), 4) != 2)
    found = language_id.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op11_source_divergence", r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS size FROM kept GROUP BY 1),
n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(size, 0)::HUGEINT AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS size FROM n GROUP BY ALL) USING (lang, source)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000 * (coalesce(n.n, 0) + 2)::HUGEINT) // (g.size + 2 * v) AS p,
         1 + (1000000000 * (k.total + 2)::HUGEINT) // (langs.size + 2 * v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN n USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
typical AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (FROM pairs UNION ALL FROM typical)
QUALIFY part = 'pair' OR rank <= 10""")
def op11_source_divergence(spark, sf_dir):
    """How far the sources of each language differ, and each source's most typical terms."""
    from foretrace.llm import divergence

    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_warc", """
WITH held AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM held),
typed AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM response AND response IS NOT NULL AS again FROM last)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN response END AS refers_to
FROM typed""")
def op12_warc(spark, sf_dir):
    """All pages written as WARC records into seekable bundles, read back, revisits resolved through the index."""
    from foretrace.llm import warc

    records = warc.resolved(warc.write_archive(table(spark, sf_dir, "pages")))
    return records.select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("response").cast("long").alias("refers_to"))


def _clustering_sql(clusters: int = 16, rounds: int = 3) -> str:
    """Rounds of exact k-means, one common table expression after the other."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT id, vec_id, q, c, d FROM (SELECT v.id, v.vec_id, v.q, k.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - k.q[i]) * (v.q[i] - k.q[i])))::BIGINT AS d FROM v, c{r} k)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)"""
    moved = """c{n} AS MATERIALIZED (
  SELECT c, coalesce(m.q, o.q) AS q FROM c{r} o LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q
    FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY ALL) GROUP BY c) m USING (c))"""
    steps = [nearest.format(r=0)]
    for i in range(rounds):
        steps += [moved.format(r=i, n=i + 1), nearest.format(r=i + 1)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT q, sha256('1:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT {clusters})),
{', '.join(steps)}
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(k.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k USING (c)"""


@query("op13_centroids", _clustering_sql())
def op13_centroids(spark, sf_dir):
    """Every embedding's exact k-means cluster in integers, by Shallot search."""
    from foretrace.llm import centroids

    assigned, found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(assigned, found).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

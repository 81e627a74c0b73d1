"""Source divergence, WARC bundles and centroid clustering against plain versions."""

import hashlib
import io
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from foretrace.llm import centroids, divergence, warc
from llm_rows import no_docs, odd_docs  # noqa: F401

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(rows, least, top):
    """All shares and differences, term by term."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(r["lang"] or "", r["source"] or "", TERM.findall((r["text"] or "").translate(lower))) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in held.items() if n >= least]
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if held[t] >= least)
        whole = sum(counts.values(), Counter())

        def share(c, term):
            return 1 + 10**9 * (c[term] + 2) // (sum(c.values()) + 2 * len(kept))

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        for source, c in counts.items():
            pairs = [(sum(apart(share(c, t), share(d, t)) for t in kept), other) for other, d in counts.items() if other != source]
            terms = [(apart(share(c, t), share(whole, t)), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


def audited(docs, **limits):
    rows = [tuple(r) for r in divergence.audit(docs, **limits).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_divergence_equals_the_plain_sums(spark):
    rng = random.Random(5)
    words = [*"abcdefgh", "Été", "été", "straße", "中文", "É"]
    rows = []
    for i in range(300):
        weights = [1 / (1 + (j + i % 7) % len(words)) ** 2 for j in range(len(words))]
        text = " ".join(rng.choices(words, weights, k=rng.randint(0, 12))) + rng.choice(["", "-x1y", ".A_B", f" junk{i}"])
        rows.append((i % 250, rng.choice([text, text.upper(), None]), rng.choice(["en", "en", "en", None, "fr"]), rng.choice(["s", "t", "t", "t", "é", None, ""])))
    rows.append((1, "lonely words", "xx", "s"))
    rows.append((1, None, "xx", "t"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.lit(1) for c in ("rank", "Value", "term", "salt", "row", "path")})
    assert audited(docs, least_documents=3, top_terms=4) == plain_audit(docs.collect(), 3, 4)


def test_divergence_of_odd_and_no_rows(odd_docs, no_docs):
    assert audited(odd_docs, least_documents=2) == plain_audit(odd_docs.collect(), 2, 10)
    assert audited(odd_docs) == plain_audit(odd_docs.collect(), 10, 10)
    assert not audited(no_docs)


def test_chunks_and_sweeps_cut_anywhere_sum_alike(odd_docs, monkeypatch):
    want = audited(odd_docs, least_documents=2)
    monkeypatch.setattr(divergence, "CHUNK_TERMS", 3)
    monkeypatch.setattr(divergence, "slices", lambda batch: (batch.slice(i, 2) for i in range(0, batch.num_rows, 2)))
    assert audited(odd_docs.repartition(5), least_documents=2) == want


def test_tree_sums_each_pair_of_a_row():
    rng = np.random.default_rng(3)
    rows = Counter(tuple((s, int(rng.integers(3, 6)), 2) for s in "abcdef" if rng.random() < 0.6) or (("a", 3, 2),) for _ in range(400))
    want = Counter()
    for row, times in rows.items():
        for i, (a, p, x) in enumerate(row):
            for b, q, y in row[i + 1:]:
                f = divergence.differences
                want[a, b] += times * (f(p, q) - f(p, y) - f(x, q) + f(x, y))
    got, ordered = Counter(), sorted(rows)
    flat = [x for row in ordered for x in row]
    numbers = [np.array([ord(x[0]) for x in flat]), *(np.array([x[i] for x in flat]) for i in (1, 2)), np.array([len(r) for r in ordered]), np.array([rows[r] for r in ordered])]
    for above, node, value in divergence.node_corrections(*numbers):
        got.update({(chr(a), chr(b)): int(v) for a, b, v in zip(above, node, value)})
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


LONG = "<p>" + "grüße " * 400 + "</p>"
PAGES = [
    (1, "http://a.org/1", LONG), (2, "http://a.org/2", LONG), (2, "http://a.org/2", LONG), (3, None, LONG), (None, "http://b.org/", LONG),
    (4, "http://c.org/with space\r\nX-Evil: 1", "short"), (5, "http://c.org/é", "short"), (6, "http://d.org/", None), (7, "", ""),
    (8, "http://e.org/", "x" * 999), (9, "http://e.org/", "x" * 999), (10, "http://e.org/", "x" * 1000), (11, "http://e.org/", "x" * 1000),
    (12, "http://f.org/", "WARC/1.1\r\n\r\n" * 200_000), (None, "http://g.org/", "y" * 2000), (None, "http://g.org/", "y" * 2000),
]


@pytest.fixture(scope="module")
def archive(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("digest", "Payload", "salt", "last", "key")})
    return warc.write_archive(pages.drop("Payload").repartition(3), frame_bytes=3000, bundle_bytes=200).cache()


def test_archive_holds_every_page(archive):
    rows = warc.resolved(archive).collect()
    got = Counter((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["response"]) for r in rows)
    want = Counter()
    for page, _, html in PAGES:
        data = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "").encode() == data and p is not None]
        again = len(data) >= 1000 and ids and page != max(ids)
        want[None if page is None else str(page), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", str(max(ids)) if again else None] += 1
    assert got == want
    urls = {r["key"]: r["url"] for r in rows if r["key"]}
    assert urls["4"] == "http://c.org/with%20space%0D%0AX-Evil:%201" and urls["5"].endswith("é") and urls["3"] is None


def test_bundles_are_plain_zstandard_and_seekable(archive):
    index = archive.collect()
    paths = {r["path"] for r in index}
    assert len(paths) > 3
    held = 0
    for path in paths:
        store, place = warc.store_of(path)
        packed = store.open_input_file(place).read()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(packed), read_across_frames=True).read()
        table, at, starts = warc.seek_table(path), 0, []
        for start, length, size, _ in table:
            starts.append(at)
            assert zstandard.ZstdDecompressor().decompress(packed[start:start + length]) == whole[at:at + size]
            at += size
        assert at == len(whole)
        for r in (r for r in index if r["path"] == path):
            fields, _, end = warc.parse(whole, starts[r["frame"]] + r["offset"])
            assert fields["warc-record-id"] == r["record_id"] and end - starts[r["frame"]] - r["offset"] == r["length"]
            held += 1
    assert held == len(PAGES)


def test_fetch_reads_wanted_records_only(archive, spark):
    records = warc.read_records(archive, payloads=True).collect()
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in records if r["record_type"] == "response")
    wanted = [r["record_id"] for r in records if r["key"] in ("5", "12")]
    ids = spark.createDataFrame([(x,) for x in [*wanted, *wanted, None, "<urn:uuid:none>"]], "record_id string")
    got = {r["record_id"]: bytes(r["payload"]) for r in warc.fetch(archive, ids).collect()}
    assert sorted(got) == sorted(wanted) and set(got.values()) == {b"short", ("WARC/1.1\r\n\r\n" * 200_000).encode()}


def test_a_damaged_frame_is_found(archive, tmp_path):
    store, place = warc.store_of(archive.first()["path"])
    data = bytearray(store.open_input_file(place).read())
    (start, length, size, checksum), bad = warc.seek_table(archive.first()["path"])[0], str(tmp_path / "bad.warc.zst")
    data[start + length // 2] ^= 1
    open(bad, "wb").write(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.frames_of([bad], [start], [length], [size], [checksum]))


def test_an_empty_archive(spark):
    index = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert index.count() == warc.resolved(index).count() == 0


def plain_clusters(rows, clusters, rounds):
    """Integer k-means by all distances."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    ranked = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centres = [q for _, q in ranked[:clusters]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        found = [nearest(q)[1] for _, q in kept]
        for n in set(found):
            mine = [q for (_, q), c in zip(kept, found) if c == n]
            centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return Counter((i, nearest(q)[1], nearest(q)[0]) for i, q in kept), centres


def vectors(n, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (7, 64))
    return [(int(i), [float(x) for x in np.round(centres[rng.integers(7)] + rng.normal(0, spread, 64), 2)]) for i in range(n)]


@pytest.mark.parametrize("rows, clusters", [(vectors(300, 0.4, 1), 16), (vectors(300, 0.0, 2), 16), (vectors(5, 1.0, 3), 16), (vectors(40, 1.0, 4), 1)])
def test_clusters_equal_all_distances(spark, rows, clusters):
    odd = [(900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (None, [0.5] * 64), *rows[:3], rows[0]]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("q", "First", "cluster", "key")})
    found, centres = centroids.cluster(table.repartition(3), clusters=clusters)
    want, plain = plain_clusters(rows + odd, clusters, 3)
    assert Counter(tuple(r) for r in found.collect()) == want and centres.tolist() == plain
    measured = centroids.with_inertia(found, centres).collect()
    sums = defaultdict(int)
    for (_, c, d), n in want.items():
        sums[c] += n * d
    assert {(r["cluster"], r["cluster_inertia"], r["inertia"]) for r in measured} == {(c, s, sum(sums.values())) for c, s in sums.items()}
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, plain[r["cluster"]])).encode()).hexdigest() for r in measured)


def test_search_follows_moving_centroids_and_ties():
    rng = np.random.default_rng(9)
    q = rng.integers(-3, 4, (500, 8))
    before, now = None, rng.integers(-3, 4, (12, 8))
    now[5] = now[2]
    first, second, upper, lower = np.zeros(500, int), np.ones(500, int), np.full(500, np.inf), np.zeros(500)
    for _ in range(6):
        first, second, upper, lower = centroids.Shallot(now, before).assign(q, first, second, upper, lower)
        squared = ((q[:, None] - now[None]) ** 2).sum(2)
        assert (first == squared.argmin(1)).all()
        rest = squared.copy()
        rest[np.arange(500), first] = 1 << 40
        assert (upper >= np.sqrt(squared.min(1))).all() and (lower <= np.sqrt(rest.min(1))).all()
        before, now = now, now + rng.integers(-1, 2, now.shape)


def test_bounds_spare_most_comparisons(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (16, 64))
    q = centres[rng.integers(0, 16, 2000)] + rng.integers(-20, 20, (2000, 64))
    compared = []
    plain = centroids.Shallot.squared
    monkeypatch.setattr(centroids.Shallot, "squared", lambda self, v, c: compared.append(len(v)) or plain(self, v, c))
    state = centroids.Shallot(centres).assign(q, np.zeros(2000, int), np.ones(2000, int), np.full(2000, np.inf), np.zeros(2000))
    full = sum(compared)
    centroids.Shallot(centres + 1, centres).assign(q, *state)
    assert full < 2000 * 16 and sum(compared) - full < 100


def test_no_vectors_and_huge_components(spark):
    schema = "vec_id long, embedding array<float>"
    found, centres = centroids.cluster(spark.createDataFrame([], schema))
    assert found.count() == 0 and centroids.with_inertia(found, centres).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], schema))

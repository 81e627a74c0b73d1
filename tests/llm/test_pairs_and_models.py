"""The Jaccard join against brute force, models on held-out rows, and the pipeline."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from foretrace.llm import components, jaccard_join, language_id, quality_classifier, toxicity
from foretrace.llm.common import remainder
from foretrace.llm.shingles import U64, shingle_set
from llm_rows import no_docs, odd_docs  # noqa: F401


SMALL = "/root/testdata/sf0.001"


def plain_sets(texts, width):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def plain_components(sets, percent):
    part = list(range(len(sets)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                part[b] = a
    return [find(i) for i in range(len(sets))]


def near_copies(seed, groups=12, copies=12):
    rng, rows = random.Random(seed), []
    passage = [f"shared{k}" for k in range(25)]
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((5, 9, 14, 40, 120)))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
            rows.append(" ".join(passage + w if g % 3 == 0 else w))
    return rows + ["", None, "one", "two words", "a a a a", "a a a a a a"]


@pytest.mark.parametrize("limit,capacity", [(16, 1 << 20), (2, 1 << 20), (1, 40)])
def test_components_match_brute_force(spark, limit, capacity):
    texts = near_copies(limit)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("key", F.lit("clash"))
    sets = plain_sets(texts, 4)
    want = plain_components(sets, 85)
    got = {r["doc_id"]: r for r in jaccard_join.component_ids(docs, rare_limit=limit, frequent_capacity=capacity).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), want[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("limit,capacity", [(16, 1 << 20), (1, 40)])
def test_links_match_brute_force(spark, monkeypatch, limit, capacity):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 5)
    base = [f"v{i}" for i in range(120)]
    texts = near_copies(limit, groups=8) + [" ".join(base[:k] + ["changed"] + base[k + 1:]) for k in range(4, 116, 4)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "doc_id bigint, text string")
    first = {}
    for i, s in enumerate(plain_sets(texts, 4)):
        if s:
            first.setdefault(frozenset(s), i)
    sets = sorted(first, key=first.get)
    want = [(first[x], first[y], len(x), len(y)) for i, x in enumerate(sets) for y in sets[i + 1:] if 100 * len(x & y) >= 85 * len(x | y)]
    rows = jaccard_join.links(docs, rare_limit=limit, frequent_capacity=capacity).collect()
    assert sorted(map(tuple, rows)) == sorted(want) and len(want) >= 28 * 27 / 2


def test_signatures_cover_every_similar_pair():
    rng, rule = np.random.default_rng(5), jaccard_join.Rule(4, 85)
    for _ in range(300):
        n = int(rng.integers(6, 300))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(U64))
        drop = rng.random(len(x)) > rng.random() * 0.12
        y = np.unique(np.concatenate([x[drop], rng.integers(0, 1 << 62, int(rng.integers(0, max(1, n // 12) + 1))).astype(U64)]))
        if not rule.similar(x, y) or np.array_equal(x, y):
            continue
        common = np.sort(rng.choice(x, int(rng.random() * len(x)), replace=False))
        assert np.intersect1d(jaccard_join.signatures(x, common, rule)[0], jaccard_join.signatures(y, common, rule)[0]).size
        assert 185 * jaccard_join.differing_bits(jaccard_join.parity_bitmap(x), jaccard_join.parity_bitmap(y)) <= 15 * (len(x) + len(y))


def test_join_of_odd_rows(odd_docs, no_docs):
    rows = jaccard_join.component_ids(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"]}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[4] == 4 and by_id[5] == 5 and by_id[10] == 10
    kept = jaccard_join.one_of_each(odd_docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"]) == [1, 4, 5, 6, 7, 8, 10, 11, 12, 13] and len(kept) == 12
    assert jaccard_join.component_ids(no_docs).count() == 0


def test_one_long_text_is_hashed_like_its_words():
    text = "alpha beta  gamma\ndelta " * 60_000
    assert np.array_equal(shingle_set(text, 4), shingle_set(text.upper(), 4)) and len(shingle_set(text, 4)) == 4
    assert len(shingle_set("x" * 10_000 + " y", 4)) == 1 and len(shingle_set("", 4)) == 0


def test_paths_and_stars_become_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 9)] + [(7, 7)]
    links = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {(r["a"], r["b"]) for r in components.roots(links).collect()} == {(i, 0) for i in range(1, 21)} | {(100 + i, 100) for i in range(1, 9)}
    assert components.roots(links.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.mark.parametrize("task_rows", [1 << 18, 50])
def test_components_match_union_find(spark, monkeypatch, task_rows):
    """Chains, a star and random links, read by one task or by many."""
    monkeypatch.setattr("foretrace.llm.common.TASK_ROWS", task_rows)
    rng = np.random.default_rng(5)
    links = [tuple(map(int, p)) for p in rng.integers(0, 200, (130, 2))] + [(500, 600 + k) for k in range(100)] + [(1000 + k, 1001 + k) for k in range(40)]
    least = {x: x for p in links for x in p}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    found = components.roots(spark.createDataFrame(links, "a bigint, b bigint"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((x, m) for x, m in least.items() if x != m)


def test_quality_on_held_out_rows(spark, tables, odd_docs, no_docs):
    docs, labels = tables
    scored = queries()["op5_quality_classifier"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) >= 0.93
    assert all(r["predicted"] == 1 for r in scored if r["quality"] == 1)
    model = quality_classifier.fitted(docs, labels, remainder(F.col("doc_id"), 5) != 0, labelled_rows=100)
    odd = quality_classifier.score(odd_docs.withColumn("Score", F.lit("old")), model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_classifier.score(no_docs, model).count() == 0
    assert quality_classifier.fitted(docs, labels.limit(0), F.lit(True)) is None
    assert {r["score"] for r in quality_classifier.score(odd_docs, None).collect()} == {0.5}


def test_vote_equals_all_cosines():
    rng = np.random.default_rng(3)
    raw, labels = rng.random((60, quality_classifier.TRIGRAMS + 72)).astype(np.float32), rng.integers(0, 2, 60)
    model = quality_classifier.fit(raw, labels, dimensions=8)
    vectors = quality_classifier.unit(quality_classifier.weighted(raw, model["idf"]) @ model["basis"])
    for i, score in enumerate(quality_classifier.vote(model, raw, neighbours=5)):
        cosine = vectors @ vectors[i]
        near = np.argsort(-cosine)[:5]
        w = np.maximum(cosine[near], 1e-6).astype(float) ** quality_classifier.POWER
        good, bad = (w * labels[near]).sum() / labels.mean(), (w * (1 - labels[near])).sum() / (1 - labels.mean())
        assert score == pytest.approx(good / (good + bad), abs=1e-4)


def test_toxic_words_are_learned_through_the_chain(spark, tables, odd_docs, no_docs):
    docs, labels = tables
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 200))]
        poor, toxic = i % 4 == 0, i % 5 == 0
        words += ["buy"] * poor + [rng.choice(("vilest", "Vilene,", "vilem!"))] * toxic
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, int(poor), int(toxic)))
    small, truth = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, poor int, toxic int")
    chain = toxicity.fitted(small, truth, ["poor", "toxic"], F.col("doc_id") % 2 == 0)
    assert len(chain) == 2 and len(chain[1]["extra"]) == 1
    held = toxicity.score(small, chain, ["p_poor", "p_toxic"]).join(truth, "doc_id").where("doc_id % 2 = 1").collect()
    assert np.mean([(r["p_toxic"] >= 0.5) == (r["toxic"] == 1) for r in held]) >= 0.97
    odd = toxicity.score(odd_docs.withColumn("P_TOXIC", F.lit("old")), chain, ["p_poor", "p_toxic"]).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["p_toxic"] <= 1 for r in odd)
    assert toxicity.score(no_docs, chain, ["p_poor", "p_toxic"]).count() == 0
    assert toxicity.fitted(small, truth.limit(0), ["poor", "toxic"], F.lit(True)) == []
    assert {r["p"] for r in toxicity.score(odd_docs, [], ["p"]).collect()} == {0.0}


def all_cuts(word, p, unknown):
    """Sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        piece = p.get(word[:k], unknown if k == 1 else None)
        if piece is not None:
            total += piece * all_cuts(word[k:], p, unknown)
    return total


def test_forward_sums_all_segmentations_and_uses_add_up():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab"]
    p = np.random.default_rng(2).dirichlet(np.ones(len(pieces)))[:, None]
    lattice, words = language_id.Lattice(pieces), ["▁abab", "▁bbaz", "▁a", "▁ababa"]
    for some, table in lattice.groups(words):
        got = lattice.forward(table, language_id.padded(p))[-1][:, 0]
        for i, x in zip(some, got):
            assert x == pytest.approx(all_cuts(words[i], dict(zip(pieces, p[:, 0])), language_id.UNKNOWN))
        uses = lattice.expected(table, language_id.padded(p), np.ones(len(some)))
        lengths = np.array([len(x) for x in pieces] + [1, 0])
        assert (uses * lengths).sum() == pytest.approx(sum(len(words[i]) for i in some))


def log_of_all_cuts(word, p, unknown):
    """The same by exact fractions, beginning by beginning."""
    p = {x: Fraction(float(v)) for x, v in p.items()}
    ahead = [Fraction(1)]
    for end in range(1, len(word) + 1):
        ahead.append(sum(ahead[end - k] * p.get(word[end - k:end], Fraction(unknown) if k == 1 else 0) for k in range(1, min(4, end) + 1)))
    return math.log(ahead[-1].numerator) - math.log(ahead[-1].denominator)


def test_a_run_of_any_length_is_one_word(spark):
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab"]
    p = np.random.default_rng(2).dirichlet(np.ones(len(pieces)), 2).T
    lattice, rows = language_id.Lattice(pieces), language_id.padded(p)
    text = "ab" * 30 + " " + "abbaz" * 100 + " ab " + "b" * 40 + " " + "b" * 41
    words = language_id.words_of(text)
    assert [w[1:] for w in words] == text.split() and [language_id.weight_of(w) for w in words] == [2, 13, 1, 1, 2]
    got = lattice.log_words(words, rows)
    for w, x in zip(words, got):
        for i in range(2):
            assert x[i] == pytest.approx(log_of_all_cuts(w, dict(zip(pieces, p[:, i])), language_id.UNKNOWN))
    lengths = np.array([len(x) for x in pieces] + [1, 0])
    assert (lattice.log_expected(words[1], np.log(rows[:, [0]] + 1e-320), 3.0) * lengths).sum() == pytest.approx(3 * len(words[1]))
    (_, table), = lattice.groups([words[0]])
    assert np.allclose(lattice.log_expected(words[0], np.log(rows[:, [0]] + 1e-320), 1.0), lattice.expected(table, rows[:, [0]], np.ones(1)))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    model = {"languages": ["x", "y"], "prior": np.log([0.5, 0.5]), "pieces": pieces, "p": p}
    total = got.sum(0)
    row = language_id.predict(docs, model).first()
    tempered = (total - total.max()) * min(1.0, 30 / 19)
    assert row["lang_pred"] == "xy"[int(np.argmax(total))] and row["score"] == pytest.approx(1 / np.exp(tempered).sum())


def test_languages_of_held_out_rows(spark, tables, odd_docs, no_docs):
    docs, _ = tables
    found = queries()["op10_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) >= 0.97
    pieces = ["▁"] + list("abcdefghijklmnopqrstuvwxyzé")
    model = language_id.fitted(docs, pieces, F.lit(True), sample_rows=50, rounds=1)
    odd = {r["doc_id"]: r for r in language_id.predict(odd_docs.withColumn("LANG_PRED", F.lit("old")), model).collect()}
    assert odd[4]["lang_pred"] == odd[5]["lang_pred"] == odd[6]["lang_pred"] == "und" and odd[8]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert language_id.predict(no_docs, model).count() == 0
    assert language_id.fitted(no_docs, pieces, F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.predict(odd_docs, None).collect()} == {"und"}


def test_every_stage_keeps_columns_and_clean_rows(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    clean = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SMALL).cache()
        assert out.columns == docs.columns, name
        if name in ("quality", "language"):
            before = {r["doc_id"] for r in seen.select("doc_id").collect()} & clean
            assert len(before - {r["doc_id"] for r in out.select("doc_id").collect()}) <= 0.02 * len(before)
        if name == "near_duplicates":
            texts = [r["text"] for r in seen.orderBy("doc_id").collect()]
            ids = [r["doc_id"] for r in seen.orderBy("doc_id").collect()]
            part = plain_components(plain_sets(texts, 5), 80)
            assert sorted(r["doc_id"] for r in out.collect()) == sorted({ids[p] for p in part})
        seen = out
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SMALL)
    assert last.count() == seen.count() and last.agg(F.sum("n_tokens")).first()[0] > 0


def test_stages_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    clash = odd_docs.withColumn("score", F.lit(1)).withColumn("Words", F.lit(2)).withColumn("digest", F.lit("d"))
    for docs in (clash, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SMALL).columns == docs.columns, name
            stage(spark, docs, SMALL).collect()


def test_the_vote_is_fitted_in_a_task(spark, odd_docs, monkeypatch):
    """The driver gets the model, not the sample's vectors and their products."""
    labels = spark.createDataFrame([(r["doc_id"], int(i % 2)) for i, r in enumerate(odd_docs.collect())], "doc_id bigint, quality int")
    monkeypatch.setattr(np.linalg, "eigh", lambda *_: pytest.fail("the driver fits"))
    monkeypatch.setattr(type(odd_docs), "toArrow", lambda *_: pytest.fail("the driver collects the sample"))
    model = quality_classifier.fitted(odd_docs, labels, F.lit(True))
    assert model["vectors"].shape == (len(model["labels"]), quality_classifier.DIMENSIONS)

"""Mixing, URL filters and chat formatting against plain versions."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foretrace.llm import chat, mixing, url_filters
from foretrace.llm.queries import CURRICULUM, RULES
from llm_rows import no_docs, odd_docs  # noqa: F401

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(sizes, weights, share=1.5):
    """Fill by weight, cap at twice the size, share the excess again."""
    total, target, open_ = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        rest = total - sum(target[s] for s in sizes if s not in open_)
        unit = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else unit * weights[s]
        if not full:
            break
        open_ -= full
    return target


def test_targets_and_taken_words(odd_docs):
    mixed = mixing.mix(odd_docs.withColumn("Target", F.lit("x")), CURRICULUM, rows_per_bucket=3).cache()
    rows = mixed.collect()
    assert len(rows) == odd_docs.count()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = plain_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = {(r["doc_id"], r["text"]): r["taken"] for r in mixing.mix(odd_docs.repartition(3), CURRICULUM, rows_per_bucket=3).collect()}
    assert sum(again.values()) and all(again[r["doc_id"], r["text"]] == r["taken"] for r in rows if r["doc_id"] not in (2, None))


def test_training_order_is_sorted_and_cut_to_the_word(odd_docs):
    mixed = mixing.mix(odd_docs, CURRICULUM).cache()
    rows = mixing.training_order(mixed).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows) and all(0 <= r["position"] <= 1 for r in rows)
    assert all(len(WORD.findall(r["text"])) == r["words"] for r in rows)
    assert sum(r["words"] for r in rows) == mixed.agg(F.sum("taken")).first()[0]


def test_the_last_document_of_a_target_can_stay_whole(odd_docs):
    mixed = mixing.mix(odd_docs, CURRICULUM).cache()
    rows = mixing.training_order(mixed, whole=True).collect()
    texts = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows) and any(r["words"] < r["size"] for r in rows)
    assert all((r["doc_id"], r["text"]) in texts and len(WORD.findall(r["text"])) == r["size"] for r in rows)
    assert sum(r["words"] for r in rows) == mixed.agg(F.sum("taken")).first()[0]
    staged = corpus_pipeline.mixture(odd_docs.sparkSession, odd_docs, "").collect()
    assert len(staged) == len(rows) and all((r["doc_id"], r["text"]) in texts for r in staged)


def test_positions_follow_the_schedules(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s) for s in ("falls", "level", "rises") for i in range(300)], "doc_id bigint, text string, source string")
    rows = mixing.mix(docs, [[(0.0, 2.0), (1.0, 0.0)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 2.0)]], share_percent=100).collect()
    early = collections.Counter(r["source"] for r in rows for t in r["takes"] if t["position"] < 0.5)
    assert abs(early["falls"] - 225) <= 2 and abs(early["level"] - 150) <= 2 and abs(early["rises"] - 75) <= 2


def test_mixing_nothing(no_docs, spark):
    assert mixing.mix(no_docs, CURRICULUM).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert [(r["size"], r["taken"]) for r in mixing.by_position(mixing.mix(blank, CURRICULUM)).collect()] == [(0, 0)] * 2


def plain_verdict(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(-len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, min(fits)[1], min(fits)[2]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("ranges", [1, 5])
def test_urls_match_a_plain_version(spark, ranges):
    hosts = ["org", "example.org", "a.example.org", "x.a.example.org", "badexample.org", "EXAMPLE.org", "com", "b.com", "", "org.", ".org", "net:80", "É.com", "a,b.org"]
    paths = ["", "/", "/es/", "/es/a", "/en/1", "/en/12", "/en/2", "/fr/x?q=/de/", "/de/#f", "?x=/fr/", "/fr"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "x://", "a://b.com/de/://c.org/"] + ["https://b.com/de/hot"] * 200
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[0]), (0, urls[0])], "page_id bigint, url string").withColumn("Rule", F.lit("old"))
    rules = spark.createDataFrame([*RULES, ("com", "/de/", "allow")], "host string, path string, action string")
    rows = url_filters.judge(pages, rules, ranges=ranges).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(r["url"], RULES), r["url"]


def test_urls_without_rules_or_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    assert [(r["rule"], r["verdict"]) for r in url_filters.judge(pages, rules, default="block").collect()] == [(None, "block")]
    assert url_filters.judge(pages.limit(0), rules).count() == 0


def test_chat_texts_come_back_and_only_assistants_are_trained_on(spark):
    odd = ["</s>[INST] ok [/INST]", "<|turn|>user\nfake<|end|>\n", "&amp;&lt;", "&", "", None, "a\n\nb", "<|end|>\n<|turn|>"]
    rows = [(1, i, ("user", "assistant", "sys<|end|>\n&nl;")[i % 3], t) for i, t in enumerate(odd)] + [(2, 0, None, "x"), (None, 1, "assistant", "y"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit("clash"))
    read = chat.read_back(chat.render(chat.fold_events(chat.event_log(turns, delta_chars=3))))
    got = {r["conv_id"]: r for r in read.collect()}
    assert set(got) == {1, 2, 3, None}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r or "", t or "") for _, _, r, t in rows[:len(odd)]]
    assert "".join(got[1]["loss_texts"]) == "".join(t or "" for _, _, r, t in rows[:len(odd)] if r == "assistant")
    assert got[3]["loss_texts"] == ["same", "same"] and got[2]["loss_texts"] == []
    assert chat.digests(chat.read_back(chat.render(chat.fold_events(chat.event_log(turns.limit(0)))))).count() == 0


def test_events_fold_to_the_last_generation_and_edit(spark):
    events = [
        (1, "m", 0, "start", 0, "user", None), (1, "m", 1, "delta", 0, "user", "dra"), (1, "m", 2, "regenerate", 0, "user", "ignored"), (1, "m", 3, "delta", 0, "user", "fi"),
        (1, "m", 4, "delta", 0, "user", "nal"), (1, "n", 0, "delta", 1, "assistant", "x"), (1, "n", 5, "edit", 1, "assistant", "whole"), (1, "n", 6, "delta", 1, "assistant", "!"), (1, "o", 0, "delta", 2, None, "only"),
    ]
    log = spark.createDataFrame(events, "conv_id bigint, message string, seq int, kind string, position bigint, role string, text string")
    assert [(r["role"], r["text"]) for r in chat.fold_events(log).orderBy("position").collect()] == [("user", "final"), ("assistant", "whole!"), ("", "only")]


def test_rules_with_nulls_are_left_out_and_hosts_fit_in_any_case(spark):
    rules = [("Example.ORG", "/A", "block"), (None, "/", "block"), ("b.net", None, "block"), ("c.com", "/", None)]
    pages = spark.createDataFrame([(1, "http://www.EXAMPLE.org/A/x"), (2, "http://example.org/a"), (3, "http://b.net/"), (4, "http://c.com/"), (5, None)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    assert got == {1: ("example.org/A", "block"), **dict.fromkeys((2, 3, 4, 5), (None, "allow"))}

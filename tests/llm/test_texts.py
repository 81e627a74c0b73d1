"""Tokens, media and quality rules against plain versions."""

import collections
import hashlib
import re
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foretrace.llm import byte_bpe, common, media, quality_rules
from llm_rows import no_docs, odd_docs  # noqa: F401

WORD = re.compile("[^\x20\x09-\x0d]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_ids_and_bytes_are_those_of_the_library(odd_docs):
    encoding = byte_bpe.codec(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    clash = odd_docs.withColumn("Token_IDs", F.lit(1))
    coded = byte_bpe.decode_documents(byte_bpe.encode_documents(clash, RANKS, public_tokenizers.PATTERN, split_chars=50), RANKS, public_tokenizers.PATTERN)
    rows = coded.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert list(r["token_ids"]) == encoding.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_one_pass_equals_two_and_the_library(odd_docs):
    pattern, clash = public_tokenizers.PATTERN, odd_docs.withColumn("Decoded", F.lit(1))
    encoding = byte_bpe.codec(byte_bpe.read_ranks(RANKS), pattern)
    rows = byte_bpe.code_documents(clash, RANKS, pattern, split_chars=50).collect()
    assert len(rows) == odd_docs.count() and "Decoded" not in rows[0]
    assert all(list(r["token_ids"]) == encoding.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows)
    staged = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.tokens(odd_docs.sparkSession, odd_docs, "").collect() if r["doc_id"]}
    assert staged == {r["doc_id"]: len(encoding.encode_ordinary(r["text"] or "")) for r in rows if r["doc_id"]}


def test_other_patterns_are_never_split():
    greedy = r"[^\s]+[\r\n ]*|\s+"
    encoding, text = byte_bpe.codec(byte_bpe.read_ranks(RANKS), greedy), "word \n" * 50
    assert byte_bpe.encode(encoding, text, byte_bpe.split_limit(greedy, 10)) == encoding.encode_ordinary(text)
    assert byte_bpe.split_limit(public_tokenizers.PATTERN, 10) == 10


@pytest.mark.parametrize("text", ["a b  c\n\n d", "x" * 300, " lead", "tail  ", "don't  \n stop\u00a0 now \x85 y\x1c z", "ab \u3000 cd\n" * 40])
@pytest.mark.parametrize("limit", [1, 3, 10])
def test_safe_parts_encode_like_the_whole(text, limit):
    encoding = byte_bpe.codec(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    assert "".join(byte_bpe.safe_parts(text, limit)) == text
    assert byte_bpe.encode(encoding, text, limit) == encoding.encode_ordinary(text)


def test_token_digests_of_an_empty_table(no_docs):
    encoded = byte_bpe.encode_documents(no_docs, RANKS, public_tokenizers.PATTERN, keep=["doc_id"])
    assert byte_bpe.digests(byte_bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN)).count() == 0


def test_media_are_stored_losslessly_and_resolved(odd_docs):
    pages = media.page_of(odd_docs.withColumn("digest", F.lit("old")))
    known = media.describe_media(media.store_media(pages, keep=["digest"]), keep=["digest", "n_bytes"])
    parts = media.resolve(media.interleave(pages, keep=["doc_id", "text", "digest"]), known)
    assert parts.count() == 2 * odd_docs.count()
    for r in parts.where("kind = 'media'").collect():
        data = (r["text"] or "").encode() if "text" in r.asDict() and r["text"] else None
        assert r["position"] == 1 and r["caption"].startswith("Text of document")
        assert r["payload_bytes"] % 64 == 0 and r["payload_bytes"] >= max(64, r["n_bytes"])
        assert data is None or r["n_bytes"] == len(data)


def test_payload_round_trip():
    for data in (b"", b"a", b"x" * 64, bytes(range(256)) * 3 + b"\n\n"):
        payload = media.padded(data)
        stored = media.store(payload)
        assert media.read_stored(stored) == payload and payload.startswith(data) and len(payload) % 64 == 0 and payload
        assert zlib.crc32(payload[-64:]) >= 0 and hashlib.sha256(stored).hexdigest()


def test_sequences_keep_order_and_captions(spark):
    html = ('<html><head><title>t</title></head><body><p>One <b>two</b></p><figure><img src="sha256:aa" alt="x"><figcaption>Cap  tion</figcaption></figure>'
            '<p>three<img src="http://e/x.png" alt="alt"> four</p><script>no</script></body></html>')
    parts = media.sequence(html)
    assert [(p["position"], p["kind"], p["text"], p["ref"], p["caption"]) for p in parts] == [
        (0, "text", "One two", None, None), (1, "media", None, "sha256:aa", "Cap tion"), (2, "text", "three", None, None),
        (3, "media", None, "http://e/x.png", "alt"), (4, "text", "four", None, None)]
    assert media.sequence(None) == media.sequence("") == []
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id bigint, html string")
    known = spark.createDataFrame([("aa", 7), ("aa", 7), (None, 1)], "digest string, size int")
    rows = media.resolve(media.interleave(pages), known).orderBy("position").collect()
    assert [(r["position"], r["size"]) for r in rows] == [(0, None), (1, 7), (2, None), (3, None), (4, None)]


@pytest.mark.parametrize("end", ["</head>", "", "</head></head>"])
@pytest.mark.parametrize("body", ["<body>", "", "<body class='x'>\n"])
def test_a_head_without_end_tag_ends_where_the_body_begins(end, body):
    head = "<html><head>\n<meta charset=utf-8><title>no title</title><style>p{}</style><script>no()</script>\n"
    rest = "<p>One</p><img src=a alt=b><template>no</template><title>Two</title></html>"
    assert [(p["kind"], p["text"] or p["ref"]) for p in media.sequence(head + end + body + rest)] == [("text", "One"), ("media", "a"), ("text", "Two")]
    assert [p["text"] for p in media.sequence(head + end + "bare text <b>of</b> a page")] == ["bare text of a page"]


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    starts = collections.defaultdict(list)
    for i in range(len(words) - 7):
        starts[tuple(words[i:i + 8])].append(i)
    repeated = {i + k for at in starts.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))


def test_base_measures_match_a_plain_version(spark, odd_docs):
    more = spark.createDataFrame([
        (20, "a b c d e f g h a b c d e f g h i"), (21, "one two three four five six seven eight nine " * 3), (22, "| a | b #*$ <x>\n\n| a |\n| a |\n"), (23, "w " * 30),
    ], "doc_id bigint, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more).withColumn("source", F.lit("s"))
    for r in quality_rules.judge(docs).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == plain_measures(r["text"]), r["doc_id"]
        assert r["base_failed"] == (got[0] < 20 or 100 * got[4] > 30 * got[0])
        assert not (r["base_failed"] and r["kept"])


def test_lines_of_many_documents_go_and_depleted_documents_with_them(spark):
    boiler = "Subscribe to our newsletter number 1 for all the news that is fit to print every day of the week"
    own = [f"unique {'x' * (i + 1)} alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau" for i in range(40)]
    rows = [(i, f"{own[i]}\n{boiler.replace('1', str(i % 10))}", "h") for i in range(20)] + [(i, own[i], "h") for i in range(20, 39)]
    rows += [(39, boiler + " \n" + boiler, "h"), (40, own[0] + "\n" + boiler, "other"), (41, rows[0][1], "h"), (42, boiler, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("KEPT", F.lit("old"))
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert len(got) == 43 and isinstance(got[0]["kept"], bool)
    assert got[0]["removed_words"] == len(boiler.split()) and got[0]["clean_text"] == own[0] and got[0]["kept"]
    assert got[41]["removed_words"] == got[0]["removed_words"] and got[25]["clean_text"] == own[25]
    assert got[39]["depleted"] and not got[39]["kept"]
    assert got[40]["removed_words"] == 0 and got[42]["removed_words"] == 0


@pytest.mark.parametrize("enough", [10, 15])
def test_a_line_of_enough_documents_goes_from_a_host_of_any_size(spark, enough):
    line = "all rights reserved by the owners of this page"
    rows = [(f"{host} {'x' * (i + 1)} own words" + f"\n{line}" * (i < 20), host) for host, n in (("small", 40), ("large", 400)) for i in range(n)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, source string")

    def touched(**limits):
        return {r["source"]: r["n"] for r in quality_rules.judge(docs, **limits).where("removed_words = 9").groupBy("source").agg(F.count("*").alias("n")).collect()}

    assert touched() == {"small": 20}
    assert touched(enough_documents=enough) == {"small": 20, "large": 20}
    assert touched(enough_documents=20) == {"small": 20}


def test_rules_of_an_empty_table(no_docs):
    assert quality_rules.judge(no_docs).count() == 0


def test_a_line_of_many_texts_goes_whatever_the_size_of_its_host(spark):
    """21 texts of a host of 21 and of one of 2,000 hold the same line: both hosts' texts are depleted alike."""
    line, words = "subscribe to our letter and share this page with all your friends today " * 3, "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(i, f"{line}\n{words} {i}", "small") for i in range(21)]
    rows += [(1000 + i, f"{line}\n{words} {i}" if i < 21 else f"own line {''.join(chr(97 + int(c)) for c in str(i))} " * 8, "large") for i in range(2000)]
    judged = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), enough_documents=20)
    gone = judged.where("depleted").select("doc_id").collect()
    assert sorted(r[0] for r in gone) == [*range(21), *range(1000, 1021)]


def test_batches_are_joined_and_cut_by_bytes():
    batch = pa.RecordBatch.from_pydict({"x": [b"a" * 100] * 10})
    whole = [*common.joined(iter([batch] * 7), 3 * batch.nbytes)]
    assert [b.num_rows for b in whole] == [30, 30, 10] and all(b.nbytes <= 700 or b.num_rows == 1 for w in whole for b in common.slices(w, 700))


def test_operators_leave_the_session_alone(spark, odd_docs):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    byte_bpe.code_documents(odd_docs, RANKS, public_tokenizers.PATTERN)
    media.store_media(odd_docs)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before

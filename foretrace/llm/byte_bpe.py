"""Byte-level BPE encoding and decoding with a local rank file.

A text longer than a limit is split before encoding, only where white space
follows a character that is no white space: every alternative of the
pre-splitting pattern that holds such a character ends with one, so a match
never crosses that place and the ids are those of the whole text. That holds for
``SAFE_PATTERNS``; under any other pattern texts are never split.

Null and empty texts have no ids and decode to no bytes. Ids decode to raw
bytes: the ids of a part of a text need not be valid UTF-8. Rows are handled
one by one, so ties, repeated rows and nulls in other columns change nothing.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from foretrace.llm.common import arrow_columns
from foretrace.session import ship_by_value

ship_by_value(__name__)

# Characters after which a long text is cut at the next safe place.
SPLIT_CHARS = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file (base64 and rank per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def codec(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    """The encoding of these ranks, without special tokens."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, limit: int = SPLIT_CHARS) -> Iterator[str]:
    """Parts of about ``limit`` characters that encode like the whole text."""
    place, start = re.compile(r"(?<=\S)[ \n]"), 0
    while len(text) - start > limit:
        cut = place.search(text, start + limit)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


# Fixed value: the pattern for which the places of ``safe_parts`` are safe.
SAFE_PATTERNS = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}


def split_limit(pattern: str, split_chars: int) -> int:
    """Characters after which texts may be split under a pattern; beyond any text where that isn't known to be safe."""
    return split_chars if pattern in SAFE_PATTERNS else 1 << 62


def encode(encoding: tiktoken.Encoding, text: str, limit: int = SPLIT_CHARS) -> list[int]:
    """Token ids of a text."""
    if len(text) <= limit:
        return encoding.encode_ordinary(text)
    return [i for part in safe_parts(text, limit) for i in encoding.encode_ordinary(part)]


def encode_documents(
    docs: DataFrame, rank_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, split_chars: int = SPLIT_CHARS,
) -> DataFrame:
    """Columns ``keep`` (default: all) and ``token_ids``, the ids of the whole text.

    The driver reads the rank file and broadcasts it: its size is that of the
    vocabulary and does not grow with the documents. Columns of the same name
    are replaced.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    column = docs.columns.index(text)

    def prepare():
        encoding, limit = codec(ranks.value, pattern), split_limit(pattern, split_chars)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            ids = (encode(encoding, t.as_py() or "", limit) for t in batch.column(column))
            return [pa.array(ids, pa.list_(pa.int32()))]

        return work

    fields = [StructField("token_ids", ArrayType(IntegerType(), False))]
    return arrow_columns(docs, docs.columns if keep is None else keep, fields, prepare)


def decode_documents(
    encoded: DataFrame, rank_path: str, pattern: str, ids: str = "token_ids", keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` (default: all) and ``decoded``, the bytes of the ids (null ids: none)."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    column = encoded.columns.index(ids)

    def prepare():
        encoding = codec(ranks.value, pattern)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array((encoding.decode_bytes(i.as_py() or []) for i in batch.column(column)), pa.binary())]

        return work

    return arrow_columns(encoded, encoded.columns if keep is None else keep, [StructField("decoded", BinaryType())], prepare)


def code_documents(
    docs: DataFrame, rank_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, split_chars: int = SPLIT_CHARS,
) -> DataFrame:
    """``encode_documents`` and ``decode_documents`` in one pass, so that a task holds one worker and one rank table."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    column = docs.columns.index(text)

    def prepare():
        encoding, limit = codec(ranks.value, pattern), split_limit(pattern, split_chars)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            ids = [encode(encoding, t.as_py() or "", limit) for t in batch.column(column)]
            return [pa.array(ids, pa.list_(pa.int32())), pa.array(map(encoding.decode_bytes, ids), pa.binary())]

        return work

    fields = [StructField("token_ids", ArrayType(IntegerType(), False)), StructField("decoded", BinaryType())]
    return arrow_columns(docs, docs.columns if keep is None else keep, fields, prepare)


def digests(coded: DataFrame) -> DataFrame:
    """Token counts and SHA-256 digests of the ids (decimal, joined by a space) and of the decoded bytes."""
    written = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(written.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Media columns: interleaved document sequences and losslessly stored payloads.

HTML is parsed into an ordered sequence of structs, text runs and media
references with their captions; references are resolved by joining their digest
to a table of media. Positions count from 0 in document order and stay with
their captions whatever the join finds.

Payloads are stored as 8-bit grey images (binary PGM): a header, then one
sample per byte, 64 to a row. Reading back takes the samples from the stored
bytes; features are computed of those.

Defined results: null or empty HTML is an empty sequence; a reference without
a medium keeps its position with a null payload; a head without an end tag ends
where HTML ends it, at the first tag or text that can't stand in a head; equal references resolve alike;
several media of one digest count once; null texts are stored as 64 zero bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from foretrace.llm.common import arrow_columns, replacing
from foretrace.session import ship_by_value

ship_by_value(__name__)

WIDTH = 64
SKIPPED = ("script", "style", "template", "noscript")
# What a head can hold; any other tag, or text, ends it.
HEAD = ("base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "title", *SKIPPED)
MEDIA = ("img", "audio", "video", "source", "embed")
BLOCKS = ("p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "table", "tr", "td", "figure", "figcaption", "nav", "body")
PART = StructType([
    StructField("position", LongType()), StructField("kind", StringType()), StructField("text", StringType()),
    StructField("ref", StringType()), StructField("caption", StringType()),
])


class Interleaver(HTMLParser):
    """Collects text runs and media references in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.run, self.skip, self.caption, self.figure = [], [], 0, None, None
        self.head, self.title = False, False

    def close_run(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.parts.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if not self.skip:
            self.head = tag == "head" or (self.head and tag in HEAD)
            self.title = self.head and tag == "title"
        if tag in SKIPPED:
            self.skip += 1
        elif tag in BLOCKS:
            self.close_run()
        if tag == "figure":
            self.figure = len(self.parts)
        elif tag == "figcaption":
            self.caption = []
        if tag in MEDIA and not self.skip:
            found = dict(attrs)
            if found.get("src"):
                self.close_run()
                self.parts.append({"kind": "media", "text": None, "ref": found["src"], "caption": found.get("alt")})

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ("head", "title"):
            self.head, self.title = self.head and tag != "head", False
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for part in self.parts[self.figure or 0:] if self.figure is not None else ():
                if part["kind"] == "media" and text:
                    part["caption"] = text
        elif tag == "figure":
            self.close_run()
            self.figure = None
        elif tag in BLOCKS:
            self.close_run()

    def handle_data(self, data):
        if self.head and not self.skip and not self.title and data.strip():
            self.head = False
        if not self.skip and not self.head:
            (self.run if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """The ordered parts of one page."""
    parser = Interleaver()
    parser.feed(html or "")
    parser.close()
    parser.close_run()
    return [{"position": i} | part for i, part in enumerate(parser.parts)]


def interleave(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all but the HTML) and ``parts``, the page's sequence."""
    column = pages.columns.index(html)
    kind = pa.list_(pa.struct([("position", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def prepare():
        return lambda batch: [pa.array((sequence(x.as_py()) for x in batch.column(column)), type=kind)]

    keep = [c for c in pages.columns if c != html] if keep is None else keep
    return arrow_columns(pages, keep, [StructField("parts", ArrayType(PART))], prepare)


def resolve(sequences: DataFrame, media: DataFrame, prefix: str = "sha256:") -> DataFrame:
    """One row per part with its medium's columns, joined by digest (null where unknown).

    ``media`` has ``digest`` and any columns; of equal digests one row counts.
    Media are reduced to one row per digest before the join, and a digest that
    very many references name is split by the join's skew handling.
    """
    once = media.where(F.col("digest").isNotNull()).groupBy("digest").agg(*[F.first(c).alias(c) for c in media.columns if c != "digest"])
    taken = {c.lower() for c in media.columns} | {f.name for f in PART.fields}
    keep = [c for c in sequences.columns if c != "parts" and c.lower() not in taken]
    parts = sequences.select(*keep, F.inline("parts"))
    digest = F.when(F.col("ref").startswith(prefix), F.expr(f"substring(ref, {len(prefix) + 1})"))
    return parts.withColumn("digest", digest).join(once, "digest", "left")


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """Bytes 0 appended up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def store(payload: bytes) -> bytes:
    """The payload as a binary grey image, one sample per byte."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def read_stored(medium: bytes) -> bytes:
    """The samples of a stored image, checked against its header."""
    magic, size, depth, samples = medium.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a stored payload")
    return samples


def feature(samples: bytes) -> str:
    """Rows, sum and a 16-bin histogram of the samples, as text of whole numbers."""
    a = np.frombuffer(samples, np.uint8)
    bins = np.bincount(a >> 4, minlength=16)
    return f"rows={len(a) // WIDTH};sum={int(a.sum(dtype=np.int64))};hist={','.join(map(str, bins.tolist()))}"


def store_media(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all), ``n_bytes`` and ``medium``, each text's bytes as a stored payload."""
    column = docs.columns.index(text)

    def prepare():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            data = [(x.as_py() or "").encode() for x in batch.column(column)]
            return [pa.array(map(len, data), pa.int64()), pa.array((store(padded(d)) for d in data), pa.binary())]

        return work

    fields = [StructField("n_bytes", LongType()), StructField("medium", BinaryType())]
    return arrow_columns(docs, docs.columns if keep is None else keep, fields, prepare)


def describe_media(media: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and, of the payload read back from ``medium``, sizes, digests and features."""
    column = media.columns.index("medium")
    fields = [StructField(n, t()) for n, t in (
        ("payload_bytes", LongType), ("payload_sha256", StringType), ("tail_crc32", LongType), ("media_bytes", LongType),
        ("media_sha256", StringType), ("feature", StringType))]

    def prepare():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = []
            for x in batch.column(column):
                medium = x.as_py()
                samples = read_stored(medium)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(medium),
                             hashlib.sha256(medium).hexdigest(), feature(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

        return work

    return arrow_columns(media, keep, fields, prepare)


def page_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """A small page for each document that refers to its text's stored payload by digest."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    label = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    html = F.concat(
        F.lit("<article><p>Document "), label, F.lit('</p><figure><img src="sha256:'), digest,
        F.lit('"><figcaption>Text of document '), label, F.lit("</figcaption></figure></article>"))
    return replacing(docs, html=html, digest=digest)

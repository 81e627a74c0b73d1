r"""WARC archives in seekable Zstandard bundles.

Pages become WARC/1.1 records: a response with its payload, or a revisit of the
record that holds an equal payload. A task gathers its records into frames of
about ``frame_bytes``; each frame is compressed on its own. Frames of about
``bundle_bytes`` make one file, closed by a skippable frame with the seek table:
compressed size, size and checksum of every frame. Any Zstandard reader reads
the whole file as one WARC; one that knows the table reads a single frame.

The index maps a record's id to bundle, frame and offset in the frame. It is
made by the writing tasks, kept as a table, and is also the commit: a file is
named anew by each attempt of a task, and only those that the index names
belong to the archive, so a repeated task does no harm. ``read_records`` reads
all frames by the seek tables, ``fetch`` only those that hold wanted records.

Files lie in the shared folder and are opened by the tasks through pyarrow's
file systems (local or mounted paths, file, hdfs, s3, gs; s3a is read as s3).
What a task holds at once is a frame and a batch of rows.

Which record is which: of pages with equal payloads of at least ``least_bytes``
the one with the largest id is the response and the others revisit it. Hot
payloads are salted, and only digests and ids meet in the shuffle that decides.

Defined results: a null payload is empty; pages that share payload and largest id are
responses all; a null id is less than any other; a payload without any id has
responses only; repeated rows are repeated records with one id; a null address
has no header and an address' control characters and spaces are percent-encoded;
an empty table gives an empty archive. Columns other than id, address and
payload are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from foretrace.llm.common import slices
from foretrace.session import bounded, fresh_path, pin, ship_by_value

ship_by_value(__name__)

# Fixed values of the seekable format: magic numbers of its skippable frame and of its footer, flag of checksums.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80

LEAST_BYTES = 1000
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
# Bytes of records that one reading task is meant for.
READ_BYTES = 32 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 16

INDEX = StructType([StructField("record_id", StringType()), StructField("path", StringType()), StructField("frame", LongType()),
                    StructField("offset", LongType()), StructField("length", LongType())])
FRAMES = StructType([StructField("path", StringType()), StructField("frame", LongType()), StructField("start", LongType()),
                     StructField("packed", LongType()), StructField("size", LongType()), StructField("checksum", LongType())])


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of a folder or file; a path without a scheme is a mounted one."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "file:///", path)))


# Records


def record_id(key: Column, digest: Column) -> Column:
    """A record's id, from page id and payload digest."""
    text = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(text, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def address(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record: version, header fields, block."""
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def page_record(row: dict) -> bytes:
    """The record of one page; a revisit's block ends with the HTTP head."""
    payload = row["payload"] or b""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = row["refers_to"] is not None
    return record([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if row["url"] is None else address(row["url"])), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", row["refers_to"]),
        ("X-Page-ID", row["key"]), ("Content-Type", "application/http; msgtype=response"),
    ], http if revisit else http + payload)


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields (names in lower case) and block of the record at a place, and the place after it."""
    head_end = data.index(b"\r\n\r\n", at)
    lines = data[at:head_end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    fields = {name.lower(): value for name, value in (line.split(": ", 1) for line in lines[1:])}
    block_end = head_end + 4 + int(fields["content-length"])
    if data[block_end:block_end + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} doesn't end at its length")
    return fields, data[head_end + 4:block_end], block_end + 4


def payload_of(fields: dict[str, str], block: bytes) -> bytes | None:
    """The payload a response holds, checked against its digest; None for other records."""
    if fields["warc-type"] != "response":
        return None
    payload = block[block.index(b"\r\n\r\n") + 4:]
    if fields["warc-payload-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't have its digest")
    return payload


# Bundles


class Bundle:
    """A file of independent frames that is being written."""

    def __init__(self, folder: str, level: int):
        store, place = store_of(folder)
        name = f"{uuid.uuid4().hex}.warc.zst"
        store.create_dir(place, recursive=True)
        self.path, self.out = f"{folder}/{name}", store.open_output_stream(f"{place}/{name}", compression=None)
        self.packer, self.table, self.size = zstandard.ZstdCompressor(level=level), [], 0

    def write(self, data: bytes) -> int:
        """Append a frame; its number."""
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.size += len(packed)
        return len(self.table) - 1

    def close(self) -> None:
        """Write the seek table and its footer."""
        entries = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries)) + entries)
        self.out.close()


def seek_table(path: str) -> list[tuple[int, int, int, int]]:
    """(start, packed size, size, checksum) of each frame, from the end of the file."""
    store, place = store_of(path)
    with store.open_input_file(place) as file:
        end = file.size()
        number, flags, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        entries, start, out = file.read_at(12 * number, end - 9 - 12 * number), 0, []
    for packed, size, checksum in struct.iter_unpack("<III", entries):
        out.append((start, packed, size, checksum))
        start += packed
    return out


def frames_of(paths: list[str], starts: list[int], packed: list[int], sizes: list[int], checksums: list[int]) -> Iterator[bytes]:
    """The given frames, one after the other, each checked; a file stays open while its frames follow each other."""
    opened, file = None, None
    unpacker = zstandard.ZstdDecompressor()
    for path, start, length, size, checksum in zip(paths, starts, packed, sizes, checksums):
        if path != opened:
            if file is not None:
                file.close()
            store, place = store_of(path)
            opened, file = path, store.open_input_file(place)
        data = unpacker.decompress(file.read_at(length, start), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame at {start} of {path} is damaged")
        yield data
    if file is not None:
        file.close()


# Writing


def planned(pages: DataFrame, key: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """key, url, payload, record_id and, for revisits, refers_to (the id of the response's record)."""
    rows = pages.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= least_bytes
    # Digests and ids alone are grouped; a payload that occurs once needs no lookup.
    groups = rows.where(long).groupBy("digest").agg(F.max("key").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL")
    lookup = bounded(groups.select("digest", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    rows = rows.withColumn("salt", F.pmod(F.hash("key", "url"), F.lit(SALTS))).join(lookup, ["digest", "salt"], "left")
    revisits = F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last"))
    return rows.select(
        F.col("key").cast("string").alias("key"), "url", "payload",
        record_id(F.col("key"), F.col("digest")).alias("record_id"), F.when(revisits, record_id(F.col("last"), F.col("digest"))).alias("refers_to"))


def write_archive(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None, least_bytes: int = LEAST_BYTES,
    frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL,
) -> DataFrame:
    """Write a record per page into bundles under ``folder`` (default: a new one in the shared folder); the index, a table."""
    folder = (folder or fresh_path(pages.sparkSession, "warc")).rstrip("/")
    rows = planned(pages, key, url, payload, least_bytes)

    def run(batches):
        bundle, frame, places, size = None, [], [], 0

        def flushed():
            number = bundle.write(b"".join(frame))
            at = [x for x in places if x[0]]
            return pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in at], pa.string()), pa.array([bundle.path] * len(at), pa.string()), pa.array([number] * len(at), pa.int64()),
                pa.array([x[1] for x in at], pa.int64()), pa.array([x[2] for x in at], pa.int64())], names=INDEX.names)

        for whole in batches:
            for batch in slices(whole):
                for row in batch.to_pylist():
                    if bundle is None:
                        bundle = Bundle(folder, level)
                        about = b"software: foretrace\r\nformat: WARC File Format 1.1\r\n"
                        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], about)
                        frame, places, size = [info], [], len(info)
                    data = page_record(row)
                    frame.append(data)
                    places.append((row["record_id"], size, len(data)))
                    size += len(data)
                    if size >= frame_bytes:
                        yield flushed()
                        frame, places, size = [], [], 0
                        if bundle.size >= bundle_bytes:
                            bundle.close()
                            bundle = None
        if bundle is not None:
            if frame:
                yield flushed()
            bundle.close()

    return pin(rows.mapInArrow(run, INDEX))


# Reading


def read_tasks(index: DataFrame) -> int:
    """Tasks that the frames of an index are read in: the archive's bytes over ``READ_BYTES``."""
    size = index.agg(F.sum("length")).first()[0] or 0
    return max(1, -(-size // READ_BYTES))


def frames(index: DataFrame) -> DataFrame:
    """All frames of the bundles an index names, read from their seek tables."""

    def run(batches):
        for batch in batches:
            rows = [(path, i, *x) for path in batch.column(0).to_pylist() for i, x in enumerate(seek_table(path))]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(columns)], names=FRAMES.names)

    return index.select("path").distinct().mapInArrow(run, FRAMES)


def spread(frames: DataFrame, tasks: int) -> DataFrame:
    """Frames dealt evenly over tasks, whatever the size of their rows."""
    return frames.repartition(tasks, "path", "frame").sortWithinPartitions("path", "start")


RECORDS = "record_id string, record_type string, key string, url string, payload_bytes bigint, payload_digest string, refers_to string"


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archive, warcinfo apart; with ``payloads`` also what responses hold.

    A revisit's payload_bytes is null here: it holds no payload.
    """
    schema = RECORDS + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def rows(data: bytes):
        at = 0
        while at < len(data):
            fields, block, at = parse(data, at)
            if fields["warc-type"] == "warcinfo":
                continue
            payload = payload_of(fields, block)
            digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
            row = (fields["warc-record-id"], fields["warc-type"], fields.get("x-page-id"), fields.get("warc-target-uri"),
                   None if payload is None else len(payload), digest, fields.get("warc-refers-to"))
            yield (*row, payload) if payloads else row

    def run(batches):
        for batch in batches:
            for data in frames_of(*(c.to_pylist() for i, c in enumerate(batch.columns) if i != 1)):
                found = list(rows(data))
                columns = list(zip(*found)) if found else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return spread(frames(index), read_tasks(index)).mapInArrow(run, schema)


def fetch(index: DataFrame, wanted: DataFrame, payloads: bool = True) -> DataFrame:
    """(record_id, payload_bytes, payload_digest[, payload]) of the wanted responses, one row an id.

    The index gives bundle, frame and offset; the seek table the frame's place.
    Frames without a wanted record are never read.
    """
    schema = "record_id string, payload_bytes bigint, payload_digest string" + (", payload binary" if payloads else "")
    ids = wanted.select("record_id").where("record_id IS NOT NULL").distinct()
    places = index.join(ids, "record_id", "left_semi").groupBy("record_id").agg(F.min_by(F.struct("path", "frame", "offset"), F.struct("path", "frame", "offset")).alias("at"))
    places = places.select("record_id", "at.*").groupBy("path", "frame").agg(F.collect_list("offset").alias("offsets"))
    chosen = frames(index).join(places, ["path", "frame"])

    def run(batches):
        for batch in batches:
            offsets = batch.column(6).to_pylist()
            for data, at in zip(frames_of(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))), offsets):
                found = []
                for place in at:
                    fields, block, _ = parse(data, place)
                    payload = payload_of(fields, block)
                    if payload is not None:
                        found.append((fields["warc-record-id"], payload))
                made = [pa.array([x[0] for x in found], pa.string()), pa.array([len(x[1]) for x in found], pa.int64()),
                        pa.array([hashlib.sha1(x[1]).hexdigest() for x in found], pa.string())]
                made += [pa.array([x[1] for x in found], pa.binary())] if payloads else []
                yield pa.RecordBatch.from_arrays(made, names=[x.split()[0] for x in schema.split(", ")])

    rows = chosen.select("path", "frame", "start", "packed", "size", "checksum", "offsets")
    return spread(rows, read_tasks(index)).mapInArrow(run, schema)


def resolved(index: DataFrame) -> DataFrame:
    """All records, revisits with size, digest and page of the response they refer to.

    Referred responses are fetched once each, through the index; what many
    revisits refer to is copied over ``SALTS`` parts before it meets them.
    """
    records = pin(read_records(index))
    revisits = records.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("record_id"))
    targets = fetch(index, revisits, payloads=False).withColumnRenamed("record_id", "refers_to")
    pages = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("key").alias("response")).distinct()
    targets = bounded(targets.join(pages, "refers_to").select(
        "refers_to", "response", F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    own = records.where("refers_to IS NULL").withColumn("response", F.lit(None).cast("string"))
    revisits = records.where("refers_to IS NOT NULL").withColumn("salt", F.pmod(F.hash("record_id"), F.lit(SALTS)))
    found = revisits.join(targets, ["refers_to", "salt"], "left").select(
        "record_id", "record_type", "key", "url", F.col("_bytes").alias("payload_bytes"),
        F.coalesce("_digest", "payload_digest").alias("payload_digest"), "refers_to", "response")
    return own.unionByName(found)

"""WARC archives compressed record by record with a Zstandard dictionary of their own.

An archive gathers records until their payloads fill it. Then a dictionary is built from
whole records spread evenly over the archive, and written in a skippable frame at its
start; each record, the first one being the archive's warcinfo, is a frame of its own, so
that any record can be read by its offset and length with the dictionary alone.

Of equal payloads one record has the payload and the others, as revisits, only refer to
it. Which, is found from digests by one grouping before anything is written. The record id
of a page is made of its id and the digest of its payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import give_back, slices, stage, table
from gritsieve.sources.staging import shared_folder

# Fixed values of the formats: magic numbers, versions and names.
SKIPPABLE, SKIP_HEAD = 0x184D2A5D, "<II"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONFORMS = "http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/"
END = b"\r\n\r\n"

ARCHIVE_BYTES = 64 << 20  # payloads of an archive, the last one included whole
DICTIONARY_BYTES = 64 << 10
SAMPLE_TIMES = 100  # a dictionary is built from so many times its size at most
LEAST_SAMPLES = 16
LEVEL = 3
HEAD_BYTES = 400  # about what a record without its payload takes
READ_BYTES = 1 << 20
OUT_BYTES = 8 << 20

MANIFEST = pa.schema([
    ("archive", pa.string()), ("records", pa.int64()), ("revisits", pa.int64()), ("payload_bytes", pa.int64()),
    ("dictionary_bytes", pa.int64()), ("bytes", pa.int64()), ("places", pa.list_(pa.int64())),
])
MANIFEST_TYPE = (
    "archive string, records long, revisits long, payload_bytes long, dictionary_bytes long, bytes long, places array<long>"
)
RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
RECORD_TYPE = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
    "payload binary, archive string, offset long, length long"
)


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:page:{'null' if page is None else page}:{digest}>"


def page_of(record: str) -> int | None:
    page = record.split(":")[2]
    return None if page == "null" else int(page)


def labelled(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def head_of(fields: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *(f"{name}: {value}" for name, value in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """The bytes of a response, or of a revisit where the payload lies in another record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    # no character of a URL may end the line
    target = re.sub(r"[\0-\x20\x7f]", lambda x: f"%{ord(x[0]):02X}", url) if url else "urn:page:unknown"
    fields = {
        "WARC-Type": "revisit" if refers_to else "response", "WARC-Record-ID": record_id(page, digest),
        "WARC-Date": date, "WARC-Target-URI": target, "WARC-Payload-Digest": labelled(digest),
        "WARC-Block-Digest": labelled(hashlib.sha1(block).hexdigest()),
        "Content-Type": "application/http;msgtype=response",
    }
    if refers_to:
        fields |= {"WARC-Refers-To": refers_to, "WARC-Profile": REVISIT_PROFILE}
    return head_of(fields, block) + block + END


def information(date: str) -> bytes:
    block = f"software: gritsieve\r\nformat: WARC File Format 1.1\r\nconformsTo: {CONFORMS}\r\n".encode()
    fields = {
        "WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date,
        "Content-Type": "application/warc-fields",
    }
    return head_of(fields, block) + block + END


def dictionary(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """Built from whole records at even distances; none if there are too few."""
    step = -(-sum(map(len, records)) // (SAMPLE_TIMES * size)) or 1
    some = records[::step]
    if len(some) < LEAST_SAMPLES:
        return None
    try:
        return zstandard.train_dictionary(size, some)
    except zstandard.ZstdError:  # the records have too little in common
        return None


class Archive:
    """Records that wait for the dictionary they are compressed with."""

    def __init__(self):
        self.records: list[bytes] = []
        self.revisits = self.payloads = 0

    def add(self, data: bytes, payload: int, revisit: bool) -> None:
        self.records.append(data)
        self.revisits += revisit
        self.payloads += payload

    def write(self, folder: str, date: str, size: int) -> pa.RecordBatch:
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/part-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.warc.zst"
        learned = dictionary(self.records, size)
        held = b"" if learned is None else learned.as_bytes()
        if learned is not None:
            learned.precompute_compress(level=LEVEL)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned, write_content_size=True, write_checksum=True)
        places = []
        with store.open_output_stream(name, compression=None) as out:  # frames are made here
            offset = 0
            if held:
                offset = out.write(struct.pack(SKIP_HEAD, SKIPPABLE, len(held)) + held)
            for data in [information(date), *self.records]:
                frame = pack.compress(data)
                places += [offset, len(frame)]
                out.write(frame)
                offset += len(frame)
        return table({
            "archive": [name], "records": [len(self.records)], "revisits": [self.revisits],
            "payload_bytes": [self.payloads], "dictionary_bytes": [len(held)], "bytes": [offset], "places": [places[2:]],
        }, MANIFEST)


def _write(folder: str, date: str, archive_bytes: int, dictionary_bytes: int) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        archive = Archive()
        for batch in slices(batches, "payload"):
            for row in batch.to_pylist():
                payload, digest = row["payload"], row["digest"]
                first = record_id(row["first"], digest) if row["revisit"] else None
                data = record(row["id"], row["url"], payload, digest, first, date)
                archive.add(data, 0 if first else len(payload), row["revisit"])
                if archive.payloads + HEAD_BYTES * len(archive.records) >= archive_bytes:
                    yield archive.write(folder, date, dictionary_bytes)
                    archive = Archive()
        if archive.records:
            yield archive.write(folder, date, dictionary_bytes)
        give_back()

    return make


def write_archives(
    df: DataFrame, folder: str | None = None, id: str = "page_id", url: str = "url", payload: str = "html",
    revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> DataFrame:
    """Write a record for each row and return the manifest: folder, archive, its records,
    revisits, payload_bytes, dictionary_bytes, bytes, and places (offset and length of each).

    Payloads are text in UTF-8 or binary; null is empty. Of equal payloads of revisit_bytes
    or more, the row with the largest id is a response and the others are revisits of it;
    a null id is smaller than all, and rows that repeat the largest id are responses with
    the same record id. All smaller payloads are responses. Null urls are written as
    urn:page:unknown, control characters and spaces in urls as %XX. An empty table gives no
    archive; other columns are ignored. The folder (by default a new one in the shared
    folder of the cluster) has to be one that pyarrow can write to. Attempts of a task write
    files of their own, and the manifest names those of the attempts that counted.
    """
    folder = folder or f"{shared_folder(df.sparkSession).rstrip('/')}/archives-{uuid.uuid4().hex}"
    base = df.select(
        F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "content": F.unhex(F.sha2("payload", 256))})
    large = F.octet_length("payload") >= revisit_bytes
    # only payloads that repeat; written first, so that the planner knows their size
    repeated = stage(
        base.where(large).groupBy("content").agg(F.max("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("content", "first")
    )
    # the planner splits the side of the pages where one payload has very many of them
    decided = base.join(repeated, "content", "left").withColumn(
        "revisit", large & F.coalesce(~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    )
    written = decided.select("id", "url", "payload", "digest", "first", "revisit").mapInArrow(
        _write(folder, date, archive_bytes, dictionary_bytes), MANIFEST_TYPE
    )
    return stage(written).withColumn("folder", F.lit(folder))


def frames(data) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each frame; data is a file at the archive's start."""
    head, learned = data.read(8), None
    rest = head
    offset = 0
    if len(head) == 8 and struct.unpack(SKIP_HEAD, head)[0] == SKIPPABLE:
        size = struct.unpack(SKIP_HEAD, head)[1]
        held = data.read(size)
        if len(held) < size:
            raise ValueError("the dictionary of an archive is cut off")
        learned, rest, offset = zstandard.ZstdCompressionDict(held), b"", 8 + size
    unpack = zstandard.ZstdDecompressor(dict_data=learned)
    while rest or (rest := data.read(READ_BYTES)):
        one, parts, length = unpack.decompressobj(), [], 0
        while not one.eof:
            rest = rest or data.read(READ_BYTES)
            if not rest:
                raise ValueError("a record is cut off")
            parts.append(one.decompress(rest))
            length += len(rest) - len(one.unused_data)
            rest = one.unused_data
        yield offset, length, b"".join(parts)
        offset += length


def parsed(data: bytes) -> dict | None:
    """The columns of a response or revisit, checked against its digests; none for others."""
    head, _, rest = data.partition(END)
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != VERSION or rest[len(block) :] != END:
        raise ValueError("a record is damaged")
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    if labelled(hashlib.sha1(block).hexdigest()) != fields["WARC-Block-Digest"]:
        raise ValueError("the block of a record does not have its digest")
    http, _, payload = block.partition(END)
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload does not have its digest")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind,
        "refers_to": page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload_digest": digest, "payload_bytes": size, "payload": payload if kind == "response" else None,
    }


def _read(with_payload: bool) -> Callable:
    schema = RECORD if with_payload else RECORD.remove(RECORD.get_field_index("payload"))

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(row["folder"])
                out, size = [], 0
                with store.open_input_stream(row["archive"], compression=None, buffer_size=READ_BYTES) as data:
                    for offset, length, found in frames(data):
                        if (fields := parsed(found)) is None:
                            continue
                        out.append(fields | {"archive": row["archive"], "offset": offset, "length": length})
                        size += HEAD_BYTES + (len(fields["payload"] or b"") if with_payload else 0)
                        if size > OUT_BYTES:
                            yield table({x: [y[x] for y in out] for x in schema.names}, schema)
                            out, size = [], 0
                if out:
                    yield table({x: [y[x] for y in out] for x in schema.names}, schema)

    return make


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest (SHA-1), payload_bytes, payload
    (null for revisits), archive, offset and length of every response and revisit. Lengths
    and digests are checked; damage raises ValueError."""
    dealt = manifest.select("folder", "archive").repartition(max(1, manifest.count()))
    kind = RECORD_TYPE if with_payload else RECORD_TYPE.replace("payload binary, ", "")
    return dealt.mapInArrow(_read(with_payload), kind)


def read_at(folder: str, archive: str, offset: int, length: int) -> dict | None:
    """One record by its place, with the dictionary at the archive's start."""
    store, _ = fs.FileSystem.from_uri(folder)
    with store.open_input_file(archive) as data:
        magic, size = struct.unpack(SKIP_HEAD, data.read(8))
        learned = zstandard.ZstdCompressionDict(data.read(size)) if magic == SKIPPABLE else None
        data.seek(offset)
        return parsed(zstandard.ZstdDecompressor(dict_data=learned).decompress(data.read(length)))


def read_digests(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record."""
    return read_archives(manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )

"""Token ids as length-delimited binary records, with an offset index for each file.

A record is: payload length (8 bytes), masked checksum of those 8 bytes (4), payload,
masked checksum of the payload (4); all little-endian. The checksum is CRC-32, turned
right by 15 bits plus 0xA282EAD8, so that the checksum of data that holds checksums is
still of use. The payload is the document's id (8), its flags (1: bit 0 says that the id
is null, bit 1 that ids are wide) and its token ids of 2 or 4 bytes. The index of a file
has the offset (8) and length (8) of each record.

Files lie in order of document id: file n has smaller ids than file n + 1. Each attempt
of a task writes files of its own name and the manifest names those of the attempts that
counted, so repeated and speculative tasks do no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritsieve.llm.common import slices, stage, table
from gritsieve.llm.tokens import encoder
from gritsieve.sources.staging import shared_folder

HEAD, FOOT, OWNER, ENTRY = "<QI", "<I", "<qB", "<QQ"
HEAD_BYTES, FOOT_BYTES, OWNER_BYTES = map(struct.calcsize, (HEAD, FOOT, OWNER))
NULL_ID, WIDE = 1, 2
READ_BYTES = 8 << 20
MANIFEST = "file long, path string, records long, tokens long, bytes long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack(FOOT, masked(length)), payload, struct.pack(FOOT, masked(payload))))


def payload_of(id: int | None, ids: np.ndarray) -> bytes:
    flags = NULL_ID * (id is None) | WIDE * (ids.dtype.itemsize == 4)
    return struct.pack(OWNER, id or 0, flags) + ids.tobytes()


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    id, flags = struct.unpack_from(OWNER, payload)
    return None if flags & NULL_ID else id, np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=OWNER_BYTES)


def unframed(head: bytes, read: Callable[[int], bytes]) -> bytes:
    """The payload behind a head; read(n) gives the next n bytes."""
    if len(head) < HEAD_BYTES:
        raise ValueError("a record is cut off")
    length, sum_of_length = struct.unpack(HEAD, head)
    if masked(head[:8]) != sum_of_length:
        raise ValueError("the length of a record is damaged")
    body = read(length + FOOT_BYTES)
    if len(body) < length + FOOT_BYTES:
        raise ValueError("a record is cut off")
    payload = body[:length]
    if masked(payload) != struct.unpack(FOOT, body[length:])[0]:
        raise ValueError("a record is damaged")
    return payload


def _write(folder: str, path: str, end: int | None, schema: pa.Schema) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/part-{part:07d}-{uuid.uuid4().hex}"
        encode = encoder(path, end).encode
        records = tokens = offset = 0
        data = index = None
        for batch in slices(batches, "text"):
            if data is None:
                store.create_dir(root)
                data, index = store.open_output_stream(f"{name}.rec"), store.open_output_stream(f"{name}.idx")
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for id_, ids in zip(batch.column("id").to_pylist(), encode(texts)):
                framed = frame(payload_of(id_, ids))
                data.write(framed)
                index.write(struct.pack(ENTRY, offset, len(framed)))
                offset += len(framed)
                tokens += len(ids)
                records += 1
        if data is not None:
            data.close()
            index.close()
            yield table({"file": [part], "path": [name], "records": [records], "tokens": [tokens], "bytes": [offset]}, schema)

    return make


def write_records(
    df: DataFrame, tokenizer: str, end: int | None, folder: str | None = None,
    text: str = "text", id: str = "doc_id",
) -> DataFrame:
    """Write the ids of every whole text, in ascending order of id (null first), and
    return the manifest: file, path, records, tokens, bytes.

    Null and empty texts have the end alone; repeated ids are records of their own. An
    empty table gives no file. Other columns are ignored. The folder (by default a new
    one in the shared folder of the cluster) has to be one that pyarrow can write to.
    """
    folder = folder or f"{shared_folder(df.sparkSession).rstrip('/')}/records-{uuid.uuid4().hex}"
    base = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    schema = pa.schema([
        ("file", pa.int64()), ("path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()),
    ])
    ordered = base.repartitionByRange("id").sortWithinPartitions("id")
    written = stage(ordered.mapInArrow(_write(folder, tokenizer, end, schema), MANIFEST))
    return written.withColumn("folder", F.lit(folder))


def _read_whole(schema: pa.Schema) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(row["folder"])
                with store.open_input_stream(f"{row['path']}.rec", buffer_size=READ_BYTES) as data:
                    start, out, size = row["start"], [], 0
                    while head := data.read(HEAD_BYTES):
                        id_, ids = parsed(unframed(head, data.read))
                        out.append((id_, start, ids.astype(np.int32)))
                        start += len(ids)
                        size += len(ids)
                        if size > 1_000_000:
                            yield table(dict(zip(("id", "start", "ids"), zip(*out))), schema)
                            out, size = [], 0
                    if out:
                        yield table(dict(zip(("id", "start", "ids"), zip(*out))), schema)

    return make


def _digests(schema: pa.Schema) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _read_whole(pa.schema(SEQUENCE))(batches):
            ids = [x.values.to_numpy().astype("<u4") for x in batch.column("ids")]
            yield table({
                "id": batch.column("id"), "start": batch.column("start"), "n_tokens": [len(x) for x in ids],
                "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids],
            }, schema)

    return make


SEQUENCE = [("id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))]


def _starts(manifest: DataFrame) -> DataFrame:
    """Each file with the number of ids before it; files are dealt to tasks singly."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = max(1, manifest.count())
    placed = manifest.select(
        "file", "path", "folder", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start")
    )
    return placed.repartition(files, "file")


def read_records(manifest: DataFrame, id: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before it) and ids of every record."""
    found = _starts(manifest).mapInArrow(_read_whole(pa.schema(SEQUENCE)), "id long, start long, ids array<int>")
    return found.withColumnRenamed("id", id)


def read_digests(manifest: DataFrame, id: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and ids_crc32 (ids as unsigned 32-bit) of every record."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    found = _starts(manifest).mapInArrow(_digests(schema), "id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumnRenamed("id", id)


def _entries(schema: pa.Schema) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(row["folder"])
                with store.open_input_stream(f"{row['path']}.idx") as data:
                    entries = np.frombuffer(data.read(), "<u8").reshape(-1, 2).astype(np.int64)
                count = len(entries)
                yield table({
                    "folder": [row["folder"]] * count, "path": [row["path"]] * count,
                    "offset": entries[:, 0], "length": entries[:, 1],
                }, schema)

    return make


def _read_at(schema: pa.Schema) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["path"] not in opened:
                    if len(opened) > 64:
                        for data in opened.values():
                            data.close()
                        opened.clear()
                    store, _ = fs.FileSystem.from_uri(row["folder"])
                    opened[row["path"]] = store.open_input_file(f"{row['path']}.rec")
                data = opened[row["path"]]
                data.seek(row["offset"])
                id_, ids = parsed(unframed(data.read(HEAD_BYTES), data.read))
                out.append((id_, row["path"], row["offset"], ids.astype(np.int32)))
            if out:
                yield table(dict(zip(("id", "path", "offset", "ids"), zip(*out))), schema)

    return make


def read_shuffled(manifest: DataFrame, seed: int, id: str = "doc_id") -> DataFrame:
    """All records in an order that the seed decides, read through the offset index.

    Only index entries are shuffled; each record is then read at its place.
    """
    spark: SparkSession = manifest.sparkSession
    schema = pa.schema([("folder", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    entries = manifest.mapInArrow(_entries(schema), "folder string, path string, offset long, length long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.xxhash64("path", "offset", F.lit(seed))
    dealt = entries.withColumn("turn", order).repartition(parts, "turn").sortWithinPartitions("turn")
    schema = pa.schema([("id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])
    found = dealt.mapInArrow(_read_at(schema), "id long, path string, offset long, ids array<int>")
    return found.select(F.col("id").alias(id), "ids")

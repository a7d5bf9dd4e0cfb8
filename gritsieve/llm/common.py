"""Helpers of the text operators: word hashes, shingles, batches, linked groups."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritsieve.sources import staging

SLICE_BYTES = 4 << 20
SLICE_ROWS = 100_000  # of numbers, that go back to Spark at a time
SPACE = np.isin(np.arange(256), list(b"\x20\x09\x0a\x0b\x0c\x0d"))  # by byte
_U = np.uint64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """The same table, read from a copy in the shared folder. Files of the shuffles that the
    copy took go as soon as it is written; else Spark deletes them once the driver's JVM
    has found their plans unreachable, which may be long after."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return staging.stage(df)
    finally:
        conf.set(CLEANUP, before)


def split_of(id_column: str | Column) -> Column:
    """crc32 of the id as text, modulo five; null ids count as empty text."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Parts of the batches that hold a few MB of the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0)
        part = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
        starts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
        for start, end in zip(starts[:-1], starts[1:]):
            yield batch.slice(start, end - start)
    give_back()


def give_back() -> None:
    """Return free memory to the system: worker processes go on to other operators."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
        trim(0)


def by_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of SLICE_ROWS rows: Spark holds a part as a whole, outside its heap."""
    for start in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(start, SLICE_ROWS)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [text or b"" for text in batch.column(column).cast(pa.binary()).to_pylist()]


HELD: dict[tuple, Any] = {}


def held(key: tuple, make: Callable) -> Any:
    """What make() gave in this process, kept from task to task: one thing at a time, so
    that worker processes do not keep the memos of operators that ran before."""
    if key not in HELD:
        HELD.clear()
        give_back()
        HELD[key] = make()
    return HELD[key]


def hashed_words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text starts in them.

    bytes.lower() changes A-Z only; words are split at 0x20 and 0x09-0x0D.
    """
    if HELD:
        HELD.clear()
        give_back()
    joined = b" ".join(texts)
    data = np.frombuffer(b" " * 8 + (joined.lower() if lower else joined) + b" " * 8, np.uint8)
    edges = np.flatnonzero(np.diff(SPACE[data]))
    begins, ends = edges[::2] + 1, edges[1::2] + 1
    starts = np.searchsorted(begins, 8 + np.r_[0, np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)])
    return _word_hashes(data, begins, ends - begins), starts


def _word_hashes(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """xxh3_64 of each word: of up to 16 bytes all at once, by its definition, others one by one."""
    hashes = np.empty(len(begins), np.uint64)
    some = np.flatnonzero(sizes <= 3)
    at, size = begins[some], sizes[some]
    ends = [data[x].astype(np.uint64) for x in (at, at + (size >> 1), at + size - 1)]
    bits = ends[0] << _U(16) | ends[1] << _U(24) | ends[2] | size.astype(np.uint64) << _U(8)
    hashes[some] = _scattered(bits ^ _U(0x87275A9B), 33, 0xC2B2AE3D27D4EB4F, 29, 0x165667B19E3779F9, 32)
    some = np.flatnonzero((sizes > 3) & (sizes <= 8))
    at, size = begins[some], sizes[some]
    bits = (_read(data, at, 4) << _U(32)) + _read(data, at + size - 4, 4) ^ _U(0xC73AB174C5ECD5A2)
    bits ^= (bits << _U(49) | bits >> _U(15)) ^ (bits << _U(24) | bits >> _U(40))
    bits *= _U(0x9FB21C651E98DF25)
    bits ^= (bits >> _U(35)) + size.astype(np.uint64)
    bits *= _U(0x9FB21C651E98DF25)
    hashes[some] = bits ^ bits >> _U(28)
    some = np.flatnonzero((sizes > 8) & (sizes <= 16))
    at, size = begins[some], sizes[some]
    low = _read(data, at, 8) ^ _U(0x6782737BEA4239B9)
    high = _read(data, at + size - 8, 8) ^ _U(0xAF56BC3B0996523A)
    bits = size.astype(np.uint64) + low.byteswap() + high + _folded(low, high)
    hashes[some] = _scattered(bits, 37, 0x165667919E3779F9, 32)
    for i in np.flatnonzero(sizes > 16).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[begins[i] : begins[i] + sizes[i]])
    return hashes

def _read(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The numbers of so many bytes, little-endian, at each place."""
    view = np.ndarray(len(data) - size + 1, f"<u{size}", data, strides=(1,))
    return view[at].astype(np.uint64)


def _scattered(bits: np.ndarray, *steps: int) -> np.ndarray:
    """Shifts to the right and factors in turn."""
    for i, step in enumerate(steps):
        bits = bits * _U(step) if i % 2 else bits ^ bits >> _U(step)
    return bits


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper half of the product of 128 bits XOR its lower half."""
    half, lower = _U(32), _U(0xFFFFFFFF)
    cross = (a & lower) * (b & lower) >> half
    middle = (a >> half) * (b & lower) + cross
    other = (a & lower) * (b >> half) + (middle & lower)
    return (a >> half) * (b >> half) + (middle >> half) + (other >> half) ^ a * b


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scatter 64-bit values (the finaliser of splitmix64)."""
    x = values + np.uint64((int(seed) + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for every run of ``width`` words, over the ends of texts as well."""
    count = max(0, len(words) - width + 1)
    total = np.zeros(count, np.uint64)
    for i in range(width):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += words[i : i + count]
    return mix(total, width)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; short texts are one shingle."""
    words, starts = hashed_words(texts)
    every = rolled(words, width)
    found = []
    for start, end in zip(starts[:-1], starts[1:]):
        if end - start >= width:
            found.append(np.unique(every[start : end - width + 1]))
        elif end > start:
            found.append(rolled(words[start:end], int(end - start)))
        else:
            found.append(np.empty(0, np.uint64))
    return found


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed number, which Spark can hold."""
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(columns[field.name], field.type) for field in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def local_hubs(keys: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key and order, and for each the index of its key's first row."""
    rows = np.lexsort((*reversed(order), keys))
    ordered = keys[rows]
    opens = np.r_[True, ordered[1:] != ordered[:-1]] if len(rows) else np.empty(0, bool)
    firsts = np.flatnonzero(opens)
    return rows, rows[firsts[np.cumsum(opens) - 1]] if len(rows) else rows


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest id it reaches.

    Alternates large and small stars until the edges no longer change. Each round is a
    table in the shared folder. Minima are aggregated before the shuffle; the join back
    to a hub with many neighbours is one that the adaptive planner splits.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    pairs, seen = stage(pairs.distinct()), None
    while True:
        state = pairs.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
        ).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        # each smaller neighbour and the node itself hang on the smallest neighbour
        pairs = stage(
            small.selectExpr("explode(array(struct(v AS u, m AS v), struct(u AS u, m AS v))) AS e")
            .select("e.u", "e.v").where("u <> v").distinct()
        )
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)

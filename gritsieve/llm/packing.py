"""Pack documents into training sequences: best fit decreasing, distributed by partition.

Overlong documents are first cut into full windows. The rest of each document goes, the
longest first, into the tightest open window that holds it, which a segment tree over
remaining capacities finds. Then the emptiest windows are taken apart to fill up the
others, and what is left in the end becomes windows whose lengths are powers of two, so
nothing is padded. Each task packs its own documents, a bounded pool at a time; there is
no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import slices, table
from gritsieve.llm.tokens import encoder

POOL_IDS = 8_000_000  # ids that a task packs together: 16 MB, or 32 MB of wide ones
ROWS_IDS = 500_000  # ids of the pieces that a task returns at once
SEQUENCES_BITS = 33  # sequences of one partition


class Capacities:
    """Open windows by remaining capacity; finds the least capacity that is enough."""

    def __init__(self, largest: int):
        self.leaves = 1 << largest.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.counts[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._change(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) with the smallest capacity from ``least`` on."""
        node = least + self.leaves
        if not self.counts[node]:
            # up to the first ancestor with something to the right, then down to its left end
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """The items of each window; lengths are from 1 to window."""
    open_windows, packed = Capacities(window), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_windows.take(lengths[item])
        if found is None:
            found = window, len(packed)
            packed.append([])
        capacity, at = found
        packed[at].append(item)
        if capacity > lengths[item]:
            open_windows.put(capacity - lengths[item], at)
    return packed


def fill_up(packed: list[list[int]], lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length) without any space left, but for the last ones,
    whose lengths are powers of two."""
    total = sum(lengths)
    used = [sum(lengths[i] for i in items) for items in packed]
    order = sorted(range(len(packed)), key=lambda k: (-used[k], k))
    stay, apart = order[: total // window], order[total // window :]
    full = [[(i, 0, lengths[i]) for i in packed[k]] for k in stay]
    space = [window - used[k] for k in stay]
    rest = total % window
    for power in range(rest.bit_length() - 1, -1, -1):
        if rest >> power & 1:
            full.append([])
            space.append(1 << power)
    at = 0
    for k in apart:
        for item in packed[k]:
            start = 0
            while start < lengths[item]:
                while not space[at]:
                    at += 1
                size = min(space[at], lengths[item] - start)
                full[at].append((item, start, size))
                space[at] -= size
                start += size
    return full


def _pack(path: str, end: int, window: int, with_ids: bool, schema: pa.Schema) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << SEQUENCES_BITS
        encode = encoder(path, end).encode
        pool: list[tuple] = []  # (id, ids of the document before, its ids in all, ids)
        held = 0

        def rows(pieces: Iterable[tuple]) -> pa.RecordBatch:
            pieces = list(pieces)
            columns = dict(zip(
                ("id", "start", "length", "doc_tokens", "sequence_id", "offset"),
                zip(*(x[:6] for x in pieces)),
            ))
            wide = [x[6].astype("<u4") for x in pieces]
            columns["ids_crc32"] = [zlib.crc32(x.tobytes()) for x in wide]
            if with_ids:
                columns["ids"] = [x.astype(np.int32) for x in wide]
            return table(columns, schema)

        def packed() -> Iterator[list[tuple]]:
            nonlocal sequence, held
            lengths = [len(x[3]) for x in pool]
            out, size_of_out = [], 0
            for pieces in fill_up(best_fit_decreasing(lengths, window), lengths, window):
                offset = 0
                for item, start, size in pieces:
                    id_, before, tokens, ids = pool[item]
                    out.append((id_, before + start, size, tokens, sequence, offset, ids[start : start + size]))
                    offset += size
                sequence += 1
                size_of_out += offset
                if size_of_out > ROWS_IDS:
                    yield out
                    out, size_of_out = [], 0
            if out:
                yield out
            pool.clear()
            held = 0

        for batch in slices(batches, "text"):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            done = []
            for id_, ids in zip(batch.column("id").to_pylist(), encode(texts)):
                whole = len(ids) // window * window
                for start in range(0, whole, window):
                    done.append((id_, start, window, len(ids), sequence, 0, ids[start : start + window]))
                    sequence += 1
                if whole < len(ids):
                    pool.append((id_, whole, len(ids), ids[whole:].copy()))
                    held += len(ids) - whole
            if done:
                yield rows(done)
            if held > POOL_IDS:
                yield from map(rows, packed())
        if pool:
            yield from map(rows, packed())

    return make


def pack(
    df: DataFrame, tokenizer: str, end: int, window: int = 2048, text: str = "text",
    id: str = "doc_id", with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: id, start (its document's ids before it), length,
    ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset
    (gapless from 0 in its sequence), and ids if asked for.

    A document's ids are those of its whole text, then ``end``; null and empty texts are
    the end alone. Null and repeated ids are documents of their own, row by row. Other
    columns are ignored; an empty table gives no rows. Every id lies in one piece.
    """
    fields = [
        ("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ]
    spark_schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        spark_schema += ", ids array<int>"
    base = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    found = base.mapInArrow(_pack(tokenizer, end, window, with_ids, pa.schema(fields)), spark_schema)
    return found.withColumnRenamed("id", id)

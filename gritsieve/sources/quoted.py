"""Records of delimited text whose quoted cells hold line breaks, a file read by many tasks.

Whether a byte range of a file begins inside a quoted cell depends on all text before it.
Three steps find out without reading a file in one task:

1. Each task reads the lines of its ranges and says how a range ends if it begins outside
   a quoted cell, and how if it begins inside one.
2. These answers, one small record per range, are put together in order of the ranges: a
   range keeps, flips or fixes the state, so the state at its beginning is that of the last
   range that fixes it and the parity of the flips since.
3. Each task cuts its ranges into records. What a range has of a record that begins or ends
   elsewhere is a fragment; the fragments of a record, two per range at most, are joined.

A cell is quoted if its first character is a quote; a quote inside it is written twice. What
follows the closing quote up to the separator belongs to the cell. Records are then parsed by
Spark. Ranges are Spark's own splits, so their size follows spark.sql.files.maxPartitionBytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from gritsieve.functions.text import ident, literal

QUOTE = b'"'
_INSIDE = re.compile(rb'[^"]*+(?:""[^"]*+)*+')

# Kinds of pieces: a whole record; the end of a record that began in an earlier range; a
# range that lies inside a record; the beginning of a record that goes on; the same of a header.
WHOLE, LAST, MIDDLE, FIRST, FIRST_OF_HEADER = range(5)

_ENDS = pa.schema([
    ("file", pa.int64()), ("start", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_()),
])
_PIECES = pa.schema([
    ("file", pa.int64()), ("start", pa.int64()), ("kind", pa.int32()), ("record", pa.binary()),
])


def lines(spark: SparkSession, paths: str | Sequence[str], line_end: str = "\n") -> DataFrame:
    """(line, file, start): each line with its file, as a hash, and the start of its range."""
    return spark.read.option("lineSep", line_end).text(paths).selectExpr(
        "CAST(value AS BINARY) AS line", "xxhash64(_metadata.file_path) AS file",
        "_metadata.file_block_start AS start",
    )


def ends_inside(line: bytes, inside: bool, opening: bytes) -> bool:
    """Whether a quoted cell is open at the end of a line that begins inside one or not.

    ``opening`` is the separator with a quote behind it.
    """
    if inside:
        at = 0
    elif line.startswith(QUOTE):
        at = 1
    elif (at := line.find(opening)) >= 0:
        at += len(opening)
    else:
        return False
    while True:
        at = _INSIDE.match(line, at).end()
        if at == len(line):
            return True
        if (at := line.find(opening, at)) < 0:
            return False
        at += len(opening)


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """Runs of lines of the same range."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = (batch.column(name).to_numpy() for name in ("file", "start"))
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield (int(file[a]), int(start[a])), batch.column("line").slice(a, b - a)


def _with_quotes(part: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.find_substring(part, QUOTE).to_numpy(zero_copy_only=False) >= 0)


def _ends(opening: bytes) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, states = None, (False, True)

        def ended() -> Iterator[pa.RecordBatch]:
            if current is not None:
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(_ENDS.names, (*current, *states)))], schema=_ENDS
                )

        for key, part in _ranges(batches):
            if key != current:
                yield from ended()
                current, states = key, (False, True)
            for i in _with_quotes(part):
                line, (out, in_) = part[int(i)].as_py(), states
                one = ends_inside(line, out, opening)
                states = one, one if out == in_ else ends_inside(line, in_, opening)
        yield from ended()

    return make


def range_states(found: DataFrame, separator: str) -> DataFrame:
    """(file, start, begins_inside) for each range of ``lines``."""
    ends = found.mapInArrow(
        _ends(separator.encode() + QUOTE), "file long, start long, outside boolean, inside boolean"
    )
    so_far = "PARTITION BY file ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return (
        ends.selectExpr("*", "CAST(outside AND NOT inside AS INT) AS flips", "outside = inside AS fixes")
        .selectExpr("*", f"sum(flips) OVER ({so_far} CURRENT ROW) AS n_flips")
        .selectExpr(
            "file", "start", "n_flips - flips AS n_before",
            "last(CASE WHEN fixes THEN struct(outside AS state, n_flips AS n) END, true) "
            f"OVER ({so_far} 1 PRECEDING) AS fixed",
        )
        .selectExpr(
            "file", "start",
            "coalesce(fixed.state, false) <> ((n_before - coalesce(fixed.n, 0)) % 2 = 1) AS begins_inside",
        )
    )


class _Cutter:
    """Cuts the lines of one range after the other into pieces."""

    def __init__(
        self, states: tuple[np.ndarray, np.ndarray, np.ndarray], opening: bytes, line_end: bytes
    ):
        self.files, self.starts, self.states = states
        self.opening, self.line_end = opening, line_end
        self.key: tuple[int, int] | None = None
        self.waiting: list[bytes] = []  # lines of a record that may go on

    def open(self, key: tuple[int, int]) -> None:
        at = np.flatnonzero((self.files == key[0]) & (self.starts == key[1]))
        if len(at) != 1:
            raise RuntimeError("the file was cut into other ranges than before; load it again")
        self.key = key
        self.inside = self.continued = bool(self.states[at[0]])
        self.header = key[1] == 0  # the first record of a file that is not blank

    def row(self, kind: int, record: bytes) -> pa.RecordBatch:
        values = (*self.key, kind, record)
        return pa.RecordBatch.from_pylist([dict(zip(_PIECES.names, values))], schema=_PIECES)

    def close(self) -> Iterator[pa.RecordBatch]:
        """Hand on the lines that wait, as far as the record goes in this range."""
        if not self.waiting:
            return
        record, self.waiting = self.line_end.join(self.waiting), []
        if self.continued:
            yield self.row(MIDDLE if self.inside else LAST, record)
        elif self.inside:
            yield self.row(FIRST_OF_HEADER if self.header else FIRST, record)
        elif record.strip():
            if not self.header:
                yield self.row(WHOLE, record)
            self.header = False
        self.continued = False

    def add(self, part: pa.Array) -> Iterator[pa.RecordBatch]:
        count, state, at = len(part), self.inside, 0
        after = np.empty(count, bool)
        for i in map(int, _with_quotes(part)):
            after[at:i] = state
            state = after[i] = ends_inside(part[i].as_py(), state, self.opening)
            at = i + 1
        after[at:] = state
        begins = np.flatnonzero(~np.r_[self.inside, after[:-1]])
        head = int(begins[0]) if len(begins) else count
        self.waiting += part.slice(0, head).to_pylist()
        if not len(begins):
            self.inside = state
            return
        self.inside = False
        yield from self.close()
        end = int(begins[-1]) if state else count  # the last record may go on
        whole = begins[:-1] if state else begins
        if len(whole):
            yield from self.whole(part.slice(head, end - head), whole - head)
        self.waiting, self.inside = part.slice(end).to_pylist(), state

    def whole(self, part: pa.Array, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        records = part
        if len(begins) < len(part):
            offsets = pa.array(np.r_[begins, len(part)], pa.int32())
            separator = pa.scalar(self.line_end, pa.binary())
            records = pc.binary_join(pa.ListArray.from_arrays(offsets, part), separator)
        records = records.filter(pc.match_substring_regex(records, r"[^\x00-\x20]"))
        if self.header and len(records):
            self.header, records = False, records.slice(1)
        count = len(records)
        if count:
            file, start = (pa.array(np.full(count, x, np.int64)) for x in self.key)
            yield pa.RecordBatch.from_arrays(
                [file, start, pa.array(np.zeros(count, np.int32)), records], schema=_PIECES
            )


def _pieces(shared, opening: bytes, line_end: bytes) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(shared.value, opening, line_end)
        for key, part in _ranges(batches):
            if key != cutter.key:
                yield from cutter.close()
                cutter.open(key)
            yield from cutter.add(part)
        yield from cutter.close()

    return make


def records(
    spark: SparkSession, paths: str | Sequence[str], separator: str, line_end: str = "\n"
) -> DataFrame:
    """One row (record, the file's bytes) per record that is not blank, but each file's header.

    The states of the ranges are found at once; they are a record per range of a file, 17
    bytes for each 128 MB, and every task gets them.
    """
    found = lines(spark, paths, line_end)
    states = range_states(found, separator).toArrow()
    columns = tuple(
        states.column(name).to_numpy(zero_copy_only=False) for name in ("file", "start", "begins_inside")
    )
    pieces = found.mapInArrow(
        _pieces(
            spark.sparkContext.broadcast(columns), separator.encode() + QUOTE, line_end.encode()
        ),
        "file long, start long, kind int, record binary",
    )
    whole = pieces.where(f"kind = {WHOLE}").select("record")
    firsts = f"kind IN ({FIRST}, {FIRST_OF_HEADER})"
    joined = (
        pieces.where(f"kind <> {WHOLE}")
        .selectExpr(
            "*", f"count_if({firsts}) OVER (PARTITION BY file ORDER BY start, kind) AS number"
        )
        .groupBy("file", "number")
        .agg(
            F.expr(f"count_if(kind = {FIRST_OF_HEADER}) > 0 AS header"),
            F.expr("sort_array(collect_list(struct(start, kind, CAST(record AS STRING) AS text))) AS parts"),
        )
        .where("NOT header")
        .selectExpr(
            f"CAST(array_join(transform(parts, part -> part.text), {literal(line_end)}) AS BINARY) AS record"
        )
    )
    ended = (
        "CASE WHEN substring(record, -1, 1) = X'0D' THEN substring(record, 1, octet_length(record) - 1) "
        "ELSE record END"
    )
    return whole.unionByName(joined).selectExpr(f"{ended} AS record")


def parsed(found: DataFrame, names: Sequence[str], separator: str, latin: bool) -> DataFrame:
    """The cells of ``records`` as text columns; what a record lacks is null."""
    schema = ", ".join(f"{ident(name)} STRING" for name in names)
    record = F.expr("decode(record, 'ISO-8859-1')" if latin else "CAST(record AS STRING)")
    options = {"sep": separator, "quote": '"', "escape": '"', "multiLine": "true"}
    return found.select(F.from_csv(record, schema, options).alias("cells")).select("cells.*")


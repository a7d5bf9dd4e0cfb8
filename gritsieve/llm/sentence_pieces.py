"""SentencePiece ids as the shortest path of a weighted finite-state transducer.

The transducer is the composition of three parts. The normaliser writes a mark for each
space and one before the text. The lexicon has an arc for each piece, with its negative
score as weight, and for a character that is no piece the arcs of its bytes. For models
with merges the third part is an acceptor over neighbouring pieces: b may follow a only
if merging the characters of a and b in order of score gives a and b again. A sequence
in which every pair passes is the sequence that merging gives, so exactly one path
remains, and weights in the tropical semiring (least sum) also choose for models without
merges, where every pair passes.

Pieces never cross the place where a mark follows another character, so the composition
is made with each part between such places, and the result kept for its next occurrence.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import held, slices, table

MARK = "▁"  # fixed values: the mark of a space, model kinds and field numbers of the format
UNIGRAM, BPE = 1, 2
TRAINER, NORMALIZER = 2, 3
MODEL_TYPE, CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE = 3, 2, 3, 4, 5
CACHED_PARTS, CACHED_PAIRS = 400_000, 600_000  # the memo of parts has two halves


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message in the wire format of the model file."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if size is None else size
        yield number, data[at : at + size]
        at += size


class Memo(dict):
    """Results of a function; starts afresh when it holds as many as it may."""

    def __init__(self, function: Callable, most: float = math.inf):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            message = list(fields(file.read()))
        trainer = dict(fields(next(v for n, v in message if n == TRAINER)))
        normalizer = dict(fields(next(v for n, v in message if n == NORMALIZER)))
        self.kind = trainer.get(MODEL_TYPE, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or normalizer.get(CHARSMAP):
            raise ValueError("only models of pieces or merges that keep characters as they are")
        if not normalizer.get(ESCAPE, 1) or normalizer.get(EXTRA_SPACES, 1):
            raise ValueError("only models that keep all spaces, as marks")
        self.prefix = MARK if normalizer.get(DUMMY_PREFIX, 1) else ""
        self.bytes: list[int | None] = [None] * 256
        self.pieces: dict[str, int] = {}
        self.written: list[bytes] = []
        self.weight: list[float] = []
        for id in range(model.get_piece_size()):
            piece = model.id_to_piece(id)
            if model.is_byte(id):
                self.bytes[int(piece[1:-1], 16)] = id
                self.written.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(id) or model.is_unknown(id):
                self.written.append(b"")
            else:
                self.pieces[piece] = id
                self.written.append(piece.replace(MARK, " ").encode())
            self.weight.append(-model.get_score(id))
        self.unknown = model.unk_id()
        self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known = Memo(self._known_part)
        self.older: dict[str, bytes] = {}  # what was known before known became full
        self.pairs = Memo(self.follows, CACHED_PAIRS)
        if any(re.search(f"[^{MARK}]{MARK}", x) for x in self.pieces):
            raise ValueError("a piece has a mark after another character")

    def normalised(self, text: str) -> str:
        return (self.prefix + text).replace(" ", MARK) if text else ""

    @cached_property
    def lexicon(self) -> ahocorasick.Automaton:
        """An arc for each piece."""
        machine = ahocorasick.Automaton()
        for piece in self.pieces:
            machine.add_word(piece, piece)
        machine.make_automaton()
        return machine

    def _apart(self, before: str, after: str) -> bool:
        """Whether merging the characters of both, in order of score and the leftmost
        first, never merges across the place between them."""
        parts, middle, pieces = [*before, *after], len(before), self.pieces
        ranks = [pieces.get(a + b) for a, b in zip(parts, parts[1:])]
        weight = self.weight
        while True:
            best, at = None, -1
            for i, id in enumerate(ranks):
                if id is not None and (best is None or weight[id] < best):
                    best, at = weight[id], i
            if best is None:
                return True
            if at == middle - 1:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            middle -= at < middle - 1
            if at:
                ranks[at - 1] = pieces.get(parts[at - 1] + parts[at])
            if at < len(ranks):
                ranks[at] = pieces.get(parts[at] + parts[at + 1])

    def follows(self, pair: tuple[str, str]) -> bool:
        """Whether the acceptor has the arc from one piece to the other."""
        return self.kind == UNIGRAM or self._apart(*pair)

    def shortest(self, part: str) -> list[int]:
        """Ids of the least path through the composition with one part.

        The automaton of the lexicon gives the arcs in order of their ends, so whatever
        leads to the start of an arc is known when the arc comes. A state is a place in
        the part, with the least sum of weights and the piece that ends there: with
        merges one piece alone can, and others are not tried once it is found; without,
        what follows does not depend on the piece.
        """
        arcs, pieces, weights = self.lexicon.iter(part), self.pieces, self.weight
        if not pieces.keys() >= set(part):  # some are spelled as bytes, for want of a piece
            spelled = [(i, x) for i, x in enumerate(part) if x not in pieces]
            arcs = sorted([*arcs, *spelled], key=lambda arc: arc[0])
        last: list[str | None] = [None] * (len(part) + 1)
        last[0] = ""
        if self.kind == BPE:
            pairs = self.pairs
            for end, piece in arcs:
                end += 1
                if last[end] is None:
                    before = last[end - len(piece)]
                    if before is not None and (not before or pairs[before, piece]):
                        last[end] = piece
        else:
            sums = [0.0] * (len(part) + 1)
            for end, piece in arcs:
                end += 1
                id = pieces.get(piece)
                sum_ = sums[end - len(piece)] + (1e6 if id is None else weights[id])
                if last[end] is None or sum_ < sums[end]:
                    sums[end], last[end] = sum_, piece
        ids: list[int] = []
        at = len(part)
        while at:
            piece = last[at]
            at -= len(piece)
            id = pieces.get(piece)
            if id is not None:
                ids.append(id)
            else:
                spelled = [self.bytes[b] for b in piece.encode()]
                ids += [self.unknown] if None in spelled else reversed(spelled)
        ids.reverse()
        return ids

    def encode(self, text: str) -> np.ndarray:
        if len(self.known) > CACHED_PARTS:
            self.older, self.known = self.known, Memo(self._known_part)
        parts = self.parts.findall(self.normalised(text))
        return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u4")

    def _known_part(self, part: str) -> bytes:
        return self.older.get(part) or array("I", self.shortest(part)).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; the mark that the normaliser put first goes."""
        text = b"".join(map(self.written.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def transducer(path: str) -> Transducer:
    """This process's transducer for a model file."""
    return held(("pieces", path), lambda: Transducer(path))


ENCODED = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGESTED = pa.schema([
    ("id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()),
    ("decoded_sha256", pa.string()), ("round_trip", pa.bool_()),
])


def _encoded(path: str) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in slices(batches, "text"):
            ids = [machine.encode(x or "").astype(np.int32) for x in batch.column("text").to_pylist()]
            yield table({"id": batch.column("id"), "ids": ids}, ENCODED)

    return make


def _digested(path: str) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in slices(batches, "text"):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids = [machine.encode(x) for x in texts]
            decoded = [machine.decode(x) for x in ids]
            yield table({
                "id": batch.column("id"), "n_pieces": [len(x) for x in ids],
                "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
                "round_trip": [a == b for a, b in zip(texts, decoded)],
            }, DIGESTED)

    return make


def _base(df: DataFrame, text: str, id: str) -> DataFrame:
    return df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def encode(df: DataFrame, model: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id and ids of every whole text; null and empty texts have none. Null and repeated
    ids are rows of their own; other columns are ignored; an empty table gives no rows."""
    found = _base(df, text, id).mapInArrow(_encoded(model), "id long, ids array<int>")
    return found.withColumnRenamed("id", id)


def decode(df: DataFrame, model: str, ids: str = "ids", id: str = "doc_id") -> DataFrame:
    """id and text of every row of ids; null ids give null. Bytes that aren't UTF-8 are
    replaced; a mark in the text that was encoded comes back as a space."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            texts = [None if x is None else machine.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield table({"id": batch.column("id"), "text": texts}, schema)

    base = df.select(F.col(id).cast("long").alias("id"), F.col(ids).cast("array<int>").alias("ids"))
    return base.mapInArrow(make, "id long, text string").withColumnRenamed("id", id)


def digests(df: DataFrame, model: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_pieces, ids_crc32 (ids as little-endian unsigned 32-bit), and of the decoded
    text its SHA-256 and whether it is the text. Rows as in encode."""
    found = _base(df, text, id).mapInArrow(
        _digested(model), "id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    )
    return found.withColumnRenamed("id", id)

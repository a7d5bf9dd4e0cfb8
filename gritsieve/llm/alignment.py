"""Tokens of two vocabularies over the same bytes, aligned by merging their ends.

The ends of all A tokens and of all B tokens of a batch of texts are two ascending lists.
Merge-path partitioning cuts their merge into pieces of equal work: for each piece a binary
search along a diagonal finds how many ends of either list come before it. A piece then
merges its own parts alone and emits, for each of its steps, the overlap of an A token
with a B token; an overlap of no length says that two tokens end together. These places,
of all pieces in a row, are stitched into groups: what lies between two of them.

Counts of linked ids are summed over the corpus. The most frequent pairs, a bounded number,
are broadcast; the links of all others are joined.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import give_back, held, slices, stage, table

MARK = "▁"  # fixed value: the mark of a space in pieces
PIECE_STEPS = 1 << 16
TABLE_PAIRS = 1 << 20  # 17 MB of keys, counts and flags
HELD_PAIRS = 1 << 21  # distinct pairs that a task gathers before it hands them on
FAST_CHARACTERS = 100_000  # longer texts go to the library that makes no recursive search
FAST_LAST = "\u024f"


def bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, all other bytes for the characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """Ids by a byte-level vocabulary of the tokenizers library; names of special tokens in a
    text are text.

    Texts of the first Unicode blocks (to U+024F) go through tiktoken with the same
    vocabulary, which gives the same ids several times as fast; a test holds both against
    each other on each of these characters. All other texts, and very long ones, go through
    the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte = bytes_of_characters()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {x["content"] for x in model["added_tokens"]}
        self.written = [b""] * self.tokenizer.get_vocab_size()
        for token, id in model["model"]["vocab"].items():
            self.written[id] = b"" if token in special else bytes(byte[x] for x in token)
        ranks = {x: id for id, x in enumerate(self.written) if x}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= FAST_CHARACTERS and (text.isascii() or max(text) <= FAST_LAST):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Ids by a model of the sentencepiece library, and the bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.written = [
            bytes([int(x[3:-1], 16)]) if self.model.is_byte(i) else x.replace(MARK, " ").encode()
            for i, x in enumerate(pieces)
        ]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class Pair:
    """Both vocabularies with the byte lengths of their tokens."""

    def __init__(self, a: str, b: str):
        self.sides = ByteTokens(a), PieceTokens(b)
        self.lengths = tuple(np.array([len(x) for x in side.written], np.int64) for side in self.sides)
        ids = range(max(map(len, self.lengths)))
        # the ends of what a group writes: within a side, after its A side, after its B side
        self.decimals = [f"{id}{mark}".encode() for mark in ",|;" for id in ids]
        self.ids = len(ids)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none where either side does not write space and text."""
        none = np.empty(0, np.int32)
        if not text:
            return none, none
        a, b = self.sides
        whole = " " + text
        ids, plain = a.encode(whole), whole.encode()
        if b"".join(map(a.written.__getitem__, ids)) != plain:
            return none, none
        pieces = b.encode(text)
        if b"".join(map(b.written.__getitem__, pieces)) != plain:
            return none, none
        return np.array(ids, np.int32), np.array(pieces, np.int32)


def merge_path(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of a and of b come before each piece of ``steps`` steps, and in all.

    On the diagonal i + j = k the search finds the least i for which b's end number k - i - 1
    is below a's end number i; equal ends of a come before those of b.
    """
    total = len(a) + len(b)
    diagonal = np.r_[np.arange(0, total, steps), total]
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at_a, at_b = np.minimum(middle, len(a) - 1), np.clip(diagonal - middle - 1, 0, len(b) - 1)
        before = a[at_a] <= b[at_b]
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return low, diagonal - low


def piece_overlaps(
    a: np.ndarray, b: np.ndarray, from_a: int, to_a: int, from_b: int, to_b: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of a, token of b, length in common) for each step of one piece. A step is an
    end; the bytes since the step before belong to the tokens that are open there."""
    part_a, part_b = a[from_a:to_a], b[from_b:to_b]
    count = len(part_a) + len(part_b)
    at_a = np.arange(len(part_a)) + np.searchsorted(part_b, part_a, "left")
    at_b = np.arange(len(part_b)) + np.searchsorted(part_a, part_b, "right")
    ends = np.empty(count, np.int64)
    ends[at_a], ends[at_b] = part_a, part_b
    is_a = np.zeros(count, bool)
    is_a[at_a] = True
    gone_a = np.cumsum(is_a) - is_a
    token_a, token_b = from_a + gone_a, from_b + np.arange(count) - gone_a
    last = max(a[from_a - 1] if from_a else 0, b[from_b - 1] if from_b else 0)
    return token_a, token_b, np.diff(ends, prepend=last)


def closings(a: np.ndarray, b: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of a and of b are over at each place where both end, in order.

    A step of no length is the end of a B token where an A token has just ended. The A token
    may be the last one of the piece before.
    """
    starts_a, starts_b = merge_path(a, b, steps)
    over_a, over_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for piece in zip(starts_a[:-1], starts_a[1:], starts_b[:-1], starts_b[1:]):
        token_a, token_b, length = piece_overlaps(a, b, *map(int, piece))
        both = np.flatnonzero(length == 0)
        over_a.append(token_a[both])
        over_b.append(token_b[both] + 1)
    return np.concatenate(over_a), np.concatenate(over_b)


class Aligned:
    """A batch of texts: ids of both sides in a row, and where their groups end.

    rows_a, rows_b and rows_groups say where the tokens and groups of each text begin.
    """

    def __init__(self, pair: Pair, texts: list[str | None], steps: int = PIECE_STEPS):
        encoded = [pair.encode(x) for x in texts]
        self.ids = tuple(np.concatenate([np.empty(0, np.int32), *(x[i] for x in encoded)]) for i in range(2))
        rows = [np.cumsum([0, *(len(x[i]) for x in encoded)]) for i in range(2)]
        ends = [np.cumsum(pair.lengths[i][self.ids[i]]) for i in range(2)]
        self.over_a, self.over_b = closings(*ends, steps)
        self.rows_a, self.rows_b = rows
        self.rows_groups = np.searchsorted(self.over_a, self.rows_a, "right")
        self.pair = pair

    def links(self) -> np.ndarray:
        """For each group its last A id and its last B id, the two that end together, in one."""
        a, b = self.ids[0][self.over_a - 1], self.ids[1][self.over_b - 1]
        return a.astype(np.int64) << 32 | b

    def written(self) -> list[bytes]:
        """The groups of each text as a1,a2|b1;a3|b2,b3 in decimal ids."""
        (a, b), n = self.ids, self.pair.ids
        earlier = np.r_[0, self.over_b][:-1]  # B tokens of the groups before
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(earlier, np.diff(self.over_a, prepend=0))] = a
        codes[np.arange(len(b)) + np.repeat(self.over_a, np.diff(self.over_b, prepend=0))] = b
        codes[self.over_a + earlier - 1] += n
        codes[self.over_a + self.over_b - 1] += 2 * n
        parts, starts = self.pair.decimals, self.rows_a + self.rows_b
        return [
            b"".join(map(parts.__getitem__, codes[x:y].tolist()))[:-1] for x, y in zip(starts[:-1], starts[1:])
        ]


def wide_ids(a: str, b: str) -> bool:
    """Whether two ids need more than 32 bits."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(a).get_vocab_size(), SentencePieceProcessor(model_file=b).get_piece_size()) > 1 << 16


def pair_of(a: str, b: str) -> Pair:
    """This process's vocabularies."""
    return held(("alignment", a, b), lambda: Pair(a, b))


GROUPS = pa.schema([
    ("id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())),
    ("a_ends", pa.list_(pa.int32())), ("b_ends", pa.list_(pa.int32())),
])


def _grouped(a: str, b: str) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = Aligned(pair_of(a, b), batch.column("text").to_pylist())
            lists = lambda starts, values: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))
            groups = np.diff(found.rows_groups)
            yield table({
                "id": batch.column("id"), "a_ids": lists(found.rows_a, found.ids[0]), "b_ids": lists(found.rows_b, found.ids[1]),
                "a_ends": lists(found.rows_groups, found.over_a - np.repeat(found.rows_a[:-1], groups)),
                "b_ends": lists(found.rows_groups, found.over_b - np.repeat(found.rows_b[:-1], groups)),
            }, GROUPS)

    return make


def align(df: DataFrame, a: str, b: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, a_ids, b_ids, a_ends and b_ends of every row: the tokens of space and text in both
    vocabularies, and how many of them are over at the end of each group.

    Texts that are null or empty, or that the tokens of a side do not write (characters that
    a vocabulary lacks, or a mark that stands for a space), have none. Repeated and null ids
    are rows of their own, other columns are ignored, an empty table gives no rows.
    """
    base = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    kind = "id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"
    return base.mapInArrow(_grouped(a, b), kind).withColumnRenamed("id", id)


DIGEST = pa.schema([
    ("row", pa.int64()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()),
])


def _digested(a: str, b: str, wide: bool) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a, b)
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            found = Aligned(pair, batch.column("text").to_pylist())
            count, groups = batch.num_rows, np.diff(found.rows_groups)
            links = found.links()
            if not wide:
                links = (links >> 16 | links & 0xFFFF).astype("<u4")
            cut = found.rows_groups
            yield table({
                "row": np.arange(row, row + count), "id": batch.column("id"), "n_a": np.diff(found.rows_a),
                "n_b": np.diff(found.rows_b), "n_groups": groups, "n_links": groups,
                "groups_sha256": [hashlib.sha256(x).hexdigest() if x else "" for x in found.written()],
                "links": [links[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])],
            }, DIGEST)
            row += count

    return make


COUNT = pa.schema([("link", pa.int64()), ("n", pa.int64())])


def _links_of(batch: pa.RecordBatch, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """The links of all rows in a row, A id in the upper half, and where each row's begin."""
    rows = batch.column("links").to_pylist()
    sizes = np.array([len(x) for x in rows], np.int64) // (8 if wide else 4)
    flat = np.frombuffer(b"".join(rows), "<i8" if wide else "<u4").astype(np.int64)
    return flat if wide else (flat >> 16) << 32 | flat & 0xFFFF, np.r_[0, np.cumsum(sizes)]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(place, np.concatenate(counts), len(every)).astype(np.int64)


def _counted(wide: bool) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held_pairs = [], [], 0
        for batch in slices(batches, "links"):
            found, times = np.unique(_links_of(batch, wide)[0], return_counts=True)
            keys.append(found)
            counts.append(times)
            held_pairs += len(found)
            if held_pairs > HELD_PAIRS:
                keys, counts = ([x] for x in _summed(keys, counts))
                held_pairs = len(keys[0])
                if held_pairs > HELD_PAIRS // 2:  # else little would be left for what is to come
                    yield table({"link": keys[0], "n": counts[0]}, COUNT)
                    keys, counts, held_pairs = [], [], 0
        if keys:
            found, times = _summed(keys, counts)
            yield table({"link": found, "n": times}, COUNT)

    return make


VALUE = pa.schema([("row", pa.int64()), ("best", pa.int64()), ("total", pa.int64())])
REST = pa.schema([("row", pa.int64()), ("link", pa.int64()), ("times", pa.int64())])


def _looked_up(found: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
    return place, keys[place] == found if len(keys) else np.zeros(len(found), bool)


def _valued(shared, wide: bool) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for batch in slices(batches, "links"):
            links, starts = _links_of(batch, wide)
            found, where = np.unique(links, return_inverse=True)
            place, known = _looked_up(found, keys)
            count = np.where(known, counts[place] if len(keys) else 0, 0)
            is_best = known & (best[place] if len(keys) else False)
            totals = [np.r_[0, np.cumsum(x.astype(np.int64)[where])] for x in (is_best, count)]
            yield table({
                "row": batch.column("row"),
                "best": totals[0][starts[1:]] - totals[0][starts[:-1]], "total": totals[1][starts[1:]] - totals[1][starts[:-1]],
            }, VALUE)

    return make


def _unknown(shared, wide: bool) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, _, _ = shared.value
        for batch in slices(batches, "links"):
            links, starts = _links_of(batch, wide)
            found, where = np.unique(links, return_inverse=True)
            rest = np.flatnonzero(~_looked_up(found, keys)[1][where])
            if len(rest):
                owner = np.searchsorted(starts, rest, "right") - 1
                rows = batch.column("row").to_numpy()[owner]
                order = np.lexsort((links[rest], rows))
                rows, link = rows[order], links[rest][order]
                first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (link[1:] != link[:-1])])
                yield table({"row": rows[first], "link": link[first], "times": np.diff(np.r_[first, len(rows)])}, REST)
        give_back()

    return make


def link_counts(links: DataFrame, wide: bool) -> DataFrame:
    """link, n (over the corpus) and best (n is the highest of the link's B id) of every pair."""
    parts = links.select("links").mapInArrow(_counted(wide), "link long, n long")
    counts = stage(parts.groupBy("link").agg(F.sum("n").alias("n")))
    piece = F.col("link").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("piece")
    highest = counts.groupBy(piece).agg(F.max("n").alias("most"))  # a row for each piece at most
    return stage(
        counts.withColumn("piece", piece).join(highest, "piece").select("link", "n", (F.col("n") == F.col("most")).alias("best"))
    )


def frequent(counts: DataFrame, most: int = TABLE_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, counts and flags of as many whole levels of counts (powers of two), from the
    highest down, as have no more than ``most`` pairs; sorted by pair."""
    level = F.floor(F.log2("n")).alias("level")
    least, total = 64, 0
    for row in sorted(counts.groupBy(level).count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    found = counts.where(F.floor(F.log2("n")) >= least).toArrow()
    link, n, best = (found.column(x).to_numpy() for x in ("link", "n", "best"))
    order = np.argsort(link)
    return link[order], n[order], best[order].astype(bool)


def digests(df: DataFrame, a: str, b: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    A link is an A and a B token that end together; its count is how many links of the
    corpus have these two ids, and it is best if no other A id has more with its B id. Rows
    without tokens (see align) have zeros and an empty digest.
    """
    base = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    kind = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
    wide = wide_ids(a, b)
    found = stage(base.mapInArrow(_digested(a, b, wide), kind))
    counts = link_counts(found, wide)
    shared = df.sparkSession.sparkContext.broadcast(frequent(counts))
    links = found.select("row", "links")
    values = links.mapInArrow(_valued(shared, wide), "row long, best long, total long")
    # pairs outside the table: none of them is frequent, so no join key is hot
    rest = links.mapInArrow(_unknown(shared, wide), "row long, link long, times long").join(counts, "link").select(
        "row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("best"), (F.col("times") * F.col("n")).alias("total")
    )
    sums = values.unionByName(rest).groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
    return found.drop("links").join(sums, "row").select(
        F.col("id").alias(id), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )

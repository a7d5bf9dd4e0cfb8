"""Hard negatives of anchors by Fagin's threshold algorithm over integer components.

Rows are packed into blocks. A block holds, for each dimension, its rows in order of their
component. For an anchor the lists are walked together, from the largest component where
the anchor's own is positive and from the smallest where it is negative; what shows up for
the first time is scored in full by its integer inner product. The frontier of all lists
gives the most that an unseen row can score (the threshold). A block is left once that is
strictly below the kth score of each of the anchor's windows, so that ties are complete.

Anchors are dealt in groups, every group to every block. First the positives of all
anchors are found; their scores open the windows in which the negatives are sought.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritsieve.llm.common import stage, table

SCALE = 256
LARGEST = 1 << 24  # of a component's integer
LONGEST = 1 << 14  # of a vector: scores stay below 2^62
BLOCK_ROWS, BLOCK_VALUES = 16_384, 1 << 20  # a block holds 4 MB of components and 2 MB of lists
GROUP_ROWS, GROUP_BITS = 512, 9
FIRST_STEP = 32  # depth of the first walk; each further one is twice as long
EXACT = 1 << 53

PACK = pa.schema([
    ("block", pa.int64()), ("size", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()),
    ("components", pa.binary()), ("lists", pa.binary()),
])
PACK_TYPE = "block long, size int, ids binary, labels binary, components binary, lists binary"


def _packed(most: int, with_lists: bool) -> Callable:
    def pack(block: int, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, labels, values = (np.concatenate(x) for x in zip(*rows))
        lists = np.argsort(values, 0, "stable").T.astype("<u2").tobytes() if with_lists else b""
        return table({
            "block": [block], "size": [values.shape[1]], "ids": [ids.tobytes()], "labels": [labels.tobytes()],
            "components": [values.tobytes()], "lists": [lists],
        }, PACK)

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        waiting: dict[int, list] = {}  # by length of the vectors
        for batch in batches:
            vectors = batch.column("vector")
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * SCALE).astype("<i4")
            ids, labels = (batch.column(x).to_numpy(zero_copy_only=False).astype("<i8") for x in ("id", "label"))
            for size in np.unique(sizes):
                size = int(size)
                at = np.flatnonzero(sizes == size)
                values = flat[np.repeat(sizes == size, sizes)].reshape(len(at), size)
                room = max(1, min(most, BLOCK_VALUES // max(1, size)))
                held = waiting.setdefault(size, [])
                while len(at):
                    take = room - sum(len(x[0]) for x in held)
                    held.append((ids[at[:take]], labels[at[:take]], values[:take]))
                    at, values = at[take:], values[take:]
                    if sum(len(x[0]) for x in held) == room:
                        yield pack(block, held)
                        held.clear()
                        block += 1
        for held in waiting.values():
            if held:
                yield pack(block, held)
                block += 1

    return make


class Block:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.labels = np.frombuffer(row["labels"], "<i8")
        count, size = len(self.ids), row["size"]
        self.values = np.frombuffer(row["components"], "<i4").reshape(count, size)
        self.lists = np.frombuffer(row["lists"], "<u2").reshape(size, count) if "lists" in row else None
        self.largest = int(np.abs(self.values).max(initial=0))

    def open(self) -> Block:
        """With components ready for access along the lists and for scoring."""
        self.ordered = np.take_along_axis(self.values.T, self.lists.astype(np.int64), 1)
        self.exact = self.values.astype(np.float64)
        return self

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Random access: integer inner products, in doubles as long as these are exact."""
        if self.largest * int(np.abs(anchor).max(initial=0)) * len(anchor) < EXACT:
            return (self.exact[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.values[rows].astype(np.int64) @ anchor.astype(np.int64)


def top_in_windows(
    block: Block, anchor: np.ndarray, fits: np.ndarray, windows: Sequence[tuple[int, int]], most: int
) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each window (least, greatest score) the first ``most`` fitting rows of the block
    as (scores, ids), higher scores and then smaller ids first; and the depth walked to."""
    count = len(block.ids)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(windows)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    anchor_64 = anchor.astype(np.int64)
    seen = np.zeros(count, bool)
    depth, step = 0, FIRST_STEP
    while depth < count:
        end = min(count, depth + step) if len(up) or len(down) else count
        fresh = np.zeros(count, bool) if len(up) or len(down) else np.ones(count, bool)
        fresh[block.lists[up, count - end : count - depth]] = True
        fresh[block.lists[down, depth:end]] = True
        fresh &= ~seen
        seen |= fresh
        rows = np.flatnonzero(fresh)
        scores = block.scores(rows, anchor)
        chosen = fits[rows]
        rows, scores = rows[chosen], scores[chosen]
        threshold = int(
            block.ordered[up, count - end] @ anchor_64[up] + block.ordered[down, end - 1] @ anchor_64[down]
        )
        over = True
        for i, (least, greatest) in enumerate(windows):
            inside = (scores >= least) & (scores <= greatest)
            if inside.any():
                every = np.r_[found[i][0], scores[inside]], np.r_[found[i][1], block.ids[rows[inside]]]
                if len(every[0]) > 4 * most:  # no sort of what is far below
                    near = every[0] >= np.partition(every[0], len(every[0]) - most)[-most]
                    every = every[0][near], every[1][near]
                first = np.lexsort((every[1], -every[0]))[:most]
                found[i] = every[0][first], every[1][first]
            over &= threshold < (found[i][0][-1] if len(found[i][0]) == most else least)
        depth, step = end, step * 2
        if over or seen.all():
            break
    return found, depth


NEIGHBOUR = pa.schema([("anchor", pa.int64()), ("own", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
HIT = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
LEAST = -(1 << 62)


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, Block, Block]]:
    """Each row with its block and its group; a block that comes again is kept."""
    block = last = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            if row["block"] != last:
                block, last = Block({x: row[x].as_py() for x in PACK.names}).open(), row["block"]
            group = Block({x: row[f"group_{x}"].as_py() for x in ("ids", "labels", "components")} | {"size": row["size"].as_py()})
            yield row, block, group


def _positives(most: int) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block, group in _opened(batches):
            out = []
            for i, (own, label) in enumerate(zip(group.ids, group.labels)):
                fits = (block.labels == label) & (block.ids != own)
                [(scores, ids)], _ = top_in_windows(block, group.values[i], fits, [(LEAST, -LEAST)], most)
                out += [((row["group"].as_py() << GROUP_BITS) + i, int(own), a, b) for a, b in zip(ids.tolist(), scores.tolist())]
            if out:
                yield table(dict(zip(NEIGHBOUR.names, zip(*out))), NEIGHBOUR)

    return make


def _negatives(most: int, low: int, high: int) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block, group in _opened(batches):
            asked: dict[int, list[int]] = {}
            for x in row["windows"].as_py():
                if low * x["score"] <= high * x["score"]:  # else no score lies between
                    asked.setdefault(x["place"], []).append(x["score"])
            out = []
            for i, positives in asked.items():
                windows = [(-(-low * p // 100), high * p // 100) for p in positives]
                fits = block.labels != group.labels[i]
                found, _ = top_in_windows(block, group.values[i], fits, windows, most)
                for p, (scores, ids) in zip(positives, found):
                    out += [((row["group"].as_py() << GROUP_BITS) + i, p, a, b) for a, b in zip(ids.tolist(), scores.tolist())]
            if out:
                yield table(dict(zip(HIT.names, zip(*out))), HIT)

    return make


def _dealt(groups: DataFrame, blocks: DataFrame, count: int) -> DataFrame:
    """Every group beside every block of its vectors' length. A block meets the groups under
    one of ``count`` numbers; a group is repeated for each of them, a block for none."""
    numbered = blocks.withColumn("number", F.pmod(F.xxhash64("block"), F.lit(count)))
    repeated = groups.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    return repeated.join(numbered, ["number", "size"]).drop("number")


def hard_negatives(
    df: DataFrame, anchors: Column | str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is the inner product of floor(256 * component) with the anchor's; higher
    scores come first, ties by smaller id. The positives of an anchor are its first rows of
    the same label and another id. For each, ranked from 1, come the first rows of another
    label with low * positive_score <= 100 * negative_score <= high * positive_score.

    Rows with a null id, label or vector, with a null or non-finite component, with one of
    65,536 or more in size, or of more than 16,384 components take no part; vectors only
    meet vectors of the same length. A repeated row counts each time, also as an anchor. An
    anchor without positives, or a positive without negatives, gives no rows, and neither
    does an empty table. Other columns are ignored.
    """
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / SCALE))
    rows, asked = (
        x.select(
            F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
            F.col(vector).cast("array<double>").alias("vector"),
        ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole & (F.size("vector") <= LONGEST))
        for x in (df, df.where(anchors))
    )
    blocks = stage(rows.mapInArrow(_packed(BLOCK_ROWS, True), PACK_TYPE))
    packed = stage(asked.mapInArrow(_packed(GROUP_ROWS, False), PACK_TYPE))
    groups = packed.select(
        F.col("block").alias("group"), "size", *(F.col(x).alias(f"group_{x}") for x in ("ids", "labels", "components"))
    )
    count = max(1, blocks.count())
    near = _dealt(groups, blocks, count).mapInArrow(_positives(positives), "anchor long, own long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    firsts = stage(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives))

    # windows with the same bounds are walked once; a group has a bounded number of them
    windows = firsts.select("anchor", "score").distinct().groupBy(F.shiftright("anchor", GROUP_BITS).alias("group")).agg(
        F.collect_list(F.struct((F.col("anchor") % (1 << GROUP_BITS)).alias("place"), "score")).alias("windows")
    )
    hits = _dealt(groups.join(windows, "group"), blocks, count).mapInArrow(
        _negatives(negatives, low, high), "anchor long, window long, id long, score long"
    )
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return firsts.withColumnRenamed("score", "window").join(
        ranked.select("anchor", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")),
        ["anchor", "window"],
    ).select(
        F.col("own").alias("anchor_id"), F.col("id").alias("positive_id"), "rank", "negative_id",
        F.col("window").alias("positive_score"), "negative_score",
    )

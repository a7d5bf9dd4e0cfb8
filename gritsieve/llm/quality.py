"""Quality rules: an isolation forest over rule statistics.

Statistics of whole texts feed a fixed base rule and a forest of random splits. All labelled
rows take part: each tree is grown, as the method has it, on TREE_ROWS drawn from all good
ones, and cuts within the box of all rows. Documents that random splits set apart early are
anomalous; the threshold is the one that tells all labelled bad rows from all good ones best
while it rejects at most a GOOD_LOST share of the good ones.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import hashed_words, rolled, slices, table
from gritsieve.sources.staging import stage

TREES, TREE_ROWS, DEPTH = 128, 256, 10
GOOD_LOST = 0.005
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_marks", "n_digits", "n_distinct")
SHARES = ("word_length", "symbols", "dup_lines", "repeat_words", "upper", "marks", "digits")


def statistics(texts: list[str]) -> np.ndarray:
    """COUNTS and MORE of each text, a row each."""
    words, starts = hashed_words([x.encode() for x in texts], lower=False)
    triples = rolled(words, 3)
    out = np.zeros((len(texts), len(COUNTS) + len(MORE)), np.int64)
    for i, text in enumerate(texts):
        start, end = starts[i], starts[i + 1]
        count = end - start
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        repeated = 0
        if count > 3:
            own = triples[start : end - 2]
            _, place, times = np.unique(own, return_inverse=True, return_counts=True)
            again = times[place] > 1
            covered = np.zeros(count, bool)
            for k in range(3):
                covered[k : k + len(own)] |= again
            repeated = covered.sum()
        raw = np.frombuffer(text.encode(), np.uint8)
        of = np.bincount(raw, minlength=128)
        out[i] = (
            count, len(text) - of[[9, 10, 11, 12, 13, 32]].sum(), of[[ord(c) for c in "#*$%&|<>"]].sum(),
            len(lines) - len(set(lines)), repeated, len(lines), of[65:91].sum(),
            of[[ord(c) for c in "!?;:"]].sum(), of[48:58].sum(), len(np.unique(words[start:end])),
        )
    return out


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def ratios(counts: np.ndarray) -> np.ndarray:
    """SHARES, which the forest splits on, from 0 to 1: a statistic as a part of its sum with what
    it is compared to. They are shares, so that long texts aren't odd as such."""
    words, chars, lines = counts[:, 0], counts[:, 1], counts[:, 5]
    pairs = (
        (chars, 5 * words), (counts[:, 2], words / 5), (counts[:, 3], lines), (counts[:, 4], words),
        (counts[:, 6], chars / 5), (counts[:, 7], words / 5), (counts[:, 8], chars / 5),
    )
    return np.column_stack([part / np.maximum(part + whole, 1e-9) for part, whole in pairs])


def _average_path(rows: np.ndarray | float) -> np.ndarray:
    """Mean depth at which a random tree sets apart one of so many rows."""
    n = np.asarray(rows, float)
    some = np.maximum(n, 2)
    return np.where(n > 1, 2 * (np.log(np.maximum(some - 1, 1)) + np.euler_gamma) - 2 * (some - 1) / some, 0.0)


@dataclasses.dataclass
class Forest:
    """Trees of 2^(DEPTH + 1) places each: child k is at 2k + 1 or 2k + 2."""

    feature: np.ndarray  # -1 where a path ends
    cut: np.ndarray
    length: np.ndarray
    threshold: float

    def anomaly(self, values: np.ndarray) -> np.ndarray:
        """From 0 to 1, higher for documents that are set apart early."""
        rows = np.arange(len(values))
        total = np.zeros(len(values))
        for feature, cut, length in zip(self.feature, self.cut, self.length):
            at = np.zeros(len(values), np.int64)
            for _ in range(DEPTH):
                split = feature[at]
                on = split >= 0
                right = values[rows, np.maximum(split, 0)] >= cut[at]
                at = np.where(on, 2 * at + 1 + right, at)
            total += length[at]
        return 2.0 ** (-total / len(self.feature) / _average_path(TREE_ROWS))


def grow(usual: np.ndarray, lowest: np.ndarray, highest: np.ndarray, seed: int = 7) -> Forest:
    """Trees over the usual rows; cuts are drawn from the box of all rows.

    So the places that usual rows leave empty are set apart after a few cuts, also along
    features that all of them share. Given TREES * TREE_ROWS rows or more, no two trees
    share one.
    """
    rng = np.random.default_rng(seed)
    places = 2 ** (DEPTH + 1) - 1
    feature = np.full((TREES, places), -1)
    cut, length = np.zeros((TREES, places)), np.zeros((TREES, places))
    if not len(usual):
        return Forest(feature, cut, length, np.inf)
    dealt = rng.permutation(len(usual)) if len(usual) >= TREES * TREE_ROWS else None
    for tree in range(TREES):
        if dealt is None:
            pick = rng.choice(len(usual), min(TREE_ROWS, len(usual)), replace=False)
        else:
            pick = dealt[tree * TREE_ROWS : (tree + 1) * TREE_ROWS]
        work = [(0, 0, usual[pick], lowest, highest)]
        while work:
            at, depth, rows, low, high = work.pop()
            wide = np.flatnonzero(high > low)
            if depth == DEPTH or len(rows) < 2 or not len(wide):
                length[tree, at] = depth + _average_path(len(rows))
                continue
            chosen = rng.choice(wide)
            value = rng.uniform(low[chosen], high[chosen])
            feature[tree, at], cut[tree, at] = chosen, value
            right = rows[:, chosen] >= value
            below, above = high.copy(), low.copy()
            below[chosen] = above[chosen] = value
            work += [(2 * at + 1, depth + 1, rows[~right], low, below), (2 * at + 2, depth + 1, rows[right], above, high)]
    return Forest(feature, cut, length, np.inf)


def calibrated(forest: Forest, rows: DataFrame) -> Forest:
    """With the threshold that has the largest difference of rejected shares of all rows.

    rows: SHARES and whether a row is good. Every anomaly among them is tried: they are
    sorted over many tasks, and rows up to each are counted by ranges, then within them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def anomalies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = shared.value.anomaly(np.column_stack([batch.column(x).to_numpy() for x in SHARES]))
            yield pa.RecordBatch.from_arrays([pa.array(odd), batch.column("good")], ["level", "good"])

    levels = stage(
        rows.select(*SHARES, "good").mapInArrow(anomalies, "level double, good boolean")
        .groupBy("level").agg(F.expr("count_if(good) AS good"), F.expr("count_if(NOT good) AS bad"))
        .orderBy("level").withColumn("part", F.spark_partition_id())
    )
    parts = levels.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("part").collect()
    n_good, n_bad = sum(x["good"] for x in parts), sum(x["bad"] for x in parts)
    if not n_good or not n_bad:
        return forest
    before, good, bad = [], 0, 0
    for x in parts:
        before.append((x["part"], good, bad))
        good, bad = good + x["good"], bad + x["bad"]
    before = rows.sparkSession.createDataFrame(before, "part int, good_before long, bad_before long")
    so_far = "OVER (PARTITION BY part ORDER BY level ROWS UNBOUNDED PRECEDING)"
    best = (
        levels.join(F.broadcast(before), "part")
        .selectExpr(
            "level", f"1 - (good_before + sum(good) {so_far}) / {n_good}D AS lost",
            f"1 - (bad_before + sum(bad) {so_far}) / {n_bad}D AS found",
        )
        .selectExpr("level", f"IF(lost <= {GOOD_LOST}D, found - lost, -1D) AS gain")
        .orderBy(F.desc("gain"), "level").first()
    )
    return dataclasses.replace(forest, threshold=best["level"])


def _stats_of(forest, schema: pa.Schema) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts = statistics([x or "" for x in batch.column("text").to_pylist()])
            columns = {name: counts[:, i] for i, name in enumerate(COUNTS + MORE)}
            failed = base_failed(counts)
            odd = forest.value.anomaly(ratios(counts)) if forest else np.zeros(len(counts))
            columns |= {
                "id": batch.column("id"), "base_failed": failed, "anomaly": odd,
                "kept": ~failed & (odd <= forest.value.threshold) if forest else ~failed,
            }
            yield table(columns, schema)

    return make


SCHEMA = pa.schema(
    [("id", pa.int64())] + [(x, pa.int64()) for x in COUNTS + MORE]
    + [("base_failed", pa.bool_()), ("anomaly", pa.float64()), ("kept", pa.bool_())]
)
SPARK_SCHEMA = (
    "id long, " + ", ".join(f"{x} long" for x in COUNTS + MORE) + ", base_failed boolean, anomaly double, kept boolean"
)


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality"
) -> Forest:
    """A forest from all labelled rows that pass the base rule; 1 is good.

    Rows without id or label are left out; of several labels the lowest counts. Without
    bad or good rows there is no threshold, and the base rule alone decides. The driver
    gets the rows that trees are grown on, and a record for each task.
    """
    marks = (
        labels.select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
        .where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg((F.min("label") == 1).alias("good"))
    )
    base = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    counts = base.where("id IS NOT NULL").mapInArrow(_stats_of(None, SCHEMA), SPARK_SCHEMA).where("NOT base_failed")
    rows = stage(
        counts.select("id", *COUNTS, *MORE).join(marks, "id")
        .mapInArrow(_shares, ", ".join(
            ["id long", "good boolean", *(f"{x} long" for x in COUNTS), *(f"{x} double" for x in SHARES)]
        ))
    )
    ends = rows.agg(
        F.count_if("good"), *(end(x) for end in (F.min, F.max) for x in SHARES)
    ).first()
    lowest, highest = np.array(ends[1:], float).reshape(2, -1)
    usual = (
        rows.where("good" if ends[0] else "true")
        .orderBy(F.xxhash64("id", *SHARES), "id", *SHARES).limit(TREES * TREE_ROWS)
        .orderBy("id", *COUNTS).select(*SHARES).toPandas()
    )
    return calibrated(grow(usual.to_numpy(float), lowest, highest), rows)


def _shares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = ratios(np.column_stack([batch.column(x).to_numpy() for x in COUNTS + MORE]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(x) for x in ("id", "good", *COUNTS)), *map(pa.array, found.T)],
            ["id", "good", *COUNTS, *SHARES],
        )


def judge(docs: DataFrame, forest: Forest, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row of docs: id, counts, base_failed, anomaly (0 to 1) and kept.

    Null and empty texts have no words and fail the base rule. Null and repeated ids are
    judged row by row; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    base = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return base.mapInArrow(_stats_of(shared, SCHEMA), SPARK_SCHEMA).withColumnRenamed("id", id)

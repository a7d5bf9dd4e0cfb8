"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its words, word pairs, and pairs with one word between, hashed
into 2^20 buckets. Training reads a bounded sample of labelled rows (SAMPLE_ROWS, the
smallest hashes of their ids) in one task; its features are made in parallel. L1 leaves
few weights, which are broadcast (8 MB at most) and applied to all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import give_back, hashed_words, mix, slices, split_of, table, texts_of

BITS = 20
SAMPLE_ROWS = 20_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.5, 1.0, 5.0, 1e-4
BIAS = 0  # its bucket is shared with hashed features, and without L1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all texts, with repeats, and the text of each."""
    words, starts = hashed_words(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    found, owners = [mix(words, 31)], [owner]
    for gap, seed in ((1, 32), (2, 33)):
        pair = mix(words[:-gap] * np.uint64(3) + mix(words[gap:], seed), seed)
        inside = owner[:-gap] == owner[gap:]
        found.append(pair[inside])
        owners.append(owner[:-gap][inside])
    buckets = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
    return buckets, np.concatenate(owners)


def _distinct(buckets: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    packed = np.unique((owners << BITS) | buckets)
    return packed & ((1 << BITS) - 1), packed >> BITS


def _features_of(schema: pa.Schema) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            buckets, owners = _distinct(*features(texts_of(batch, "text")))
            ends = np.searchsorted(owners, np.arange(batch.num_rows + 1))
            rows = [buckets[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield table({"rank": batch.column("rank"), "label": batch.column("label"), "buckets": rows}, schema)

    return make


def ftrl(rows: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Weights after EPOCHS passes over (label, distinct buckets) in the given order."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(EPOCHS):
        for label, buckets in rows:
            at = np.r_[BIAS, buckets[buckets != BIAS]]
            weights = _weights(z[at], n[at], at == BIAS)
            slope = 1 / (1 + np.exp(-np.clip(weights.sum(), -35, 35))) - label
            grown = np.sqrt(n[at] + slope * slope)
            z[at] += slope - (grown - np.sqrt(n[at])) / ALPHA * weights
            n[at] += slope * slope
    return _weights(z, n, np.arange(size) == BIAS)


def _weights(z: np.ndarray, n: np.ndarray, free: np.ndarray) -> np.ndarray:
    bound = np.where(free, 0.0, L1)
    pulled = z - np.sign(z) * bound
    return np.where(np.abs(z) <= bound, 0.0, -pulled / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _trained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for label, buckets in zip(batch.column("label").to_pylist(), batch.column("buckets")):
            rows.append((label, np.frombuffer(buckets.as_buffer(), np.int32)))  # no copy of the bytes
    weights = ftrl(rows)
    del rows
    give_back()
    kept = np.flatnonzero(weights)
    schema = pa.schema([("bucket", pa.int32()), ("weight", pa.float64())])
    yield table({"bucket": kept.astype(np.int32), "weight": weights[kept]}, schema)


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id",
    label: str = "toxic", sample_rows: int = SAMPLE_ROWS,
) -> np.ndarray:
    """Weights by bucket, learned from labelled rows whose crc32(id) mod 5 is not 0.

    Rows without id or label and labels without a document are left out. A document with
    several labels counts as toxic if one says so. Without rows all weights are 0, and
    every score is 0.5.
    """
    sample = (
        labels.select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & (split_of("id") != 0))
        .groupBy("id").agg(F.max("label").alias("label"))
        .withColumn("rank", F.xxhash64("id"))
        .orderBy("rank").limit(sample_rows)
    )
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    fields = pa.schema([("rank", pa.int64()), ("label", pa.int32()), ("buckets", pa.binary())])
    made = rows.join(F.broadcast(sample), "id").select("rank", "label", "text").mapInArrow(
        _features_of(fields), "rank long, label int, buckets binary"
    )
    # bounded by sample_rows
    learned = made.repartition(1).sortWithinPartitions("rank", "buckets").mapInArrow(
        _trained, "bucket int, weight double"
    ).toPandas()
    weights = np.zeros(1 << BITS, np.float32)
    weights[learned["bucket"].to_numpy(np.int64)] = learned["weight"].to_numpy(np.float32)
    return weights


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    buckets, owners = features(texts)
    used = (weights[buckets] != 0) & (buckets != BIAS)
    buckets, owners = _distinct(buckets[used], owners[used])
    total = np.bincount(owners, weights[buckets], len(texts)) + float(weights[BIAS])
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _scored(weights, schema: pa.Schema) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score = scores(texts_of(batch, "text"), weights.value)
            yield table({"id": batch.column("id"), "score": score, "predicted": score >= 0.5}, schema)

    return make


def score(
    docs: DataFrame, weights: np.ndarray, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """One row per row of docs: id, held_out (crc32(id) mod 5 is 0), score, predicted.

    Null and empty texts have the score of the bias alone. Rows with a null id are
    scored too. Repeated rows each get a row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    base = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    found = base.mapInArrow(_scored(shared, schema), "id long, score double, predicted int")
    return found.select(
        F.col("id").alias(id), (split_of("id") == 0).alias("held_out"), "score", "predicted"
    )


def _kept(weights) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            mild = pa.array(scores(texts_of(batch, "text"), weights.value) < 0.5)
            yield pc.filter(batch.select(["row"]), mild)

    return make


def drop_toxic(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted to be toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    base = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))
    return base.mapInArrow(_kept(shared), base.select("row").schema).select("row.*")

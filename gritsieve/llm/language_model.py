"""Log-bilinear language model, trained in numpy with noise-contrastive estimation.

A token is a word or the end of a text. Frequent words are a class each; other words are
in a class by their last letters; the end is a class. The network predicts the class
from the CONTEXT classes before it, and a word has its share of the counts of its class,
with half a count for each word and for all unknown ones together:

    p(word | before) = p(class | before) * (count + 1/2) / (class count + (words + 1) / 2)

so probabilities sum to one. Words are counted over all training texts. Every partition
trains on all its training tokens from the same start, and the networks are averaged by
tokens. Classes and TABLE_WORDS words are broadcast; counts of all other words are joined.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import slices, split_of, stage, table, texts_of

FREQUENT, SUFFIXES = 384, 127
CLASSES = FREQUENT + SUFFIXES + 1
END = CLASSES - 1
TABLE_WORDS = 200_000  # words whose counts are broadcast: 6 MB or so
HELD_WORDS = 500_000  # different words a task counts before it passes them on
CONTEXT, SIZE, NOISE, BATCH, RATE = 2, 24, 32, 1024, 0.1
AVERAGES = 32


def suffix_class(word: bytes) -> int:
    return FREQUENT + zlib.crc32(word[-2:]) % SUFFIXES


SUFFIX_CLASS = f"{FREQUENT} + int(crc32(substring(word, -2, 2)) % {SUFFIXES})"


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = table({"word": list(counts.keys()), "n": list(counts.values())}, schema)
        counts.clear()
        return made

    for batch in slices(batches, "text"):
        for text in texts_of(batch, "text"):
            counts.update(text.lower().split())
        if len(counts) > HELD_WORDS:
            yield out()
    if counts:
        yield out()


@dataclasses.dataclass
class Counts:
    """What is known of training words: bounded tables, and all words as a DataFrame."""

    words: list[bytes]  # the most frequent ones, in order of count and word
    counts: np.ndarray
    class_counts: np.ndarray  # tokens of each class
    class_words: np.ndarray  # different words of each class
    every: DataFrame

    @property
    def tokens(self) -> int:
        return int(self.class_counts.sum())

    @property
    def distinct(self) -> int:
        return int(self.class_words.sum())

    def index(self) -> dict[bytes, int]:
        return {word: i for i, word in enumerate(self.words)}

    def classes(self) -> np.ndarray:
        own = np.arange(min(FREQUENT, len(self.words)))
        return np.r_[own, [suffix_class(x) for x in self.words[FREQUENT:]]].astype(np.int64)


def count_words(training: DataFrame) -> Counts:
    """Counts over all texts of training (column text)."""
    every = stage(training.select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # the least level of counts from which on there are TABLE_WORDS words at most
    leveled = every.withColumn("level", F.expr("int(64 * ln(n))"))
    levels = leveled.groupBy("level").count().orderBy(F.desc("level")).collect()  # 3000 at most
    reached = np.cumsum([x["count"] for x in levels])
    taken = [x["level"] for x, total in zip(levels, reached) if total <= TABLE_WORDS]
    top = leveled.where(F.col("level") >= (taken[-1] if taken else 1 << 30)).select("word", "n").collect()
    top.sort(key=lambda x: (-x["n"], bytes(x["word"])))
    words = [bytes(x["word"]) for x in top]
    counts = np.array([x["n"] for x in top], np.int64)
    class_counts, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for row in every.groupBy(F.expr(SUFFIX_CLASS).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_counts[row["c"]], class_words[row["c"]] = row["n"], row["v"]
    for i, word in enumerate(words[:FREQUENT]):
        class_counts[suffix_class(word)] -= counts[i]
        class_words[suffix_class(word)] -= 1
        class_counts[i], class_words[i] = counts[i], 1
    ends = training.count()
    class_counts[END], class_words[END] = ends, int(ends > 0)
    return Counts(words, counts, class_counts, class_words, every)


class Codes(dict):
    """Word to its place in the table, or to -1 - class."""

    def __missing__(self, word: bytes) -> int:
        return -1 - suffix_class(word)


@dataclasses.dataclass
class Network:
    """Score of a class: (sum of context vectors, each scaled) . class vector + bias."""

    before: np.ndarray  # CLASSES x SIZE
    scale: np.ndarray  # CONTEXT x SIZE
    after: np.ndarray  # CLASSES x SIZE
    bias: np.ndarray

    @classmethod
    def start(cls, class_counts: np.ndarray) -> Network:
        rng = np.random.default_rng(11)
        share = (class_counts + 0.5) / (class_counts + 0.5).sum()
        return cls(
            rng.normal(0, 0.3, (CLASSES, SIZE)), np.ones((CONTEXT, SIZE)),
            rng.normal(0, 0.05, (CLASSES, SIZE)), np.log(share),
        )

    @property
    def parts(self) -> tuple[np.ndarray, ...]:
        return self.before, self.scale, self.after, self.bias

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        parts = np.split(flat, np.cumsum([CLASSES * SIZE, CONTEXT * SIZE, CLASSES * SIZE]))
        return cls(parts[0].reshape(-1, SIZE), parts[1].reshape(-1, SIZE), parts[2].reshape(-1, SIZE), parts[3])

    def summary(self, contexts: np.ndarray) -> np.ndarray:
        return sum(self.before[contexts[:, i]] * self.scale[i] for i in range(CONTEXT))

    def log10(self, contexts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities; each different context is summed up once."""
        code = contexts @ (CLASSES ** np.arange(CONTEXT))
        seen, first, place = np.unique(code, return_index=True, return_inverse=True)
        out = np.empty(len(classes))
        order = np.argsort(place, kind="stable")
        ends = np.searchsorted(place[order], np.arange(len(seen) + 1))
        after, bias = self.after.T.astype(np.float32), self.bias.astype(np.float32)
        for a in range(0, len(seen), 2048):
            some = first[a : a + 2048]
            scores = self.summary(contexts[some]).astype(np.float32) @ after + bias
            scores -= scores.max(axis=1, keepdims=True)
            norm = np.log(np.exp(scores).sum(axis=1, dtype=np.float64))
            rows = order[ends[a] : ends[a + len(some)]]
            at = place[rows] - a
            out[rows] = scores[at, classes[rows]] - norm[at]
        return out / np.log(10)


def _add_rows(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    kinds, first = np.unique(rows[order], return_index=True)
    total[kinds] += np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Noise-contrastive estimation with adaptive rates; all of a batch share its noise."""

    def __init__(self, class_counts: np.ndarray, seed: int):
        self.net = Network.start(class_counts)
        self.noise = np.exp(self.net.bias)
        self.edges = np.cumsum(self.noise)
        self.rng = np.random.default_rng(seed)
        self.squares = [np.full_like(x, 1e-2) for x in self.net.parts]

    def step(self, contexts: np.ndarray, classes: np.ndarray) -> None:
        net, count = self.net, len(classes)
        drawn = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE) * self.edges[-1]), CLASSES - 1)
        mean = net.summary(contexts)
        scaled = np.log(NOISE * self.noise)
        real = (mean * net.after[classes]).sum(axis=1) + net.bias[classes] - scaled[classes]
        false = mean @ net.after[drawn].T + net.bias[drawn] - scaled[drawn]
        up = 1 / (1 + np.exp(np.clip(real, -30, 30)))  # slopes of the log likelihood
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
        slopes = [np.zeros_like(x) for x in net.parts]
        before, scale, after, bias = slopes
        _add_rows(after, classes, up[:, None] * mean)
        _add_rows(after, drawn, down.T @ mean)
        bias += np.bincount(classes, up, CLASSES) + np.bincount(drawn, down.sum(axis=0), CLASSES)
        back = up[:, None] * net.after[classes] + down @ net.after[drawn]
        for i in range(CONTEXT):
            _add_rows(before, contexts[:, i], back * net.scale[i])
            scale[i] = (back * net.before[contexts[:, i]]).sum(axis=0)
        for value, slope, square in zip(net.parts, slopes, self.squares):
            slope /= count ** 0.5
            square += slope * slope
            value += RATE * slope / np.sqrt(square)


def coded(texts: list[bytes], codes: Codes, classes: np.ndarray) -> tuple:
    """Words of all texts; and for all tokens with the ends: code, class, contexts, text."""
    words: list[bytes] = []
    sizes = []
    for text in texts:
        own = text.lower().split()
        sizes.append(len(own) + 1)
        words += own
        words.append(b"")  # the end
    end = len(classes)  # behind the table
    code = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    ends = np.cumsum(sizes) - 1
    code[ends] = end
    known = np.r_[classes, END]
    kind = np.where(code < 0, -1 - code, known[np.maximum(code, 0)])
    contexts = np.full((len(words), CONTEXT), END)
    owner = np.repeat(np.arange(len(texts)), sizes)
    for i in range(CONTEXT):
        gap = i + 1
        same = owner[gap:] == owner[:-gap]
        contexts[gap:, i] = np.where(same, kind[:-gap], END)
    return words, code, kind, contexts, owner


NETWORK = pa.schema([("tokens", pa.int64()), ("network", pa.binary())])


def _trained(shared) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes, class_counts = shared.value
        codes = Codes(words)
        trainer = Trainer(class_counts, TaskContext.get().partitionId())
        tokens = 0
        for batch in slices(batches, "text"):
            _, _, kind, contexts, _ = coded(texts_of(batch, "text"), codes, classes)
            order = trainer.rng.permutation(len(kind))
            for a in range(0, len(kind), BATCH):
                some = order[a : a + BATCH]
                trainer.step(contexts[some], kind[some])
            tokens += len(kind)
        if tokens:
            yield table({"tokens": [tokens], "network": [trainer.net.flat().tobytes()]}, NETWORK)

    return make


def _averaged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, tokens = 0.0, 0
    for batch in batches:
        for count, flat in zip(batch.column("tokens").to_pylist(), batch.column("network").to_pylist()):
            total = total + count * np.frombuffer(flat)
            tokens += count
    if tokens:
        yield table({"tokens": [tokens], "network": [(total / tokens).tobytes()]}, NETWORK)


def train(training: DataFrame, counts: Counts) -> Network:
    """The average network over all partitions of training (column text)."""
    shared = training.sparkSession.sparkContext.broadcast((counts.index(), counts.classes(), counts.class_counts))
    local = training.select("text").mapInArrow(_trained(shared), "tokens long, network binary")
    # averages of averages: a network is 0.2 MB, and AVERAGES of them reach the driver
    some = local.repartition(AVERAGES).mapInArrow(_averaged, "tokens long, network binary").collect()
    if not some:
        return Network.start(counts.class_counts)
    tokens = sum(x["tokens"] for x in some)
    return Network.of(sum(x["tokens"] / tokens * np.frombuffer(x["network"]) for x in some))


PARTIAL = pa.schema([
    ("row", pa.int64()), ("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary())),
])


def _scored(shared) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes, network, counts, class_counts, class_words = shared.value
        codes, net = Codes(words), Network.of(network)
        row = TaskContext.get().partitionId() << 33
        ends = class_counts[END]
        halves = np.log10(np.r_[counts, ends] + 0.5)
        total = np.log10(class_counts.sum() + 0.5 * (class_words.sum() + 1))
        spread = np.log10(class_counts + 0.5 * (class_words + 1))
        for batch in slices(batches, "text"):
            found, code, kind, contexts, owner = coded(texts_of(batch, "text"), codes, classes)
            rare = code < 0
            count = batch.num_rows
            half = np.where(rare, 0.0, halves[np.maximum(code, 0)])
            shared_class = (kind >= FREQUENT) & (kind != END)
            value = net.log10(contexts, kind) + np.where(shared_class, half - spread[kind], 0.0)
            known = ~rare & ((kind != END) | (ends > 0))
            at = np.flatnonzero(rare)
            offsets = np.searchsorted(owner[at], np.arange(count + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array([found[i] for i in at], pa.binary()))
            yield table({
                "row": np.arange(row, row + count), "id": batch.column("id"),
                "n_tokens": np.bincount(owner, minlength=count),
                "n_known": np.bincount(owner, known, count).astype(np.int64),
                "base": np.bincount(owner, half - total, count), "score": np.bincount(owner, value, count),
                "rare": lists,
            }, PARTIAL)
            row += count

    return make


def score(docs: DataFrame, counts: Counts, net: Network, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score
    (counts alone) and score, both log10 probabilities of the whole text.

    Null and empty texts are the end alone. Null and repeated ids are scored row by row;
    other columns are ignored; an empty table gives no rows. Without training texts all
    classes are about as likely.
    """
    shared = docs.sparkSession.sparkContext.broadcast((
        counts.index(), counts.classes(), net.flat(), counts.counts, counts.class_counts, counts.class_words,
    ))
    base = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    partial = stage(base.mapInArrow(
        _scored(shared), "row long, id long, n_tokens long, n_known long, base double, score double, rare array<binary>"
    ))
    # words outside the broadcast table: each is rare, so no join key is hot
    rare = partial.select("row", F.explode("rare").alias("word")).join(counts.every, "word", "left")
    rest = rare.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("half"), F.count("n").alias("more")
    )
    return partial.drop("rare").join(rest, "row", "left").select(
        F.col("id").alias(id), (split_of("id") == 1).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("half", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("half", F.lit(0.0))).alias("score"),
    )


def language_model(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Train on the rows whose crc32(id) mod 5 is not 1 and score all rows."""
    training = docs.where(split_of(id) != 1).select(F.col(text).cast("string").alias("text"))
    counts = count_words(training)
    return score(docs, counts, train(training, counts), text, id)

"""Each operator on odd rows, and against brute force, exact round trips or held-out rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from gritsieve.llm import (
    exact_dedup, language_model, licence_headers, licences, ngram_join, packing, quality, records, sentence_pieces,
    substring, toxicity,
)
from gritsieve.llm.common import components

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, row string"


def sentence(seed, count):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(count))


LONG = sentence(1, 9000)
PASSAGE = sentence(2, 60)
NEAR = sentence(3, 300).split()
ROWS = [
    (1, LONG), (2, LONG.upper()), (2, LONG.upper()), (3, None), (4, ""), (5, " \n\t "), (None, LONG), (None, None),
    (6, "one"), (7, "one two"), (8, f"{sentence(4, 80)} {PASSAGE} {sentence(5, 70)}"),
    (9, f"{sentence(6, 30)}\n{PASSAGE.title()}\n{sentence(7, 90)}"), (10, " ".join(NEAR)),
    (11, " ".join([*NEAR[:150], "changed", *NEAR[151:]])), (12, " ".join([*NEAR[:140], "x", *NEAR[141:]])),
    (13, "same words " * 400), (14, "same words " * 401), (15, "É à ñ 日本 😀 \0 ▁ <s> <|endoftext|>"),
    (16, PASSAGE), (17, sentence(8, 200)),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "src0", len(t or ""), "a", 1, "b") for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (8, 1, 0), (8, None, 1), (None, 1, 1), (99, 1, 1), (17, 0, None)],
        "doc_id long, quality int, toxic int",
    )


def words(text):
    return (text or "").encode().lower().split()


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_every_operator_gives_nothing_for_an_empty_table(spark, empty, labels):
    none = labels.limit(0)
    for found in (
        exact_dedup.exact_dedup(empty), ngram_join.ngram_groups(empty), substring.passages(empty),
        packing.pack(empty, WORDS, 1), records.read_digests(records.write_records(empty, BYTES, 0)),
        quality.judge(empty, quality.fit(empty, none)), toxicity.score(empty, toxicity.train(empty, none)),
        language_model.language_model(empty), sentence_pieces.digests(empty, PIECES),
        licences.licences(empty, path="source"),
    ):
        assert found.count() == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("partitions", ["1", "7"])
def test_exact_dedup(spark, odd, keep, partitions):
    plain = [(i, (t or "").encode().lower()) for i, t in ROWS]
    pick = min if keep == "smallest" else max
    expected = []
    for i, t in plain:
        ids = [a for a, b in plain if b == t]
        known = [a for a in ids if a is not None]
        expected.append((i, pick(known) if known else None, len(ids), hashlib.sha256(t).hexdigest()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = exact_dedup.exact_dedup(odd, keep=keep).collect()
        assert sorted([(r[0], r[1], r[2], r[4]) for r in found], key=str) == sorted(expected, key=str)
        assert sum(r.kept for r in found) == len({t for _, t in plain})
        assert all(r.doc_id == r.keep_id for r in found if r.kept)
        left = exact_dedup.drop_copies(odd, keep=keep)
        assert left.columns == odd.columns and left.count() == len({t for _, t in plain})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_group_of_copies_over_many_partitions(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'Hot', concat('t', id % 50)) AS text")
    found = exact_dedup.exact_dedup(df.repartition(9), keep="largest")
    expected = df.selectExpr(
        "doc_id", "max(doc_id) OVER (PARTITION BY lower(text)) AS keep_id", "count(*) OVER (PARTITION BY lower(text)) AS n"
    )
    assert sorted_rows(found.select("doc_id", "keep_id", "group_size")) == sorted_rows(expected)
    assert found.where("kept").count() == 51


def groups_by_brute_force(rows, width, percent):
    sets = []
    for i, t in rows:
        w = words(t)
        runs = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        sets.append((i, runs))
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                shared = len(x & y)
                if x and a is not None and b is not None and shared and 100 * shared >= percent * len(x | y) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return sorted([(i, len(x), label[i]) for i, x in sets], key=str)


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_ngram_groups(odd, monkeypatch, width, percent):
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", 200)  # clusters of several blocks
    monkeypatch.setattr(ngram_join, "BITMAP_SHINGLES", 400)
    found = ngram_join.ngram_groups(odd, width=width, percent=percent)
    assert sorted_rows(found) == groups_by_brute_force(ROWS, width, percent)


@pytest.mark.parametrize("block", [100, 64_000])
def test_sets_two_size_bands_apart_are_linked_in_clusters_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", block)
    monkeypatch.setattr(ngram_join, "BITMAP_SHINGLES", 2 * block)
    long = sentence(400, 100).split()
    rows = [(i, " ".join(long[: 100 - i])) for i in (0, 12, 24, 36, 37)] + [(90, sentence(401, 80))]
    found = ngram_join.ngram_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=60)
    assert sorted_rows(found) == groups_by_brute_force(rows, 5, 60)
    ends = spark.createDataFrame([rows[0], rows[4]], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.ngram_groups(ends, percent=60).collect()} == {0}


def test_near_copies_among_several_texts_of_one_id(spark):
    text, clean = sentence(410, 100), sentence(411, 100)
    near, again = text + " end", clean + " end"
    rows = [(1, text), (5, near), (5, clean), (7, again), (7, again), (8, sentence(412, 30)), (None, text), (9, None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, gone int")
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    gone = [(5, near), (7, again), (7, again)]
    assert sorted([tuple(r)[:2] for r in kept.collect()], key=str) == sorted([r for r in rows if r not in gone], key=str)
    both = spark.createDataFrame([(3, text), (3, near)], "doc_id long, text string")
    assert ngram_join.drop_near_copies(both).count() == 1
    one = spark.createDataFrame([(3, text, 1), (4, near, 1), (None, text, 1)], "doc_id long, text string, gone int")
    assert {r.doc_id for r in ngram_join.drop_near_copies(one).collect()} == {3, None}


@pytest.mark.parametrize("percent", [80, 90])
def test_sets_at_the_threshold_share_a_key(percent):
    rng, starts = np.random.default_rng(1), ngram_join.bands(percent, 40_000)

    def keys(members):
        band = int(np.searchsorted(starts, len(members), "right")) - 1
        own = [ngram_join._segment_keys(members, band, starts, percent)]
        if band and percent * len(members) <= 100 * (int(starts[band]) - 1):
            own.append(ngram_join._segment_keys(members, band - 1, starts, percent))
        return np.concatenate(own)

    kept = 0
    for size in [*range(5, 90, 3), *rng.integers(90, 8000, 150).tolist()]:
        shared = -(-percent * size // 100)  # a subset that is just similar enough
        big = rng.integers(0, 2**64, size, dtype=np.uint64)
        both = 2 * percent * size // (100 + percent) + 1  # and one of equal size
        other = np.r_[big[:both], rng.integers(0, 2**64, size - both, dtype=np.uint64)]
        for near in (big[:shared], other):
            if len(near) < size or both < size:
                assert np.intersect1d(keys(big), keys(near)).size
        kept += len(keys(big)) / size
    assert kept < 180 * 0.6


def test_bitmaps_never_miss_a_link():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [np.unique(np.r_[rng.choice(base, 290, replace=False), rng.integers(0, 2**63, k, dtype=np.uint64)]) for k in range(40)]
    sizes = np.array([len(x) for x in sets])
    bitmaps = [ngram_join._bitmaps([x], 1 << (len(x) // 32).bit_length()).tobytes() for x in sets]
    for linked in (
        ngram_join.links_of_tile(np.arange(40), sets, np.zeros(40, int), 90),
        ngram_join.near_in_tile(np.arange(40), sizes, bitmaps, np.zeros(40, int), 90),
    ):
        reach = list(range(40))
        for a, b in linked:
            reach = [min(reach[a], reach[b]) if r in (reach[a], reach[b]) else r for r in reach]
        for i in range(40):
            for j in range(i):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if 100 * shared >= 90 * (len(sets[i]) + len(sets[j]) - shared):
                    assert reach[i] == reach[j]


@pytest.mark.parametrize("percent", [80, 90])
def test_bitmaps_of_many_sizes_keep_links_and_leave_others_apart(percent):
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**64, size, dtype=np.uint64) for size in rng.integers(20, 3000, 60)]
    sets += [x[: -(-percent * len(x) // 100)] for x in sets]
    bitmaps = [ngram_join._bitmaps([x], 1 << (len(x) // 32).bit_length()).tobytes() for x in sets]
    sizes = np.array([len(x) for x in sets])
    for blocks in (np.zeros(120, int), np.arange(120) // 60):
        found = ngram_join.near_in_tile(np.arange(120), sizes, bitmaps, blocks, percent)
        assert {tuple(sorted(x)) for x in found} == {(i, i + 60) for i in range(60)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7), (200, 199)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100, 199: 199, 200: 199}


def test_centres_and_windows_are_those_of_the_cartesian_tree():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 2**63, 500, dtype=np.uint64)
    valid = np.zeros(500, bool)
    valid[: 500 - 20 + 1] = True
    centres = substring.sliding_centres(hashes, valid, 20)
    left, right = substring.compact_windows(hashes, np.zeros(len(centres), int), np.full(len(centres), 499), centres)
    expected = []
    for c in range(500):
        a = b = c
        while a and hashes[a - 1] > hashes[c]:
            a -= 1
        while b < 499 and hashes[b + 1] > hashes[c]:
            b += 1
        if b - a + 1 >= 20:
            expected.append((c, c - a, b - c))
    assert list(zip(centres, left, right)) == expected


def test_passages(odd):
    found = substring.passages(odd).collect()
    removed = {r.doc_id: set() for r in found}
    for r in found:
        if r.removed:
            removed[r.doc_id].update(range(r.start, r.end))
    assert len(removed[2]) == 9000 and set(range(30, 90)) <= removed[9] and len(removed[16]) == 60
    assert not {3, 4, 5, 6, 7, 17, None} & set(removed) and not removed[1] and not removed[8]
    cut = substring.cut_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == len(ROWS)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] == LONG and texts[3] is None and texts[2] == "" and texts[16] == ""
    assert texts[9].split() == (sentence(6, 30) + " " + sentence(7, 90)).split()


def test_passages_cover_all_exact_repeats(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    first: dict = {}
    for i, w in sorted(rows):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    removed: dict = {}
    for r in substring.passages(docs).where("removed").collect():
        removed.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    for i, w in rows:
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] != i:
                assert set(range(k, k + 50)) <= removed.get(i, set())


def removed_words(docs):
    removed: dict = {}
    for r in substring.passages(docs).where("removed").collect():
        removed.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    return removed


def test_a_passage_many_times_in_one_document_however_batches_fall(spark):
    once = (1, f"{sentence(21, 80)} {PASSAGE} {sentence(22, 80)}")
    often = (2, " ".join([sentence(23, 40), *[PASSAGE] * 20, sentence(24, 40)]))
    schema = "doc_id long, text string"
    apart = spark.createDataFrame([once], schema).unionByName(spark.createDataFrame([often], schema))
    for docs in (apart, apart.coalesce(1)):
        assert set(range(40, 40 + 20 * 60)) <= removed_words(docs).get(2, set())


def test_passages_that_hold_a_frequent_line(spark):
    rows, due = [], {}
    for k in range(0, 400, 4):
        line, around = sentence(1000 + k, 45), sentence(2000 + k, 10).split()
        passage = " ".join([*around[:5], line, *around[5:]])
        for i, middle in enumerate((line, passage, passage)):
            rows.append((k + i, f"{sentence(3000 + k + i, 60)} {middle} {sentence(5000 + k + i, 60)}"))
        due[k + 2] = set(range(60, 115))
    found = removed_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert not [i for i, places in due.items() if not places <= found.get(i, set())]
    assert not set(found) - set(due) - {i - 1 for i in due}


def test_planted_near_copies_are_found(spark):
    rows = []
    for k in range(0, 800, 2):  # a word of 52 changed: 43 tokens of 53 are shared
        copy = sentence(7000 + k, 52).split()
        for i, middle in enumerate((copy, [*copy[:26], "changed", *copy[27:]])):
            rows.append((k + i, f"{sentence(9000 + k + i, 60)} {' '.join(middle)} {sentence(11000 + k + i, 60)}"))
    found = removed_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert not [k for k in range(0, 800, 2) if len(found.get(k + 1, set()) & set(range(60, 112))) < 50]


def test_packing(odd):
    tokenizer = Tokenizer.from_file(WORDS)
    found = packing.pack(odd, WORDS, 1, 256, with_ids=True).collect()
    ids = sorted([tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t in ROWS])
    whole = sorted(([x for r in sorted(rows, key=lambda r: r.start) for x in r.ids] for rows in _by_document(found)))
    assert whole == ids
    sequences: dict = {}
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 0
        total = sum(n for _, n in pieces)
        assert total <= 256 and total & total - 1 == 0


def _by_document(rows):
    """Pieces with the same document, told apart by where they continue each other."""
    open_, done = [], []
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.doc_tokens, r.start)):
        for pieces in open_:
            last = pieces[-1]
            if (last.doc_id, last.doc_tokens, last.start + last.length) == (r.doc_id, r.doc_tokens, r.start):
                pieces.append(r)
                break
        else:
            assert r.start == 0
            open_.append([r])
    return done + open_


def test_best_fit_is_the_tightest_window():
    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 80))]
        space, expected = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [x for x in space if x >= lengths[i]]
            if fits:
                space.remove(min(fits))
                space.append(min(fits) - lengths[i])
            else:
                space.append(64 - lengths[i])
        packed = packing.best_fit_decreasing(lengths, 64)
        expected = sorted(64 - x for x in space)
        assert sorted(sum(lengths[i] for i in w) for w in packed) == expected
        filled = packing.fill_up(packed, lengths, 64)
        assert sum(n for w in filled for _, _, n in w) == sum(lengths)


def test_records_round_trip_and_damage(spark, odd, tmp_path):
    tokenizer = Tokenizer.from_file(BYTES)
    manifest = records.write_records(odd, BYTES, 0, folder=str(tmp_path / "records"))
    expected = sorted(
        [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in ROWS],
        key=lambda x: (x[0] is not None, x[0] or 0),
    )
    found = sorted(records.read_records(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [i for i, _ in expected]
    start = 0
    for r in found:
        assert r.start == start and (r.doc_id, r.ids) in expected
        start += len(r.ids)
    shuffled = records.read_shuffled(manifest, 5)
    assert sorted_rows(shuffled) == sorted([(i, x) for i, x in expected], key=str)
    framed = records.frame(b"payload")
    for at in range(len(framed)):
        hurt = bytearray(framed)
        hurt[at] ^= 1
        left = bytes(hurt[12:])
        with pytest.raises(ValueError):
            records.unframed(bytes(hurt[:12]), lambda n: left[:n])


def test_quality_statistics_and_verdicts(odd, labels):
    forest = quality.fit(odd, labels)
    found = {r.doc_id: r for r in quality.judge(odd, forest).collect()}
    assert len(found) == len({i for i, _ in ROWS})
    assert found[3].n_words == 0 and found[3].base_failed and not found[3].kept
    assert found[13].n_repeat_words == 800 and found[13].base_failed
    text = "a b c a b c d\nx y\n\nx y\n x y # $<|\n"
    counts = quality.statistics([text])[0]
    assert counts[:5].tolist() == [16, 17, 4, 1, 6 + 0] or counts[0] == len(text.split())
    assert counts[2] == 4 and counts[3] == 1


def test_quality_on_labelled_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    found = quality.judge(docs, quality.fit(docs, marks)).join(marks, "doc_id").where("NOT base_failed").toPandas()
    good = found.quality == 1
    assert found.kept[good].mean() > 0.98 and found.kept[~good].mean() < 0.3


def test_quality_threshold_is_the_best_over_all_labelled_rows(spark):
    docs = spark.range(0, 24_000, 1, 6).selectExpr("id AS doc_id", (
        "array_join(transform(sequence(0, 60 + id % 31), i -> concat(hash(i, id) % 1000, "
        "IF(pmod(hash(id, i, 1), 100) < pmod(hash(id, 2), 5 + 60 * CAST(id % 2 AS INT)), '<#>', 'X!'))), ' ') AS text"
    ))
    marks = docs.selectExpr("doc_id", "IF(doc_id % 2 = 0 OR doc_id % 5 = 0, 1, 0) AS quality")
    forest = quality.fit(docs, marks)
    found = quality.judge(docs, forest).where("NOT base_failed").join(marks, "doc_id").toPandas()
    assert len(found) > 23_000
    good = found.anomaly[found.quality == 1].to_numpy()
    bad = found.anomaly[found.quality == 0].to_numpy()
    best = (-1.0, 0.0)
    for level in np.unique(found.anomaly):
        lost = 1 - (good <= level).sum() / len(good)
        gain = 1 - (bad <= level).sum() / len(bad) - lost if lost <= quality.GOOD_LOST else -1.0
        best = max(best, (gain, -level))
    assert forest.threshold == -best[1]


def test_toxicity(spark, odd, labels):
    weights = toxicity.train(odd, labels)
    found = toxicity.score(odd, weights)
    assert found.count() == len(ROWS) and found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.drop_toxic(odd, np.zeros_like(weights)).count() == 0  # all scores are 0.5
    folder = "/root/testdata/sf0.1"
    docs, marks = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    held = toxicity.score(docs, toxicity.train(docs, marks)).where("held_out").join(marks, "doc_id").toPandas()
    assert held.predicted[held.toxic == 1].mean() > 0.7 and held.predicted[held.toxic == 0].mean() < 0.01


def test_language_model(spark, odd):
    found = language_model.language_model(odd)
    assert found.count() == len(ROWS)
    rows = found.where("doc_id IN (3, 4, 5)").collect()
    assert len(rows) == 3 and all(r.n_tokens == 1 and r.score < 0 for r in rows)
    net = language_model.Network.start(np.ones(language_model.CLASSES))
    contexts = np.tile([[3, 7]], (language_model.CLASSES, 1))
    total = (10 ** net.log10(contexts, np.arange(language_model.CLASSES))).sum()
    assert abs(total - 1) < 1e-5


def test_language_model_counts_and_held_out_gain(spark, monkeypatch):
    monkeypatch.setattr(language_model, "TABLE_WORDS", 2000)  # so that most words are joined
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: words(r.text) + [None] for r in docs.collect()}
    counts: dict = {}
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    found = language_model.language_model(docs).collect()
    for r in found:
        w = texts[r.doc_id]
        base = sum(np.log10((counts.get(x, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), total)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.97


def test_sentence_pieces(spark, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    machine = sentence_pieces.transducer(PIECES)
    rng = random.Random(9)
    texts = [t or "" for _, t in ROWS if t != LONG] + ["".join(rng.choices("abcdehilnorst  é\n", k=50)) for _ in range(300)]
    for text in texts:
        ids = machine.encode(text)
        assert ids.tolist() == library.encode(text)
        assert machine.decode(ids) == text.replace("▁", " ")
    encoded = sentence_pieces.encode(odd, PIECES)
    back = sentence_pieces.decode(encoded, PIECES)
    assert sorted_rows(back) == sorted([(i, (t or "").replace("▁", " ")) for i, t in ROWS], key=str)
    assert sentence_pieces.digests(odd, PIECES).where("NOT round_trip").count() == 1  # the text with a mark


def test_pieces_without_merges_take_the_least_sum():
    machine = sentence_pieces.transducer(PIECES)
    other = object.__new__(sentence_pieces.Transducer)
    other.__dict__ = machine.__dict__ | {
        "kind": sentence_pieces.UNIGRAM, "pieces": {"a": 0, "b": 1, "ab": 2, "aba": 3}, "weight": [1.0, 1.0, 1.5, 4.0],
    }
    other.__dict__.pop("lexicon", None)  # that of the other pieces
    assert other.shortest("aba") == [2, 0]


def test_licences(spark):
    rows = [
        (1, "a/b/x.txt", "Some text. Released under the MIT License. More text."),
        (2, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (3, "a/b/c/y.txt", "none"),
        (4, "a/b/c/LICENSE.md", None), (5, "a/b/COPYING", "this work is licensed under the gnu general public license, version 3"),
        (6, "top.txt", ""), (7, None, "free licence of mine"), (8, "z/LICENSE", "permission is granted"),
        (None, "a/q.txt", "Released under the MIT License."), (9, "a/b", "text"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = {(r.doc_id, r.path): (r.own_licence, r.licence, r.inherited_from) for r in licences.licences(df).collect()}
    assert len(found) == len(rows)
    assert found[1, "a/b/x.txt"] == ("MIT", "MIT", None)
    assert found[3, "a/b/c/y.txt"] == (None, "GPL-3.0", "a/b/COPYING")
    assert found[9, "a/b"] == (None, "Apache-2.0", "a/LICENSE")
    assert found[6, "top.txt"] == (None, None, None) == found[7, None] == found[8, "z/LICENSE"]
    assert found[None, "a/q.txt"] == (None, "Apache-2.0", "a/LICENSE")


def test_licence_headers_and_whole_files(spark):
    def commented(text, width=9):
        parts = text.split()
        return "\n".join("# " + " ".join(parts[i : i + width]) for i in range(0, len(parts), width))

    headers = dict(licence_headers.HEADERS[::-1])
    gnu = [x for n, x in licence_headers.HEADERS if n == "GPL-2.0"]
    mit = f"{licence_headers.GRANT}\n\n{licence_headers.MIT_REST}"
    bsd = commented(licence_headers.BSD_2 + licence_headers.BSD_NAMES + licence_headers.BSD_REST)
    texts = {name: text for name, text in licence_headers.whole_texts()}
    rows = [
        ("MIT", "a.py", f"{commented('Copyright 2020 Somebody')}\n#\n{commented(mit)}\n\ncode = 1\n"),
        ("MIT", "b.py", "MIT License\n\nwords"), ("GPL-2.0", "c.c", f"{commented(gnu[0])}\n\nint x;"),
        ("Apache-2.0", "d.c", "// SPDX-License-Identifier: Apache-2.0\nint x;"),
        (None, "e.c", "// SPDX-License-Identifier: EPL-2.0\nint x;"),
        ("BSD-3-Clause", "f.c", f"# Copyright 1999 Somebody Else\n{bsd}\n\nint x;"),
        ("BSD-2-Clause", "g.txt", "BSD 2-Clause License"), ("AGPL-3.0", "h/LICENSE", texts["GPL-3.0"].replace(
            "GNU GENERAL", "GNU AFFERO GENERAL").replace("29 June", "19 November")),
        ("Apache-2.0", "i.c", commented(licence_headers.APACHE + licence_headers.APACHE_REST)),
        ("MPL-2.0", "j.c", commented(headers["MPL-2.0"])),
        *((name, f"k/{name}/LICENSE", text) for name, text in texts.items()), (None, "l.txt", "the general public"),
    ]
    data = [(i, path, text) for i, (_, path, text) in enumerate(rows)]
    data += [(100 + i, f"x{i}", sentence(300 + i, 60)) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, path string, text string")
    found = {r.doc_id: r.own_licence for r in licences.licences(df).collect()}
    assert [found[i] for i in range(len(rows))] == [name for name, *_ in rows]
    assert not any(found[100 + i] for i in range(60))


def test_licence_weights_count_every_word(spark):
    rows = [(i, "p", f"this zog that {i}") for i in range(2000)] + [(5000, "p", "zog released under the MIT License")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    (found,) = licences.own_licences(df).collect()
    assert found.own_licence == "MIT" and found.score > 0.97


def test_pipeline(spark, odd, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        step(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and docs.count() <= before
        before = docs.count()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = [(t or "").encode().lower() for _, t in rows if t]
    assert len(texts) == len(set(texts))
    pieces = corpus_pipeline.run(spark, folder).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    ids: dict = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert ids == {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, odd, folder).columns == odd.columns

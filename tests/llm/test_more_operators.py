"""Hard negatives, archives and token alignment: odd rows, brute force and round trips."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
import zstandard
from pyarrow import fs
from tokenizers import Tokenizer

from gritsieve.llm import alignment, common, hard_negatives, licence_headers, licences, substring, warc
from gritsieve.llm import queries as registered

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# Hard negatives


def negatives_by_brute_force(rows, positives=5, negatives=10, low=30, high=90, every=100):
    part = [
        (i, label, [math.floor(Fraction(256) * Fraction(x)) for x in vector]) for i, label, vector in rows
        if i is not None and label is not None and vector is not None
        and all(x is not None and math.isfinite(x) and abs(x) < 65536 for x in vector)
    ]
    out = []
    for own, label, anchor in part:
        if own % every:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(anchor, vector)), i, other == label)
            for i, other, vector in part if i != own and len(vector) == len(anchor)
        )
        for minus_p, positive, _ in [x for x in scored if x[2]][:positives]:
            fits = [x for x in scored if not x[2] and low * -minus_p <= 100 * -x[0] <= high * -minus_p]
            for rank, (minus_n, negative, _) in enumerate(fits[:negatives], start=1):
                out.append((own, positive, rank, negative, -minus_p, -minus_n))
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, number int, id string"


def vectors(rows):
    return [(i, label, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]


def random_vectors(seed, count, size, spread=0.2, anchors=100):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, spread, (4, size))
    return vectors(
        (i, int(rng.integers(0, 4)), (centre[rng.integers(0, 4)] + rng.normal(0, spread, size)).tolist()) for i in range(count)
    )


def found_negatives(spark, rows, partitions=3, **more):
    df = spark.createDataFrame([(*x, 1, "a") for x in rows], VECTORS).repartition(partitions)
    return sorted(map(tuple, hard_negatives.hard_negatives(df, **more).collect()))


@pytest.mark.parametrize("partitions,size", [(1, 8), (5, 8), (4, 64), (3, 1)])
def test_hard_negatives(spark, partitions, size):
    rows = random_vectors(size + partitions, 700, size)
    expected = negatives_by_brute_force(rows)
    assert expected and found_negatives(spark, rows, partitions) == expected


def test_hard_negatives_in_small_blocks_and_groups(spark, monkeypatch):
    rows = random_vectors(3, 600, 6)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 37)
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 2)
    found = found_negatives(spark, rows, 3, anchors="vec_id % 20 = 0", positives=3, negatives=4, low=-50, high=95)
    assert found == negatives_by_brute_force(rows, 3, 4, -50, 95, 20)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [0.5, -0.25, 0.125]
    rows = vectors([
        (0, 1, same), (0, 1, same), (100, 2, [0.0, 0.0, 0.0]), (200, 1, [-0.5, 0.1, 0.3]), (300, None, same), (400, 1, None),
        (500, 1, [0.1, None, 0.2]), (600, 1, [0.1, nan, 0.2]), (700, 1, [0.1, -inf, 0.2]), (None, 1, same), (800, 3, []), (801, 4, []),
        (802, 3, []), (900, 1, [0.5]), (901, 1, [0.25]), (902, 2, [0.125]), (1000, 1, [1e9, 0.0, 0.0]),
        *((i, 1 + i % 2, same) for i in range(1, 30)), *((i, 2, [0.3, -0.1, 0.1]) for i in range(30, 45)),
        (46, 2, [0.3, -0.1, 0.1]), (46, 2, [0.3, -0.1, 0.1]), (47, 3, [60000.0, -60000.0, 1.0]), (1100, 3, [50000.0, 1.0, -1.0]),
    ])
    expected = negatives_by_brute_force(rows)
    assert {x[0] for x in expected} >= {0, 100, 800, 900}
    assert found_negatives(spark, rows) == expected
    assert found_negatives(spark, []) == []
    assert found_negatives(spark, rows[4:8]) == []


def test_the_walk_stops_early_where_a_few_rows_stand_out():
    rng = np.random.default_rng(1)
    values = rng.integers(-4, 5, (4000, 6)).astype("<i4")
    values[:40] = rng.integers(200, 256, (40, 6))
    block = hard_negatives.Block({
        "ids": np.arange(4000).astype("<i8").tobytes(), "labels": np.zeros(4000, "<i8").tobytes(), "size": 6,
        "components": values.tobytes(), "lists": np.argsort(values, 0, "stable").T.astype("<u2").tobytes(),
    }).open()
    anchor = np.array([3, 1, 2, 1, 5, 1], np.int32)
    [(scores, ids)], depth = hard_negatives.top_in_windows(block, anchor, np.ones(4000, bool), [(-(1 << 62), 1 << 62)], 5)
    every = sorted((-int(x), i) for i, x in enumerate(values @ anchor))[:5]
    assert list(zip((-scores).tolist(), ids.tolist())) == every
    assert depth < 400


# Archives

PAGES = "page_id long, url string, html string, id string, payload int, digest int"


def page_rows():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefgh <>/é", k=n))
    twice, thrice, short = text(1500), text(4000), text(300)
    rows = [(i, f"http://h/{i}", f"<html><body>{text(rng.randint(0, 3000))}</body></html>") for i in range(200)]
    return rows + [
        (300, "u", twice), (301, "u", twice), (302, None, thrice), (303, "a b\r\nc", thrice), (304, "u", thrice),
        (305, "u", short), (306, "u", short), (307, "u", None), (308, "u", ""), (None, "u", twice), (None, None, None),
        (304, "u", thrice), (309, "u", "x" * 1000), (310, "u", "x" * 1000), (311, "u", "y" * 999), (312, "u", "y" * 999),
        (None, "u", "z" * 2000), (None, "u", "z" * 2000), (313, "u", "long " * 400_000), (314, "u", "\r\n\r\nWARC/1.1 " * 90),
    ]


def pages_by_brute_force(rows):
    plain = [(i, (t or "").encode()) for i, _, t in rows]
    first = {}
    for i, t in plain:
        if i is not None:
            first[t] = max(i, first.get(t, i))
    out = []
    for i, t in plain:
        other = first.get(t) if len(t) >= 1000 and first.get(t) != i else None
        out.append((i, len(t), hashlib.sha1(t).hexdigest(), "response" if other is None else "revisit", other))
    return sorted(out, key=str)


@pytest.mark.parametrize("archive_bytes", [warc.ARCHIVE_BYTES, 50_000])
def test_archives(spark, archive_bytes):
    rows = page_rows()
    df = spark.createDataFrame([(*x, "a", 1, 2) for x in rows], PAGES).repartition(4)
    manifest = warc.write_archives(df, archive_bytes=archive_bytes)
    assert sorted(map(tuple, warc.read_digests(manifest).collect()), key=str) == pages_by_brute_force(rows)
    texts = {(i, hashlib.sha1((t or "").encode()).hexdigest()): (t or "").encode() for i, _, t in rows}
    records = warc.read_archives(manifest).collect()
    assert len(records) == len(rows)
    for x in records:
        if x.record_type == "response":
            assert bytes(x.payload) == texts[x.page_id, x.payload_digest]
        else:
            assert x.payload is None
    held = manifest.collect()
    assert sum(x.records for x in held) == len(rows)
    for x in random.Random(1).sample(records, 20):  # by place
        again = warc.read_at(held[0].folder, x.archive, x.offset, x.length)
        assert (again["page_id"], again["payload_digest"], again["record_type"]) == (x.page_id, x.payload_digest, x.record_type)
    assert {(x.archive, x.offset, x.length) for x in records} == {
        (x.archive, x.places[i], x.places[i + 1]) for x in held for i in range(0, len(x.places), 2)
    }


def test_archives_are_frames_behind_a_dictionary(spark):
    df = spark.createDataFrame(page_rows()[:200], "page_id long, url string, html string").coalesce(1)
    [row] = warc.write_archives(df).collect()
    store, _ = fs.FileSystem.from_uri(row.folder)
    with store.open_input_file(row.archive) as file:
        data = file.read()
    assert row.bytes == len(data) and row.dictionary_bytes > 0
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    held = zstandard.ZstdCompressionDict(data[8 : 8 + row.dictionary_bytes])
    assert held.dict_id()
    frame = zstandard.get_frame_parameters(data[row.places[0] :])
    assert frame.dict_id == held.dict_id()
    with zstandard.ZstdDecompressor(dict_data=held).stream_reader(data[8 + row.dictionary_bytes :], read_across_frames=True) as whole:
        text = whole.read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.count(b"WARC-Type: response") == 200


def test_damaged_archives_are_noticed(spark):
    data = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "1970-01-01T00:00:00Z")
    assert warc.parsed(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parsed(data.replace(b"payload\r\n", b"qayload\r\n"))
    with pytest.raises(ValueError):
        warc.parsed(data[:-2])


def test_no_pages_no_archives(spark):
    manifest = warc.write_archives(spark.createDataFrame([], PAGES))
    assert manifest.count() == 0 and warc.read_digests(manifest).count() == 0


# Alignment

TEXTS = [
    "The quick brown fox", None, "", " ", "\n\t ", "a", "naïve café — déjà vu", "日本語のテキスト 😀 ​", "▁ mark", "x▁y", "<s> </s> <unk>",
    "<|endoftext|> plain", "<0x41> bytes", "tabs\tand\r\nlines\n\n\n", "\0 zero", "many  spaces   here", "ÀÉÎ ǅ ƒ", "same same same same",
    "The quick brown fox", "don't we'll 123456 7.5%", "a" * 3000, "word " * 4000,
]


def token_bytes():
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte = alignment.bytes_of_characters()

    def encode(text):
        a = tokenizer.encode(" " + text, add_special_tokens=False)
        b = model.encode(text)
        spelled = [model.id_to_piece(i) for i in b]
        return (
            [(i, bytes(byte[c] for c in t)) for i, t in zip(a.ids, a.tokens)],
            [(i, bytes([int(t[3:5], 16)]) if model.is_byte(i) else t.replace("▁", " ").encode()) for i, t in zip(b, spelled)],
        )

    return encode


def alignment_by_brute_force(rows):
    encode = token_bytes()
    plain, counts = [], Counter()
    for i, text in rows:
        a, b = encode(text) if text else ([], [])
        whole = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        groups, links = [], []
        left_a, left_b, end_a, end_b = list(a), list(b), 0, 0
        now = ([], [])
        while left_a or left_b:
            if end_a <= end_b:
                id, x = left_a.pop(0)
                now[0].append(id)
                end_a += len(x)
            else:
                id, x = left_b.pop(0)
                now[1].append(id)
                end_b += len(x)
            if end_a == end_b:
                links.append((now[0][-1], now[1][-1]))
                groups.append(now)
                now = ([], [])
        counts.update(links)
        plain.append((i, len(a), len(b), groups, links))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, n_a, n_b, groups, links in plain:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((
            i, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return sorted(out, key=str), [x[3] for x in plain]


@pytest.mark.parametrize("pairs,steps", [(alignment.TABLE_PAIRS, alignment.PIECE_STEPS), (10, 7), (0, 1)])
def test_alignment(spark, monkeypatch, pairs, steps):
    rows = [*enumerate(TEXTS), (None, "no id here"), (3, "repeated id"), (3, "repeated id")]
    expected, _ = alignment_by_brute_force(rows)
    assert sum(x[3] for x in expected) > 2000 and any(x[3] == 0 and rows[int(x[0] or 0)][1] for x in expected)
    monkeypatch.setattr(alignment.frequent, "__defaults__", (pairs,))
    monkeypatch.setattr(alignment.Aligned.__init__, "__defaults__", (steps,))
    df = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, id string, row int, links int")
    found = alignment.digests(df.repartition(3), BYTES, PIECES)
    assert sorted(map(tuple, found.collect()), key=str) == expected
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_groups_of_tokens(spark):
    rows = list(enumerate(TEXTS))
    _, groups = alignment_by_brute_force(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for x in alignment.align(df, BYTES, PIECES).collect():
        parts = [
            (x.a_ids[a:b], x.b_ids[c:d])
            for a, b, c, d in zip([0, *x.a_ends], x.a_ends, [0, *x.b_ends], x.b_ends)
        ]
        assert parts == [(list(a), list(b)) for a, b in groups[x.doc_id]]


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.digests(none, BYTES, PIECES).count() == 0 and alignment.align(none, BYTES, PIECES).count() == 0


@pytest.mark.parametrize("steps", [1, 2, 5, 64, 10_000])
def test_pieces_of_a_merge_do_equal_work_and_lose_no_end(steps):
    rng = np.random.default_rng(steps)
    a, b = np.cumsum(rng.integers(1, 4, 900)), np.cumsum(rng.integers(1, 7, 500))
    end = max(a[-1], b[-1]) + 1
    a, b = np.r_[a, end], np.r_[b, end]
    starts_a, starts_b = alignment.merge_path(a, b, steps)
    work = np.diff(starts_a + starts_b)
    assert (work[:-1] == steps).all() and work.sum() == len(a) + len(b)
    over_a, over_b = alignment.closings(a, b, steps)
    both = np.intersect1d(a, b)
    assert (a[over_a - 1] == both).all() and (b[over_b - 1] == both).all()
    covered = sum(
        int(alignment.piece_overlaps(a, b, *map(int, x))[2].sum())
        for x in zip(starts_a[:-1], starts_a[1:], starts_b[:-1], starts_b[1:])
    )
    assert covered == end


def test_the_fast_way_gives_the_ids_of_the_library():
    tokens = alignment.ByteTokens(BYTES)
    for point in range(1, ord(alignment.FAST_LAST) + 1):
        c = chr(point)
        for text in (f" a{c}b 1{c}2 .{c}. {c}{c} x", f" {c}", f" {c}'s \n{c}\n  {c}\t"):
            assert tokens.fast.encode_ordinary(text) == tokens.tokenizer.encode(text, add_special_tokens=False).ids, point


def test_new_queries_have_their_columns(spark):
    folder = "/root/testdata/sf0.001"
    assert registered.op13_alignment(spark, folder).count() == 200
    assert dict(registered.op12_warc(spark, folder).dtypes) == {
        "page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"
    }


def test_licences_behind_long_preambles(spark):
    def commented(text, width=9):
        parts = text.split()
        return "\n".join("# " + " ".join(parts[i : i + width]) for i in range(0, len(parts), width))

    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    notes = "\n".join(f"# {words(9)}" for _ in range(80))
    lines = "\n".join(f"Copyright 19{70 + i} Author {words(3)}" for i in range(12))
    paragraphs = "\n#\n".join(map(commented, (licence_headers.BSD_2, licence_headers.BSD_NAMES, licence_headers.BSD_REST)))
    texts = dict(licence_headers.whole_texts())
    rows = [
        ("BSD-3-Clause", "a.c", f"{notes}\n#\n# Copyright 1999 Somebody\n#\n{paragraphs}\n\nint x;\n{notes}"),
        ("BSD-3-Clause", "b.c", f"int x;\n\n{paragraphs}\n\n{words(3000)}"),
        *((name, f"{name}/LICENSE", f"{lines}\n\n{text}") for name, text in texts.items()), (None, "c.c", notes),
    ]
    data = [(i, path, text) for i, (_, path, text) in enumerate(rows)] + [(100 + i, f"x{i}", words(60)) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, path string, text string")
    found = {r.doc_id: r.own_licence for r in licences.licences(df).collect()}
    assert [found[i] for i in range(len(rows))] == [name for name, *_ in rows]


@pytest.mark.parametrize("lower", [False, True])
def test_words_are_hashed_together_as_the_library_hashes_each(monkeypatch, lower):
    rng, spaces = np.random.default_rng(3), b"\x20\x09\x0a\x0b\x0c\x0d"
    letters = [x for x in range(256) if x not in spaces]
    words = [bytes(rng.choice(letters, 1 + i % 40).tolist()) for i in range(2000)]
    texts = [bytes([spaces[i % 6]]).join(words[i : i + 7]) for i in range(0, 2000, 7)]
    texts += [b"", b" \t", b"a", b"\n" + b"X" * 300 + b"  " + b"y" * 17, b""]
    digest, asked = xxhash.xxh3_64_intdigest, []
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda word: asked.append(len(word)) or digest(word))
    hashes, starts = common.hashed_words(texts, lower)
    split = [(x.lower() if lower else x).split() for x in texts]
    assert hashes.tolist() == [digest(word) for text in split for word in text]
    assert starts.tolist() == np.cumsum([0, *map(len, split)]).tolist()
    assert min(asked) > 16  # no call for each of the other words
    for none in ([], [b""], [b" ", b""]):
        hashes, starts = common.hashed_words(none, lower)
        assert not len(hashes) and starts.tolist() == [0] * (len(none) + 1)


@pytest.mark.parametrize("above", [np.greater, np.greater_equal])
def test_the_nearest_smaller_place_before(above):
    rng = np.random.default_rng(5)
    for case in range(60):
        values = rng.integers(0, [3, 40, 10**9][case % 3], 1 + 5 * case).astype(np.uint64)
        texts = np.sort(rng.integers(0, 1 + case % 4, len(values)))
        if case % 7 == 0:
            values = np.sort(values)[::-1].copy()
        wanted = [
            max((j for j in range(i) if texts[j] == texts[i] and not above(values[j], values[i])), default=-1)
            for i in range(len(values))
        ]
        assert substring._smaller_before(values, texts, above).tolist() == wanted


def test_each_token_has_the_partner_nearest_to_the_usual_offset():
    rng = np.random.default_rng(6)
    for case in range(90):
        kinds = [4, 30, 10**6][case % 3]
        other = rng.integers(0, kinds, 1 + int(rng.integers(80))).astype(np.uint64)
        tokens = np.r_[rng.integers(0, kinds, 9).astype(np.uint64), other[len(other) // 3 :]]
        offset = int(rng.integers(-20, 20))
        places = [np.flatnonzero(other == x) for x in tokens]
        single = [p[0] - i for i, p in enumerate(places) if len(p) == 1]
        usual = int(np.median(single)) if single else offset
        matched, partner = substring._partners(tokens, other, offset)
        assert matched.tolist() == [i for i, p in enumerate(places) if len(p)]
        for i, j in zip(matched, partner):
            aim = min(max(i + usual, 0), len(other))
            assert abs(j - aim) == min(abs(places[i] - aim)) and j in places[i]

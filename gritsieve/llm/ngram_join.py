"""Exact Jaccard join of word n-gram sets, as groups of linked documents.

1. Every document's set is cut into segments by hash. The number of segments belongs to
   a band of set sizes and exceeds the largest difference that two linked sets of the
   band can have by more than the segments that may be empty, so linked sets share a
   whole segment that is not. Identical sets of one batch are one row, and a segment that
   several rows of a batch share goes through the shuffle once.
2. The document with the smallest id of a segment is its hub, and a cluster of candidates
   is a hub with all documents that share a segment of which it is the hub. A document may
   be in several. Clusters are not put together where they meet: segments of a frequent line
   alone would tie half of all documents to one cluster, whose pairs grow with its square.
3. Clusters are dealt out as tiles: the whole cluster, or for a large one pairs of
   blocks of neighbouring size bands. Hashed parity bitmaps bound the overlap of two sets
   from above (each element in one set alone flips one bit). Tiles first get the bitmaps
   alone, about a thirtieth of the sets; what pairs within the bound connect are closer
   clusters, of which a document is in one at most.
4. Tiles of these get the sets, and pairs that pass their bitmaps are intersected exactly.
   Pairs that the tile already connects are skipped, so a tile gives fewer edges than it
   has sets.
5. Components of the edges are the groups.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import (
    by_rows, components, local_hubs, mix, shingle_sets, signed, slices, stage, table, texts_of,
)

TILE_SHINGLES = 64_000  # shingles of a block: 0.5 MB
BITMAP_SHINGLES = 1_000_000  # shingles of a block of bitmaps: 250 to 500 kB
HELD_KEYS = 600_000  # keys of sets that are compared before the shuffle: 5 MB
KEY_ROWS = 16  # rows of a key that go through the shuffle from one part
BROADCAST_IDS = 2_000_000  # ids of candidates that may be broadcast: 16 MB


def bands(percent: int, largest: int) -> np.ndarray:
    """First sizes of the bands; each band spans about two links of the threshold."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, int(starts[-1] * (100 / percent) ** 2)))
    return np.array(starts, np.int64)


@functools.lru_cache(maxsize=None)  # an entry for each band
def _segments(start: int, end: int, percent: int) -> tuple[int, int]:
    """Number of segments of a band of sizes, and how many at least linked sets share.

    They share two, of which both may be empty, or more than the smallest sets have
    empty ones, as far as chance goes: what gives fewer keys. (0, 0): linked sets of the
    band are identical.
    """
    total = end - 1 + (end - 1) * 100 // percent  # the smaller of a pair is in the band
    difference = (100 - percent) * total // (100 + percent)
    if not difference:
        return 0, 0

    def empty(count: int) -> float:
        return count * math.exp(-start / count)

    plain = difference + 2
    spare = 2
    while (wanted := int(empty(difference + spare) + 4 * math.sqrt(empty(difference + spare))) + 2) > spare:
        if difference + wanted > end:
            return plain, 2
        spare = wanted
    keys = difference + spare - empty(difference + spare)
    pairs = plain - empty(plain) + empty(plain) ** 2 / 2
    return (difference + spare, spare) if keys < pairs else (plain, 2)


def _segment_keys(members: np.ndarray, band: int, starts: np.ndarray, percent: int) -> np.ndarray:
    """Keys of one set in one band: of its filled segments, and for what empty ones share."""
    count, shared = _segments(int(starts[band]), int(starts[band + 1]), percent)
    if not count:
        return np.empty(0, np.uint64)
    segment = (members % np.uint64(count)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    filled, first = np.unique(segment[order], return_index=True)
    sums = np.add.reduceat(mix(members[order], 7), first)
    keys = mix(sums + mix(filled.astype(np.uint64) + np.uint64(band << 32), 11), 13)
    if count - len(filled) < shared:  # one of those shared is filled
        return keys
    if shared > 2:  # a rare set, which has a key with all others of its band that are
        return np.r_[keys, mix(np.array([band], np.uint64), 19)]
    a, b = np.triu_indices(count - len(filled), 1)
    empty = np.setdiff1d(np.arange(count), filled)
    pair = (empty[a] * count + empty[b]).astype(np.uint64) + np.uint64(band << 40)
    return np.r_[keys, mix(pair, 17)]


def _set_rows(width: int, schema: pa.Schema) -> Callable:
    """Sizes and digests of sets."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(texts_of(batch, "text"), width)
            digests = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            yield table({"id": batch.column("id"), "n_shingles": [len(x) for x in sets], "digest": digests}, schema)

    return make


def _key_rows(width: int, percent: int, schema: pa.Schema) -> Callable:
    """(key, id): a segment's ids among about HELD_KEYS keys, or if it has over KEY_ROWS of them
    the smallest one, and (id, hub) for the others. Sets are made and compared in one Python process, of which few may run."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = bands(percent, 1 << 12)
        ids, digests, keys, held = [], [], [], 0
        for batch in slices(batches, "text"):
            sets = shingle_sets(texts_of(batch, "text"), width)
            for id_, members in zip(batch.column("id").to_pylist(), sets):
                size = len(members)
                if not size:
                    continue
                if size >= starts[-2]:
                    starts = bands(percent, 2 * size)
                band = int(np.searchsorted(starts, size, "right")) - 1
                own = _segment_keys(members, band, starts, percent)
                if band and percent * size <= 100 * (int(starts[band]) - 1):
                    own = np.r_[own, _segment_keys(members, band - 1, starts, percent)]
                if not len(own):
                    continue
                ids.append(id_)
                digests.append(xxhash.xxh3_128_digest(members.tobytes()))
                keys.append(signed(own))
                held += len(own)
            del sets
            if held > HELD_KEYS:
                yield from by_rows(_first_of_each(ids, digests, keys, schema))
                ids, digests, keys, held = [], [], [], 0
        if held:
            yield from by_rows(_first_of_each(ids, digests, keys, schema))

    return make


def _first_of_each(ids: list[int], digests: list[bytes], lists: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    ids = np.array(ids, np.int64)
    _, classes = np.unique(np.array(digests, "S16"), return_inverse=True)
    rows, hubs = local_hubs(classes, ids)
    alone = np.sort(rows[rows == hubs])
    keys = np.concatenate([lists[i] for i in alone])
    owner = np.repeat(ids[alone], [len(lists[i]) for i in alone])
    rows, hubs = local_hubs(keys, owner)
    opens = np.flatnonzero(rows == hubs)
    counts = np.diff(np.r_[opens, len(rows)])
    is_hub = (owner[rows] == owner[hubs]) | np.repeat(counts <= KEY_ROWS, counts)
    tied = np.unique(np.c_[owner[rows], owner[hubs]][~is_hub], axis=0)
    local = signed(mix(tied[:, 0].astype(np.uint64) + mix(tied[:, 1].astype(np.uint64)), 19))
    firsts = rows[is_hub]
    return table({
        "key": np.r_[keys[firsts], local],
        "id": np.r_[owner[firsts], tied[:, 0]],
        "hub": pa.array(
            np.r_[np.zeros(len(firsts), np.int64), tied[:, 1]],
            mask=np.r_[np.ones(len(firsts), bool), np.zeros(len(tied), bool)],
        ),
    }, schema)


def _arrays(width: int, schema: pa.Schema) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(texts_of(batch, "text"), width)
            yield table({
                "id": batch.column("id"),
                "digest": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets],
                "members": [x.tobytes() for x in sets],
            }, schema)

    return make


def _bitmaps(sets: list[np.ndarray], words: int) -> np.ndarray:
    """Parity bitmaps: a bit is the number of elements hashed to it, modulo two."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    spot = mix(np.concatenate(sets), 23) % np.uint64(64 * words)
    maps = np.zeros((len(sets), words), np.uint64)
    np.bitwise_xor.at(maps, (owner, (spot >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (spot & np.uint64(63)))
    return maps


def _bitmap_rows(width: int, schema: pa.Schema) -> Callable:
    """A bitmap for each set, of two to four bits an element and a power of two."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(texts_of(batch, "text"), width)
            yield table({
                "id": batch.column("id"),
                "digest": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets],
                "bitmap": [_bitmaps([x], 1 << (len(x) // 32).bit_length()).tobytes() for x in sets],
            }, schema)

    return make


def _passes(apart: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets whose bitmaps have so many bits apart may be linked: the overlap is
    (both - apart) / 2 at most, and a link needs (100 + percent) overlap >= percent both."""
    return (100 + percent) * ((both - apart) // 2) >= percent * both


def near_in_tile(
    ids: np.ndarray, sizes: np.ndarray, bitmaps: list[bytes], blocks: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """Edges that connect, within the tile, what pairs within the bitmaps' bound connect.

    Bitmaps are folded to the length of the smaller set's. blocks: as in links_of_tile.
    """
    order = np.lexsort((ids, sizes))
    ids, sizes, blocks = ids[order], sizes[order], blocks[order]
    maps = [np.frombuffer(bitmaps[i], np.uint64) for i in order]
    words = np.array([len(x) for x in maps])  # grow with the sizes
    group, one_block = np.arange(len(ids)), len(np.unique(blocks)) < 2
    found = []
    for length in np.unique(words):
        first, last = np.searchsorted(words, length), np.searchsorted(words, length, "right")
        end = np.searchsorted(sizes, 100 * sizes[last - 1] // percent, "right")
        folded = np.array([np.bitwise_xor.reduce(x.reshape(-1, length), axis=0) for x in maps[first:end]])
        for i in range(first, last):
            near = np.arange(i + 1, np.searchsorted(sizes, 100 * sizes[i] // percent, "right"))
            near = near[group[near] != group[i]]
            if not one_block:
                near = near[blocks[near] != blocks[i]]
            if not len(near):
                continue
            apart = np.bitwise_count(folded[near - first] ^ folded[i - first]).sum(axis=1, dtype=np.int64)
            for j in near[_passes(apart, sizes[near] + sizes[i], percent)]:
                if group[i] != group[j]:
                    found.append((int(ids[i]), int(ids[j])))
                    group[group == group[j]] = group[i]
    return found


def links_of_tile(
    ids: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """Edges that connect, within the tile, what its links connect.

    blocks: 0 or 1 for a pair of different blocks, of which only pairs across are due;
    the same for all rows of a tile that is one block.
    """
    sizes = np.array([len(x) for x in sets])
    order = np.lexsort((ids, sizes))
    ids, sizes, blocks, sets = ids[order], sizes[order], blocks[order], [sets[i] for i in order]
    maps, group = _bitmaps(sets, max(1, -(-int(sizes[-1]) // 64))), np.arange(len(sets))
    one_block = len(np.unique(blocks)) < 2
    found = []
    for i in range(len(sets) - 1):
        end = np.searchsorted(sizes, 100 * sizes[i] // percent, "right")
        near = np.arange(i + 1, end)
        near = near[group[near] != group[i]]
        if not one_block:
            near = near[blocks[near] != blocks[i]]
        if not len(near):
            continue
        apart = np.bitwise_count(maps[near] ^ maps[i]).sum(axis=1, dtype=np.int64)
        for j in near[_passes(apart, sizes[near] + sizes[i], percent)]:
            if group[i] == group[j]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= percent * (sizes[i] + sizes[j] - shared):
                found.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return found


def _tile_links(percent: int, schema: pa.Schema) -> Callable:
    def make(tile: pa.Table) -> pa.Table:
        edges = links_of_tile(
            tile.column("id").to_numpy(),
            [np.frombuffer(x, np.uint64) for x in tile.column("members").to_pylist()],
            tile.column("block").to_numpy(),
            percent,
        )
        return pa.table({"a": [a for a, _ in edges], "b": [b for _, b in edges]}, schema=schema)

    return make


def _near(percent: int, schema: pa.Schema) -> Callable:
    def make(tile: pa.Table) -> pa.Table:
        edges = near_in_tile(
            *(tile.column(x).to_numpy() for x in ("id", "n_shingles")), tile.column("bitmap").to_pylist(),
            tile.column("block").to_numpy(), percent,
        )
        return pa.table({"a": [a for a, _ in edges], "b": [b for _, b in edges]}, schema=schema)

    return make


def _tiles(members: DataFrame, shingles: int, percent: int) -> DataFrame:
    """A row for each tile a set is in: the whole cluster, or pairs of its blocks.

    Sizes of linked sets are within 100 / percent, so their bands are equal or neighbours.
    """
    ratio = 1.25 if percent >= 80 else 101 / percent
    members = members.withColumn("size_band", F.expr(f"int(ln(n_shingles) / ln({ratio}D))"))
    weights = members.groupBy("cluster", "size_band").agg(F.sum("n_shingles").alias("weight"))
    # bands of a cluster are few: log(largest set) / log(ratio)
    lists = weights.groupBy("cluster").agg(
        F.sum("weight").alias("weight"),
        F.map_from_entries(F.collect_list(F.struct("size_band", F.expr(f"int(weight / {shingles}) + 1")))).alias("blocks"),
    )
    placed = members.join(lists, "cluster").selectExpr(
        "*", f"weight <= {shingles} AS small", "pmod(xxhash64(id), blocks[size_band]) AS own"
    )
    spots = """
        IF(small, array(struct(-1 AS lower, 0 AS upper, 0L AS x, 0L AS y, 0 AS block)), concat(
          transform(sequence(0, blocks[size_band] - 1), k -> struct(size_band AS lower,
            size_band AS upper, least(own, bigint(k)) AS x, greatest(own, bigint(k)) AS y, int(own > k) AS block)),
          IF(blocks[size_band + 1] IS NULL, array(), transform(sequence(0, blocks[size_band + 1] - 1),
            k -> struct(size_band AS lower, size_band + 1 AS upper, own AS x, bigint(k) AS y, 0 AS block))),
          IF(blocks[size_band - 1] IS NULL, array(), transform(sequence(0, blocks[size_band - 1] - 1),
            k -> struct(size_band - 1 AS lower, size_band AS upper, bigint(k) AS x, own AS y, 1 AS block)))))
    """
    return placed.withColumn("spot", F.explode(F.expr(spots))).select(
        "id", "digest", "n_shingles", "cluster", "spot.lower", "spot.upper", "spot.x", "spot.y", "spot.block"
    )


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with these ids, which are broadcast if they are few."""
    wanted = stage(ids.distinct())
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "id", "left_semi")


def _shared_keys(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) from each set to the smallest id that has one of its keys: over all
    parts, or within its part (local) if this has many sets with the key.

    A key has few rows for each task.
    """
    fields = [("key", pa.int64()), ("id", pa.int64()), ("hub", pa.int64())]
    shared = texts.where("id IS NOT NULL").mapInArrow(
        _key_rows(width, percent, pa.schema(fields)), "key long, id long, hub long"
    )
    return shared.selectExpr(
        "id AS a", "coalesce(hub, min(id) OVER (PARTITION BY key)) AS b", "hub IS NOT NULL AS local"
    ).where("a <> b").distinct()


def _clusters(edges: DataFrame) -> DataFrame:
    """(cluster, node): each hub with the sets that have one of its keys, and itself.

    Where a part has many sets with a key, they are tied to the first of the part, and this
    to the hub of all parts; so the hubs of the first are hubs of these sets as well.
    """
    edges = stage(edges)
    first, over = edges.where("local"), edges.where("NOT local").select(F.col("a").alias("b"), F.col("b").alias("cluster"))
    return (
        edges.selectExpr("b AS cluster", "a AS node")
        .unionByName(edges.selectExpr("b AS cluster", "b AS node"))
        .unionByName(first.join(over, "b").selectExpr("cluster", "a AS node"))
        .distinct()
    )


def ngram_groups(
    df: DataFrame, text: str = "text", id: str = "doc_id", width: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id.

    Two documents are linked when 100 * shared >= percent * union of their sets of
    distinct runs of ``width`` words (lower-cased A-Z; fewer words are one run).
    component_id is the smallest id that links reach. Empty and null texts have no
    runs and are linked with nothing; rows with a null id have a null component_id.
    Repeated rows with one id get the same result, each from its own text. Other columns
    are ignored; an empty table gives no rows.

    Sets are made anew for their keys, for their sizes and for the tiles: reading a text
    again takes less than keeping its set on disk.
    """
    base = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    fields = [("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary())]
    sets = stage(base.mapInArrow(_set_rows(width, pa.schema(fields)), "id long, n_shingles long, digest binary"))
    named = sets.where("id IS NOT NULL AND n_shingles > 0")
    firsts = named.groupBy("digest").agg(F.min("id").alias("first"))
    # one row for each different set of a cluster, with the first id that has the set
    clusters = _clusters(_shared_keys(base, width, percent))
    candidates = clusters.join(named.select("id", "digest", "n_shingles"), F.col("id") == F.col("node"))
    members = stage(
        candidates.select("cluster", "digest", "n_shingles").distinct()
        .join(firsts.withColumnRenamed("first", "id"), "digest")
    )
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    named_texts = base.where("id IS NOT NULL")

    def tiled(rows: DataFrame, shingles: int, make: Callable, column: str, find: Callable) -> DataFrame:
        schema = pa.schema([("id", pa.int64()), ("digest", pa.binary()), (column, pa.binary())])
        made = _only(named_texts, rows.select("id")).mapInArrow(
            make(width, schema), f"id long, digest binary, {column} binary"
        )
        tiles = _tiles(rows, shingles, percent).join(made.dropDuplicates(["id", "digest"]), ["id", "digest"])
        return tiles.groupBy("cluster", "lower", "upper", "x", "y").applyInArrow(find(percent, edge), "a long, b long")

    near = components(tiled(members, BITMAP_SHINGLES, _bitmap_rows, "bitmap", _near))
    every = members.select("id", "digest", "n_shingles").distinct()
    closer = stage(every.join(near.withColumnRenamed("component", "cluster"), F.col("id") == F.col("node")).drop("node"))
    links = tiled(closer, TILE_SHINGLES, _arrays, "members", _tile_links)
    groups = components(links)
    classes = firsts.join(groups, F.col("first") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "first").alias("component_id")
    )
    linked = named.select("id", "n_shingles", "digest").join(classes, "digest", "left")
    alone = sets.where("id IS NULL OR n_shingles = 0").withColumn("component_id", F.col("id"))
    columns = [F.col("id").alias(id), "n_shingles", "component_id"]
    return linked.select(*columns).unionByName(alone.select(*columns))


def drop_near_copies(
    df: DataFrame, text: str = "text", id: str = "doc_id", width: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of df without those that are linked, through others or directly, to a
    smaller id. Rows with a null id stay.

    Different texts of one id are judged each by itself; of linked ones of one id, the one
    with the smallest hash stays. Equal rows stay or go together.
    """
    key, version = F.col(id).cast("long"), F.xxhash64(F.col(text).cast("string"))
    spread = df.groupBy(key.alias("id")).agg(F.min(version).alias("low"), F.max(version).alias("high"))
    several = stage(spread.where("id IS NOT NULL AND low < high").select("id"))
    name = _unused("gone", df)
    if several.isEmpty():
        groups = ngram_groups(df, text, id, width, percent)
        gone = groups.where(f"component_id <> `{id}`").select(F.col(id).alias(name)).distinct()
        return df.join(gone, key == F.col(name), "left_anti")
    # texts of an id that has several are told apart by numbers of their own
    texts = df.select(key.alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL")
    other = several.withColumn("several", F.lit(True))
    numbered = texts.join(other, "id", "left").withColumn("version", F.xxhash64("text")).withColumn(
        "node", F.expr("IF(several, -1 - (xxhash64(id, version) & 4611686018427387903), id)")
    )
    groups = ngram_groups(numbered, "text", "node", width, percent).distinct()
    nodes = numbered.select("node", "id", "version").distinct()
    placed = stage(nodes.join(groups, "node").select("component_id", "id", "version"))
    stays = placed.groupBy("component_id").agg(F.min(F.struct("id", "version")).alias("stays"))
    gone = placed.join(stays, "component_id").where("struct(id, version) <> stays")
    gone = gone.select(F.struct("id", "version").alias(name))
    return df.join(gone, F.struct(key.alias("id"), version.alias("version")) == F.col(name), "left_anti")


def _unused(name: str, df: DataFrame) -> str:
    taken = {x.lower() for x in df.columns}
    while name in taken:
        name += "_"
    return name

"""Passages that repeat across documents, exactly or nearly, by compact windows.

0. Of equal texts only the one with the smallest id goes on; the others are spans of it.
1. A token is a run of WIDTH words. For each hash function, the token at c has the
   smallest hash in every passage within [left, right] that contains c: a compact window.
   Windows that hold a passage of the least length are the top of the Cartesian tree over
   the hashes; their centres are the sliding minima.
2. Windows with the same centre token and function share a signature. Each occurrence is
   tied to the first one (smallest id and place), and to the first one that reaches about
   as far: at first within its batch, so that few rows of a signature per batch go through
   the shuffle, then over all batches. No signature is of two functions, so they are dealt
   with AT_ONCE at a time, and the shuffle of the ones before has gone by then.
3. For each pair of documents, intervals that overlap are joined; they need the agreement
   of ENOUGH functions.
4. The words of what remains are compared: spans of at least ``least`` words on both sides
   whose token sets have the wanted similarity.
5. The first document of a signature may have its token only, not the passage around it (a
   frequent line). So windows of the least length whose centres all occur elsewhere, and
   which no comparison has covered, go round again under a hash of all their words, with
   those of other documents whose centres all do: the first document with that hash does
   have them. No exact repeat is left after that.

A passage stays in the document with the smallest id.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritsieve.llm.common import by_rows, hashed_words, local_hubs, mix, rolled, signed, slices, stage, table, texts_of

WIDTH = 5
FUNCTIONS, ENOUGH = 8, 2
AT_ONCE = 4  # functions whose windows are in one shuffle
GAP = 12  # tokens without a match that a span may bridge
SLACK = 12  # tokens around an interval that are compared as well
BROADCAST_IDS = 2_000_000  # 16 MB
LISTED = 1000  # intervals of one document, about, that are cut out of its text at a time
WORD = regex.compile(rb"[^\x20\x09-\x0D]+")


def sliding_centres(hashes: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Places with the smallest hash (the leftmost of equal ones) in some valid window.

    valid: for each place, whether the window of that length that begins there counts.
    """
    count = len(hashes)
    if count < length or not valid.any():
        return np.empty(0, np.int64)
    bits = np.uint64(max(20, count.bit_length()))
    placed = (hashes >> bits << bits) | np.arange(count, dtype=np.uint64)
    padded = np.full(-(-count // length) * length, 2**64 - 1, np.uint64)
    padded[:count] = placed
    blocks = padded.reshape(-1, length)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.flatnonzero(valid[: count - length + 1])
    least = np.minimum(behind[starts], ahead[starts + length - 1])
    places = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # never go back
    return places[np.r_[True, places[1:] != places[:-1]]]


def compact_windows(
    hashes: np.ndarray, first: np.ndarray, last: np.ndarray, centres: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """How far each centre's window reaches to the left and to the right.

    first and last: the bounds of each centre's text. Ancestors of a long window in the
    Cartesian tree are longer still, so the tree of the centres alone gives the bounds.
    """
    if not len(centres):
        return centres, centres
    values, order = hashes[centres], np.arange(len(centres))
    before = _smaller_before(values, first, np.greater)
    after = order[::-1] - _smaller_before(values[::-1], first[::-1], np.greater_equal)[::-1]
    after += order  # from the end, counted backwards
    left = np.where(before < 0, first, centres[before] + 1)
    right = np.where(after > order[-1], last, centres[np.minimum(after, order[-1])] - 1)
    return centres - left, right - centres


def _smaller_before(values: np.ndarray, texts: np.ndarray, above: Callable) -> np.ndarray:
    """For each place the nearest one before it, of the same text, whose value is not above
    its own, or -1. texts: equal for places of one text, which stand together.

    All values between a place and what is found for it so far are above its own, so a
    search may go on from a place that is above to what is found for that one.
    """
    found = np.arange(-1, len(values) - 1)
    todo = np.arange(len(values))
    while len(todo):
        spot = found[todo]
        inside = (spot >= 0) & (texts[spot] == texts[todo])
        found[todo[~inside]] = -1
        todo, spot = todo[inside], spot[inside]
        goes_on = above(values[spot], values[todo])
        todo = todo[goes_on]
        found[todo] = found[spot[goes_on]]
    return found


def windows(texts: list[bytes], length: int, functions: range = range(FUNCTIONS)) -> dict[str, np.ndarray]:
    """All compact windows of all texts by these functions: key, text, place (token *
    FUNCTIONS + function) and reach (left in the upper 32 bits, right in the lower)."""
    words, starts = hashed_words(texts)
    tokens = rolled(words, WIDTH)
    begin, end = starts[:-1], np.maximum(starts[1:] - WIDTH + 1, starts[:-1])
    valid = np.zeros(len(tokens) + 1, np.int64)
    some = end - begin >= length
    np.add.at(valid, begin[some], 1)
    np.add.at(valid, end[some] - length + 1, -1)
    valid = np.cumsum(valid)[:-1] > 0
    found: dict[str, list] = {"key": [], "text": [], "place": [], "reach": []}
    for function in functions:
        hashes = mix(tokens, 100 + function)
        centres = sliding_centres(hashes, valid, length)
        text = np.searchsorted(starts, centres, "right") - 1
        left, right = compact_windows(hashes, begin[text], end[text] - 1, centres)
        found["key"].append(signed(hashes[centres]))
        found["text"].append(text)
        found["place"].append((centres - begin[text]) * FUNCTIONS + function)
        found["reach"].append(left << 32 | right)
    return {name: np.concatenate(parts) for name, parts in found.items()}


OCCURRENCE = ("id", "place", "reach")
ALSO = pa.list_(pa.struct([("place", pa.int64()), ("reach", pa.int64())]))
SIGNATURES = pa.schema([
    *((x, pa.int64()) for x in ("key", "meet", "company", *OCCURRENCE, "hub_id", "hub_place", "hub_reach")),
    ("also", ALSO),
])
#: Windows of about the same reach to either side, as copies have them, are of one class.
CLASS = "int(log2((reach >> 32) + 1)) * 64 + int(log2((reach & 4294967295) + 1))"


def _classes(reach: np.ndarray) -> np.ndarray:
    left, right = reach >> 32, reach & 0xFFFFFFFF
    return (np.log2(left + 1).astype(np.int64) << 6) + np.log2(right + 1).astype(np.int64)


def _signatures(length: int, functions: range) -> Callable:
    """The first window of each key and class of a batch, and the ties of all others.

    Classes are at most a few hundred, so a key has a bounded number of rows per batch.
    Windows of the same document as the first one are listed in its row (also) and get
    the hub that it gets. company: whether the batch has the key in several documents.
    meet: the key, by which rows of all batches meet; scattered for a row that is tied.
    """

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = windows(texts_of(batch, "text"), length, functions)
            own_ids = batch.column("id").to_numpy(zero_copy_only=False)
            ids = found["id"] = own_ids[found["text"]]
            # id and place as one number, to sort by
            spot = np.unique(own_ids, return_inverse=True)[1][found["text"]].astype(np.int64) << 40 | found["place"]
            kind = (found["key"] ^ signed(mix(_classes(found["reach"]).astype(np.uint64), 43)))
            rows, hubs = local_hubs(kind, spot)
            firsts = rows[rows == hubs]
            ties = [(rows[rows != hubs], hubs[rows != hubs])]
            own = (rows != hubs) & (ids[rows] == ids[hubs])
            repeats = rows[own]  # in the order of their firsts
            counts = np.zeros(len(ids), np.int64)
            np.add.at(counts, hubs[own], 1)
            rows, hubs = local_hubs(found["key"], spot)
            ties.append((rows[rows != hubs], hubs[rows != hubs]))
            company = np.zeros(len(ids), bool)
            company[hubs[ids[rows] != ids[hubs]]] = True
            company[rows] = company[hubs]
            rows, hubs = (np.concatenate(x) for x in zip(*ties))
            apart = ids[rows] != ids[hubs]
            tied = np.unique(rows[apart] * len(ids) + hubs[apart])
            rows, hubs = tied // max(1, len(ids)), tied % max(1, len(ids))
            # a row that is tied already needs no company, so its key is just scattered
            spread = found["key"][rows].view(np.uint64) ^ mix((ids[rows] ^ ids[hubs] << 1).view(np.uint64), 41)
            columns = {
                "key": np.r_[found["key"][firsts], found["key"][rows]],
                "meet": np.r_[found["key"][firsts], signed(mix(spread, 47))],
                "company": np.r_[company[firsts], np.ones(len(rows), bool)].astype(np.int64),
            }
            mask = np.r_[np.ones(len(firsts), bool), np.zeros(len(rows), bool)]
            for name in OCCURRENCE:
                columns[name] = np.r_[found[name][firsts], found[name][rows]]
                columns[f"hub_{name}"] = pa.array(
                    np.r_[np.zeros(len(firsts), np.int64), found[name][hubs]], mask=mask
                )
            ends = np.r_[0, np.cumsum(np.r_[counts[firsts], np.zeros(len(rows), np.int64)])]
            listed = pa.StructArray.from_arrays([found["place"][repeats], found["reach"][repeats]], ["place", "reach"])
            none = pa.array(np.diff(ends) == 0)
            columns["also"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed, mask=none)
            yield from by_rows(table(columns, SIGNATURES))

    return make


def _partners(tokens: np.ndarray, other: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that the other side has too, and for each its place there: of several, the
    one nearest to the usual offset, which tokens with a single place there tell."""
    order = np.argsort(other, kind="stable")
    ordered = other[order]
    opens = _changes(ordered)
    first = opens.nonzero()[0]
    kinds, kind = ordered[first], opens.cumsum() - 1
    spot = np.minimum(kinds.searchsorted(tokens), len(kinds) - 1)
    matched = (kinds[spot] == tokens).nonzero()[0]
    wanted = spot[matched]
    at = first[wanted]
    usual = order[at] - matched
    ends = np.empty(len(first), np.int64)
    ends[:-1], ends[-1] = first[1:], len(other)
    single = ends[wanted] - at == 1
    if single.all():
        return matched, order[at]
    if single.any():
        usual = np.sort(usual[single])
        offset = int((usual[(len(usual) - 1) // 2] + usual[len(usual) // 2]) / 2)  # the median
    width = len(other) + 1
    places = kind * width + order
    target = wanted * width + np.clip(matched + offset, 0, len(other))
    after = np.minimum(places.searchsorted(target), len(places) - 1)
    before = np.maximum(after - 1, 0)
    far_before, far_after = np.abs(places[before] - target), np.abs(places[after] - target)
    far_before[kind[before] != wanted] = 2 * width * width
    far_after[kind[after] != wanted] = 2 * width * width
    return matched, np.where(far_before < far_after, order[before], order[after])


def _changes(ordered: np.ndarray) -> np.ndarray:
    """Whether each value, of one at least, is the first or another than the one before it."""
    opens = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=opens[1:])
    return opens


def _distinct(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    return ordered[_changes(ordered)]


def _token_spans(
    tokens: np.ndarray, other: np.ndarray, offset: int, least: int, percent: int
) -> list[tuple]:
    """(start, end, other start, other end, similarity) of matching spans of tokens."""
    begin, stop = max(0, -offset), min(len(tokens), len(other) - offset)
    if stop - begin >= least:  # most are one run of equal tokens, with nothing else in common
        same = tokens[begin:stop] == other[begin + offset : stop + offset]
        count = np.count_nonzero(same)
        if count >= least:
            s, e = begin + int(same.argmax()), stop - int(same[::-1].argmax())
            if e - s == count and (
                count == len(tokens) or not np.isin(np.concatenate((tokens[:s], tokens[e:])), other).any()
            ):
                return [(s, e, s + offset, e + offset, 1.0)]
    matched, partner = _partners(tokens, other, offset)
    if not len(matched):
        return []
    steps, shift = matched[1:] - matched[:-1], partner - matched
    shifts = np.abs(shift[1:] - shift[:-1])
    cuts = [0, *(((steps > GAP) | (shifts > GAP)).nonzero()[0] + 1).tolist(), len(matched)]
    work = [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b - a >= 1]
    found = []
    while work:
        a, b = work.pop()
        if b - a < 1:
            continue
        s, e = matched[a], matched[b - 1] + 1
        if e - s < least:
            continue
        os, oe = partner[a:b].min(), partner[a:b].max() + 1
        if oe - os < least:
            continue
        mine, its = _distinct(tokens[s:e]), _distinct(other[os:oe])
        both = np.sort(np.concatenate((mine, its)))
        shared = np.count_nonzero(both[1:] == both[:-1])
        union = len(mine) + len(its) - shared
        if 100 * shared >= percent * union:
            found.append((int(s), int(e), int(os), int(oe), shared / union))
            continue
        skipped = steps[a : b - 1] - 1 + shifts[a : b - 1]
        if skipped.any():
            cut = a + int(np.argmax(skipped)) + 1
            work += [(a, cut), (cut, b)]
    return sorted(found)


PART = "pair long, id long, base long, first long, version long, words binary"
PART_FIELDS = pa.schema([
    ("pair", pa.int64()), ("id", pa.int64()), ("base", pa.int64()), ("first", pa.int64()), ("version", pa.int64()), ("words", pa.binary()),
])


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each wanted interval, lower-cased."""
    for batch in slices(batches, "text"):
        out: list[tuple] = []
        rows = zip(
            batch.column("id").to_pylist(), batch.column("version").to_pylist(), texts_of(batch, "text"),
            batch.column("wanted").to_pylist(),
        )
        for id_, version, text, wanted in rows:
            words = text.lower().split()
            for w in wanted:
                lo = max(0, w["lo"] - SLACK)
                out.append((w["pair"], id_, lo, w["lo"], version, b" ".join(words[lo : w["hi"] + WIDTH + SLACK])))
        if out:
            yield table(dict(zip(PART_FIELDS.names, zip(*out))), PART_FIELDS)


SPANS = pa.schema([
    ("id", pa.int64()), ("version", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
    ("match_id", pa.int64()), ("match_version", pa.int64()), ("match_start", pa.int64()), ("match_end", pa.int64()),
    ("similarity", pa.float64()),
])
SPAN = (
    "id long, version long, start long, end long, match_id long, match_version long,"
    " match_start long, match_end long, similarity double"
)


def _compared(least: int, percent: int) -> Callable:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words"):
            out: list[tuple] = []
            both = batch.column("words").to_pylist() + batch.column("hub_words").to_pylist()
            words, starts = hashed_words(both, lower=False)
            tokens, sizes, count = rolled(words, WIDTH), np.diff(starts), batch.num_rows
            del both, words
            numbers = [x for x in batch.schema.names if not x.endswith("words")]
            for i, row in enumerate(batch.select(numbers).to_pylist()):
                if min(sizes[i], sizes[count + i]) < least:
                    continue
                mine, its = (tokens[starts[k] : starts[k + 1] - WIDTH + 1] for k in (i, count + i))
                offset = row["hub_first"] - row["hub_base"] - row["first"] + row["base"]
                spans = _token_spans(mine, its, offset, least - WIDTH + 1, percent)
                for s, e, os, oe, similarity in spans:
                    out.append((
                        row["id"], row["version"], row["base"] + s, row["base"] + e + WIDTH - 1,
                        row["hub_id"], row["hub_version"], row["hub_base"] + os, row["hub_base"] + oe + WIDTH - 1,
                        similarity,
                    ))
            if out:
                yield table(dict(zip(SPANS.names, zip(*out))), SPANS)

    return make


def repeated_spans(
    df: DataFrame, text: str = "text", id: str = "doc_id", least: int = 50, percent: int = 80
) -> DataFrame:
    """Verified pairs of spans: id, start, end (words, from 0, end not included), the same
    of the match in a document with a smaller id, and the similarity of their token sets.
    version is a hash of the text, for rows that share an id.

    Every repeated passage of a document is paired with one earlier document, not with
    all. Null, empty and short texts have no spans; rows with a null id are left out.
    Passages repeated only within one id aren't reported. An empty table gives no rows.
    """
    base = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(
        "id IS NOT NULL AND text IS NOT NULL"
    )
    base, copies = _copies_apart(base, least)
    length = least - WIDTH + 1
    seen = functools.reduce(DataFrame.unionByName, (
        stage(_seen(base, length, range(first, min(first + AT_ONCE, FUNCTIONS)))) for first in range(0, FUNCTIONS, AT_ONCE)
    ))
    tied = seen.withColumn("hub", F.explode("hubs")).where("hub.id < id")
    # the window that both have around the centre, in places of either
    joint = tied.selectExpr(
        "id", "hub.id AS hub_id", f"place % {FUNCTIONS} AS function",
        f"place div {FUNCTIONS} AS at", f"hub.place div {FUNCTIONS} AS hub_at",
        "least(reach >> 32, hub.reach >> 32) AS before",
        "least(reach & 4294967295, hub.reach & 4294967295) AS after",
    ).where(f"before + after + 1 >= {length}").selectExpr(
        "id", "hub_id", "function", "at - before AS lo", "at + after AS hi",
        "hub_at - before AS hub_lo", "hub_at + after AS hub_hi",
    )
    spans = stage(_verified(base, joint, ENOUGH, least, percent))
    # what no comparison has covered, by hashes of whole windows
    covered = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # of one document
    runs = stage(
        seen.groupBy("id").agg(F.collect_list(F.struct("key", "place", "reach", "later")).alias("seen"))
        .join(covered, "id", "left").select("id", "seen", "spans")
        .mapInArrow(_shared_runs(length), "key long, id long, first long, last long, open boolean")
    )
    open_keys = stage(runs.where("open").select("key").distinct())
    few = open_keys.count() <= BROADCAST_IDS
    wanted = (
        runs.join(F.broadcast(open_keys) if few else open_keys, "key", "left_semi")
        .groupBy("id").agg(F.collect_set(F.struct("first", "last")).alias("wanted"))
    )
    found = stage(
        base.join(wanted, "id").select("id", "text", "wanted")
        .mapInArrow(_whole_windows(least), "hash long, id long, start long, count long, hub_id long, hub_start long")
    )
    alone = found.where("hub_id IS NULL").drop("hub_id", "hub_start")
    firsts = alone.groupBy("hash").agg(
        F.min(F.struct("id", "start")).alias("hub"), F.max("id").alias("high")
    ).where("hub.id < high")
    late = alone.join(firsts, "hash").where("hub.id < id").selectExpr(
        "id", "start", "count", "hub.id AS hub_id", "hub.start AS hub_start"
    )
    again = found.where("hub_id IS NOT NULL").select(late.columns).unionByName(late).selectExpr(
        "id", "hub_id", "0L AS function", "start AS lo", f"start + count + {length - 2} AS hi",
        "hub_start AS hub_lo", f"hub_start + count + {length - 2} AS hub_hi",
    )
    return copies.unionByName(spans).unionByName(_verified(base, again, 1, least, percent))


def _seen(base: DataFrame, length: int, functions: range) -> DataFrame:
    """The windows by these functions whose keys are in several documents, and their hubs."""
    fields = ", ".join(f"{name} long" for name in SIGNATURES.names[:-1])
    shared = base.mapInArrow(
        _signatures(length, functions), f"{fields}, also array<struct<place: long, reach: long>>"
    ).withColumn("kind", F.expr(CLASS))
    # numbers first, for keys of one document are half of all; one column is sorted by radix
    whole = Window.partitionBy("meet")
    shared = shared.withColumns({
        "low": F.min("id").over(whole), "high": F.max("id").over(whole), "company": F.max("company").over(whole),
    }).where("company = 1 OR low < high")
    free = F.when(F.col("hub_id").isNull(), F.struct(*OCCURRENCE))
    own_hub = F.when(F.col("hub_id").isNotNull(), F.struct(*(F.col(f"hub_{x}").alias(x) for x in OCCURRENCE)))
    by_key = F.coalesce(own_hub, F.min(free).over(whole))
    by_kind = F.coalesce(own_hub, F.min(free).over(Window.partitionBy("meet", "kind")))
    each = "inline(concat(array(struct(place, reach)), coalesce(also, array()))) AS (place, reach)"
    later = "(hub_id IS NOT NULL OR low < id) AS later"
    # the key's hub has the least id of all, so if it is not before the row, none is
    hubs = "IF(by_key.id < id, IF(by_kind = by_key, array(by_key), array(by_kind, by_key)), NULL) AS hubs"
    return (
        shared.withColumn("by_key", by_key).withColumn("by_kind", by_kind)
        .selectExpr("*", hubs).selectExpr("key", "id", "hubs", later, each)
    )


def _copies_apart(base: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The rows of base but for texts that a smaller id has too, and the spans of these."""
    known = stage(base.select("id", F.xxhash64("text").alias("version"), F.unhex(F.sha2("text", 256)).alias("digest")))
    firsts = known.groupBy("digest").agg(F.min("id").alias("hub_id"), F.max("id").alias("high")).where("hub_id < high")
    copies = stage(known.join(firsts, "digest").where("hub_id < id").select("id", "version", "hub_id").distinct())
    few = copies.count() <= BROADCAST_IDS
    placed = base.withColumn("version", F.xxhash64("text"))
    of_text = F.broadcast(copies) if few else copies
    rest = placed.join(of_text, ["id", "version"], "left_anti").select("id", "text")
    counted = placed.join(of_text, ["id", "version"]).select("id", "version", "text", "hub_id")
    return rest, counted.mapInArrow(_whole_texts(least), SPAN)


def _whole_texts(least: int) -> Callable:
    """Spans of whole texts, of at least so many words."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes = np.array([len(text.split()) for text in texts_of(batch, "text")])
            long = np.flatnonzero(sizes >= least)
            ids, versions, hubs = (
                batch.column(x).to_numpy(zero_copy_only=False)[long] for x in ("id", "version", "hub_id")
            )
            zeros, sizes = np.zeros(len(long), np.int64), sizes[long]
            yield table(dict(zip(
                SPANS.names, (ids, versions, zeros, sizes, hubs, versions, zeros, sizes, np.ones(len(long)))
            )), SPANS)

    return make


def _verified(base: DataFrame, joint: DataFrame, enough: int, least: int, percent: int) -> DataFrame:
    """The spans of joint intervals, joined where they overlap, that the words confirm."""
    pair = Window.partitionBy("id", "hub_id").orderBy("lo", "hi", "hub_lo")
    above = F.max("hi").over(pair.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("lo") > above).cast("long"), F.lit(1))
    joined = (
        joint.withColumn("opens", opens).withColumn("island", F.sum("opens").over(pair))
        .groupBy("id", "hub_id", "island").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.min("hub_lo").alias("hub_lo"), F.max("hub_hi").alias("hub_hi"),
            F.bit_count(F.bit_or(F.expr("shiftleft(1, int(function))"))).alias("functions"),
        ).where(f"functions >= {enough}")
    )
    intervals = stage(joined.withColumn("pair", F.xxhash64("id", "hub_id", "island")))
    # the words of both sides, cut out where each document is
    mine = intervals.selectExpr("id", "pair", "lo", "hi")
    its = intervals.selectExpr("hub_id AS id", "pair", "hub_lo AS lo", "hub_hi AS hi")
    needed = mine.unionByName(its)
    ids = needed.select("id").distinct()
    if ids.count() <= BROADCAST_IDS:
        base = base.join(F.broadcast(ids), "id", "left_semi")
    placed = base.withColumn("version", F.xxhash64("text"))

    def sides(wanted: DataFrame) -> DataFrame:
        many = stage(wanted.groupBy("id").agg((F.count("*") / LISTED + 1).cast("long").alias("lists")).where("lists > 1"))
        few = many.count() <= BROADCAST_IDS
        dealt = wanted.join(F.broadcast(many) if few else many, "id", "left")
        lists = dealt.groupBy("id", F.expr("pmod(pair, coalesce(lists, 1))").alias("list")).agg(
            F.collect_list(F.struct("pair", "lo", "hi")).alias("wanted")
        )
        return placed.join(lists, "id").select("id", "version", "text", "wanted").mapInArrow(_parts, PART)

    hub = sides(its).select("pair", *(F.col(x).alias(f"hub_{x}") for x in ("id", "base", "first", "version", "words")))
    return sides(mine).join(hub, "pair").mapInArrow(_compared(least, percent), SPAN)


RUNS = pa.schema([
    *((x, pa.int64()) for x in ("key", "id", "first", "last")), ("open", pa.bool_()),
])
RUN_DOCUMENTS = 1000


def _shared_runs(length: int) -> Callable:
    """Runs (first, last) of windows of the least length that may be repeats, each by the
    key of its centre. open: one that an earlier document may have, and no span covers.

    Every window has one centre for each function, so an exact repeat is a window whose
    centres occur in other documents, all of them.
    """
    least = length + WIDTH - 1

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, RUN_DOCUMENTS):
                batch = whole_batch.slice(at, RUN_DOCUMENTS)
                seen, spans = batch.column("seen"), batch.column("spans")
                key, place, reach, later = (
                    seen.flatten().field(x).to_numpy(zero_copy_only=False) for x in ("key", "place", "reach", "later")
                )
                owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(seen).to_numpy())
                lo, hi = _starts(place // FUNCTIONS, reach, length)
                # all documents in a row, with room for the words of each one's last window
                sizes = np.zeros(batch.num_rows, np.int64)
                np.maximum.at(sizes, owner, hi + least + 1)
                offsets = np.r_[0, np.cumsum(sizes)]
                lo, hi = lo + offsets[owner], hi + offsets[owner]
                shared = np.ones(offsets[-1], bool)
                for function in range(FUNCTIONS):
                    own = place % FUNCTIONS == function
                    shared &= _within(lo[own], hi[own] + 1, offsets[-1])
                covering = np.repeat(np.arange(batch.num_rows), pc.list_value_length(spans).fill_null(0).to_numpy())
                ends = (spans.flatten().field(x).to_numpy(zero_copy_only=False) for x in ("start", "end"))
                start, end = (np.minimum(x, sizes[covering]) + offsets[covering] for x in ends)
                covered = np.r_[0, np.cumsum(_within(start, end, offsets[-1]))]
                free = shared.copy()
                free[: max(0, len(free) - least + 1)] &= covered[least:] - covered[:-least] < least
                total = np.r_[0, np.cumsum(free)]
                steps = np.diff(np.r_[0, shared.astype(np.int8), 0])
                opens, closes = np.flatnonzero(steps > 0), np.flatnonzero(steps < 0) - 1
                # what runs and the windows around a centre of the first function have in common
                own = np.flatnonzero(place % FUNCTIONS == 0)
                begin, stop = np.searchsorted(closes, lo[own]), np.searchsorted(opens, hi[own], "right")
                centre, run = _ranges(begin, stop - begin)
                centre = own[centre]
                first, last = np.maximum(lo[centre], opens[run]), np.minimum(hi[centre], closes[run])
                base = offsets[owner[centre]]
                yield table({
                    "key": key[centre], "id": batch.column("id").to_numpy(zero_copy_only=False)[owner[centre]],
                    "first": first - base, "last": last - base,
                    "open": later[centre].astype(bool) & (total[last + 1] > total[first]),
                }, RUNS)

    return make


def _within(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Whether each of size places lies in one of the ranges."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, so many from each start, and before them whose they are."""
    counts = np.maximum(counts, 0)
    whose = np.repeat(np.arange(len(starts)), counts)
    return whose, np.arange(len(whose)) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def _starts(at: np.ndarray, reach: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last window of that length around each centre, within its reach."""
    left, right = reach >> 32, reach & 0xFFFFFFFF
    return np.maximum(at - left, at - length + 1), np.minimum(at, at + right - length + 1)


WHOLE = pa.schema([(x, pa.int64()) for x in ("hash", "id", "start", "count", "hub_id", "hub_start")])


def _whole_windows(least: int) -> Callable:
    """A hash of all words of each wanted window, or the first window of the batch that has it.

    A hash is given by one document of the batch, so a frequent one has few rows in all.
    Neighbours whose first windows are neighbours too are one row, with their count.
    """

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, wanted = batch.column("id").to_numpy(zero_copy_only=False), batch.column("wanted")
            words, starts = hashed_words(texts_of(batch, "text"))
            hashes = rolled(words, least)
            del words
            owner = np.repeat(np.arange(len(ids)), pc.list_value_length(wanted).to_numpy())
            first, last = (wanted.flatten().field(x).to_numpy(zero_copy_only=False) for x in ("first", "last"))
            run, place = _ranges(first + starts[owner], last - first + 1)
            text = owner[run]
            fits = place + least <= starts[text + 1]  # an id may have texts of several lengths
            place, text = place[fits], text[fits]
            hashes, id_, start = signed(hashes[place]), ids[text], place - starts[text]
            rows, hubs = local_hubs(hashes, id_, start)
            tied = id_[rows] != id_[hubs]
            alone, rows, hubs = rows[~tied], rows[tied], hubs[tied]
            order = np.lexsort((start[rows], text[rows]))
            rows, hubs = rows[order], hubs[order]
            goes_on = np.ones(max(0, len(rows) - 1), bool)
            for values in (text[rows], text[hubs]):
                goes_on &= values[1:] == values[:-1]
            for values in (start[rows], start[hubs]):
                goes_on &= np.diff(values) == 1
            opens = np.flatnonzero(np.r_[True, ~goes_on][: len(rows)])
            counts = np.diff(np.r_[opens, len(rows)])
            mask = np.r_[np.ones(len(alone), bool), np.zeros(len(opens), bool)]
            none, tie, hub = np.zeros(len(alone), np.int64), rows[opens], hubs[opens]
            yield table({
                "hash": np.r_[hashes[alone], hashes[tie]], "id": np.r_[id_[alone], id_[tie]],
                "start": np.r_[start[alone], start[tie]], "count": np.r_[none + 1, counts],
                "hub_id": pa.array(np.r_[none, id_[hub]], mask=mask),
                "hub_start": pa.array(np.r_[none, start[hub]], mask=mask),
            }, WHOLE)

    return make


def _merged(spans: DataFrame, *keys: str) -> DataFrame:
    """Overlapping or touching spans of the same keys as one; with the smallest match."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    above = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") > above).cast("long"), F.lit(1))
    return (
        spans.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order))
        .groupBy(*keys, "island").agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.min("match_id").alias("match_id"),
            F.max("similarity").alias("similarity"),
        ).drop("island")
    )


def passages(
    df: DataFrame, text: str = "text", id: str = "doc_id", least: int = 50, percent: int = 80
) -> DataFrame:
    """Each document's repeated passages: id, start, end (words), removed (false where the
    passage stays), match_id (a document that has it too) and the largest similarity."""
    pairs = stage(repeated_spans(df, text, id, least, percent))
    gone = pairs.selectExpr("id", "start", "end", "match_id", "similarity", "true AS removed")
    stays = pairs.groupBy(
        F.col("match_id").alias("id"), F.col("match_start").alias("start"), F.col("match_end").alias("end")
    ).agg(F.min("id").alias("match_id"), F.max("similarity").alias("similarity")).withColumn("removed", F.lit(False))
    found = _merged(gone.unionByName(stays.select(gone.columns)), "id", "removed")
    return found.select(F.col("id").alias(id), "start", "end", "removed", "match_id", "similarity")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these words (sorted, apart), and without the space after each."""
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end][0] if end < len(places) else places[end - 1][1]
    return b"".join(kept) + text[at:]


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = [
            text if text is None or not spans
            else without(text.encode(), [(s["start"], s["end"]) for s in spans]).decode()
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"]
        )


def cut_repeats(
    df: DataFrame, text: str = "text", id: str = "doc_id", n_chars: str | None = "n_chars",
    least: int = 50, percent: int = 80,
) -> DataFrame:
    """df with every repeated passage cut out but for the document with the smallest id.

    All rows and columns stay; n_chars, if there is such a column, is counted anew.
    """
    pairs = stage(repeated_spans(df, text, id, least, percent))
    merged = _merged(pairs, "id", "version")
    lists = merged.groupBy("id", "version").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")  # of one document
    )
    rows = df.select(
        F.struct("*").alias("row"), F.col(text).cast("string").alias("text"), F.col(id).cast("long").alias("id")
    ).withColumn("version", F.xxhash64("text"))
    placed = rows.join(lists, ["id", "version"], "left").select("row", "text", "spans")
    schema = placed.select("row", "text").schema
    cut = placed.mapInArrow(_cut, schema)
    columns = []
    for name in df.columns:
        if name == text:
            columns.append(F.col("text").alias(name))
        elif name == n_chars:
            kind = df.schema[name].dataType
            columns.append(F.coalesce(F.length("text"), F.lit(0)).cast(kind).alias(name))
        else:
            columns.append(F.col(f"row.`{name}`").alias(name))
    return cut.select(*columns)

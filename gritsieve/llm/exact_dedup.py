"""Exact duplicates by a content sort.

Sampled splitters deal the rows out by the order of (first bytes, digest, id) of their
normalised texts, Spark's external sort puts equal texts side by side, and one pass over
each sorted partition compares neighbours in full. Since the id is part of the order, a
group of copies larger than a partition is spread over several; its pieces lie at
partition ends and are put together afterwards, at most two per partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gritsieve.llm.common import slices, stage

PREFIX_BYTES = 32


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the first bytes and the digest of the text, normalised."""
    for batch in slices(batches, "text"):
        plain = [x or b"" for x in pc.ascii_lower(batch.column("text")).cast(pa.binary()).to_pylist()]
        added = (
            pa.array([x[:PREFIX_BYTES] for x in plain], pa.binary()),
            pa.array([hashlib.sha256(x).digest() for x in plain], pa.binary()),
        )
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *added], names=[*batch.schema.names, "prefix", "digest"]
        )


def _runs(last: bool, whole: bool, schema: pa.Schema) -> Callable:
    """Walk over sorted rows; a run of equal texts gives a row per id, or one if whole.

    A run that touches an end of the partition may go on in the next one. Its rows have
    no group_size; the row that it would keep carries the text and the run's length.
    """

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        text = digest = best = None
        ids: list = []
        count, runs, out = 0, 0, []

        def close(open_end: bool) -> None:
            edge = runs == 0 or open_end
            piece = 2 * part + (runs > 0) if edge else None
            keep_id = ids[-1] if last else ids[0]
            fields = {
                "keep_id": keep_id, "piece": piece, "group_size": None if edge else count,
                "digest": digest,
            }
            head = {"kept": True, "edge_text": text if edge else None, "piece_size": count if edge else None}
            rest = {"kept": False, "edge_text": None, "piece_size": None}
            if whole:
                out.append({"row": best.as_py(), **fields, **head})
                return
            at = len(ids) - 1 if last else 0
            out.extend({"id": x, **fields, **(head if i == at else rest)} for i, x in enumerate(ids))

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
            return done

        for batch in slices(batches, "text"):
            plain = [x or b"" for x in pc.ascii_lower(batch.column("text")).cast(pa.binary()).to_pylist()]
            names = batch.column("id").to_pylist()
            digests = batch.column("digest").to_pylist()
            for i, now in enumerate(plain):
                if count and (digests[i] != digest or now != text):
                    close(False)
                    runs, ids, count = runs + 1, [], 0
                if not count:
                    text, digest = now, digests[i]
                count += 1
                if whole:
                    if last or count == 1:
                        best, ids = batch.column("row")[i], [names[i]]
                else:
                    ids.append(names[i])
            if out:
                yield flush()
        if count:
            close(True)
            yield flush()

    return walk


def _decided(df: DataFrame, text: str, id: str, keep: str, whole: bool) -> DataFrame:
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is {keep!r}, not 'smallest' or 'largest'")
    last = keep == "largest"
    columns = [F.col(text).cast("string").alias("text"), F.col(id).cast("long").alias("id")]
    if whole:
        columns.append(F.struct("*").alias("row"))
    base = df.select(*columns)
    schema = T.StructType(list(base.schema.fields)).add("prefix", "binary").add("digest", "binary")
    order = [F.col("prefix"), F.col("digest"), F.asc_nulls_first("id") if last else F.asc_nulls_last("id")]
    ordered = base.mapInArrow(_keyed, schema).repartitionByRange(*order).sortWithinPartitions(*order)
    first = T.StructField("row", base.schema["row"].dataType) if whole else T.StructField("id", T.LongType())
    result = T.StructType([first]).add("keep_id", "long").add("piece", "long")
    result = result.add("group_size", "long").add("digest", "binary").add("kept", "boolean")
    result = result.add("edge_text", "binary").add("piece_size", "long")
    walk = _runs(last, whole, to_arrow_schema(result))
    found = stage(ordered.drop("prefix").mapInArrow(walk, result))
    group = Window.partitionBy("digest", "edge_text")
    ends = found.where("edge_text IS NOT NULL").select(
        "piece",
        F.sum("piece_size").over(group).alias("whole_size"),
        (F.max("piece") if last else F.min("piece")).over(group).alias("chosen"),
        (F.max_by("keep_id", "piece") if last else F.min_by("keep_id", "piece")).over(group).alias("chosen_id"),
    )
    # two rows of four numbers for each partition at most
    merged = found.drop("edge_text", "piece_size").join(F.broadcast(ends), "piece", "left")
    return merged.select(
        "row" if whole else "id",
        F.when(F.col("chosen").isNull(), F.col("keep_id")).otherwise(F.col("chosen_id")).alias("keep_id"),
        F.coalesce("group_size", "whole_size").alias("group_size"),
        (F.col("kept") & (F.col("chosen").isNull() | (F.col("piece") == F.col("chosen")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(df: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical after lower-casing A-Z. The row with the
    smallest (or largest) id of each group stays. Null texts count as empty. A null id
    stays only in a group without any id, and keep_id is then null. Of rows that share
    both text and id exactly one stays. Empty tables give no rows; other columns, of
    whatever name, are ignored.
    """
    found = _decided(df, text, id, keep, whole=False)
    return found.select(F.col("id").alias(id), *(x for x in found.columns if x != "id"))


def drop_copies(df: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """The rows of df that exact_dedup keeps, with all their columns."""
    return _decided(df, text, id, keep, whole=True).where("kept").select("row.*")

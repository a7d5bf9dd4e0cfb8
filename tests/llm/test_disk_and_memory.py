"""What operators leave on disk and in memory, and that it does not change their rows."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gritsieve.llm import common, ngram_join, substring


def _shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles()
    return {files.apply(i).getName() for i in range(files.size())}


def test_a_staged_table_leaves_no_shuffle_behind(spark):
    before = _shuffle_files(spark)
    df = spark.range(10_000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count()
    staged = common.stage(df)  # df stays reachable
    for _ in range(50):
        if not (left := {x for x in _shuffle_files(spark) - before if x.startswith("shuffle_")}):
            break
        time.sleep(0.1)
    assert not left
    assert staged.count() == 7 and df.count() == 7
    assert spark.conf.get(common.CLEANUP, "false") == "false"


def test_substring_rows_without_an_earlier_hub_list_none(spark):
    passage = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(i, f"a{i} {passage} b{i}") for i in range(6)], "id long, text string").repartition(3)
    rows = substring._seen(docs, 46, range(8)).collect()
    assert {r.id for r in rows if r.hubs is None} == {0}
    assert rows and all(any(hub.id < r.id for hub in r.hubs) for r in rows if r.hubs is not None)


def test_substring_signatures_go_through_several_shuffles(spark, monkeypatch):
    words = [[f"w{k}x{i}" for i in range(80)] for k in range(3)]
    texts = [words[0] + words[1], words[1] + words[2], words[2] + words[0], words[0][:70]]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "id long, text string").repartition(3)
    rows = [{(r.key, r.id, r.place) for r in substring._seen(docs, 46, part).collect()} for part in (range(8), range(4), range(4, 8))]
    assert rows[0] == rows[1] | rows[2]
    for part, functions in zip(rows[1:], (range(4), range(4, 8))):
        assert {place % 8 for _, _, place in part} == set(functions)
    asked = []
    seen = substring._seen
    monkeypatch.setattr(substring, "_seen", lambda base, length, functions: asked.append(functions) or seen(base, length, functions))
    docs = docs.withColumnRenamed("id", "doc_id")
    found = {tuple(r) for r in substring.passages(docs).collect()}
    assert len(asked) > 1 and sorted(f for x in asked for f in x) == list(range(8))
    monkeypatch.setattr(substring, "AT_ONCE", 8)
    assert found == {tuple(r) for r in substring.passages(docs).collect()} and found


@pytest.mark.parametrize("held", [1, 100, 600_000])
def test_ngram_keys_are_made_in_one_python_process(spark, monkeypatch, held):
    monkeypatch.setattr(ngram_join, "HELD_KEYS", held)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 60 + i)) for i in range(12)]
    rows = [(i, x) for i, x in enumerate(texts)] + [(20 + i, x + " end") for i, x in enumerate(texts)]
    rows += [(40, texts[0]), (41, "one two"), (42, "ONE two"), (43, ""), (44, None), (None, texts[1])]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(2)
    edges = ngram_join._shared_keys(docs, 5, 80)
    assert edges._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    linked = {r.node: r.component for r in common.components(edges).collect()}
    for i in range(12):
        assert linked[i] == linked[20 + i] == i
    assert linked[40] == 0
    assert not {41, 42, 43, 44} & linked.keys()  # of so few shingles only equal sets are linked


def test_rows_go_back_to_spark_in_parts(monkeypatch):
    monkeypatch.setattr(common, "SLICE_ROWS", 4)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10))], names=["x"])
    parts = list(common.by_rows(batch))
    assert [x.num_rows for x in parts] == [4, 4, 2]
    assert pa.Table.from_batches(parts).column("x").to_pylist() == list(range(10))


def test_rows_of_tiles_grow_with_the_documents_of_a_chain(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", 400)
    monkeypatch.setattr(ngram_join, "BITMAP_SHINGLES", 400)
    tiles, made = ngram_join._tiles, []

    def counted(*args):
        dealt = tiles(*args)
        made[-1] += dealt.count()
        return dealt

    monkeypatch.setattr(ngram_join, "_tiles", counted)
    for documents in (16, 80):  # each shares three quarters of its words with the next one
        made.append(0)
        lines = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(documents + 3)]
        rows = [(i, " ".join(lines[i : i + 4])) for i in range(documents)]
        rows.append((documents, " ".join([*lines[:4], "end"])))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        found = {r.doc_id: r.component_id for r in ngram_join.ngram_groups(docs).collect()}
        assert found == {i: i for i in range(documents)} | {documents: 0}
    assert 0 < made[1] <= 6 * made[0]


def test_sets_of_a_frequent_key_meet_over_all_parts(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words + [f"end{i}"])) for i in range(60)]
    rows += [(100 + i, " ".join(words[:-6] + [f"x{i}y{j}" for j in range(6)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    edges = ngram_join._shared_keys(docs.withColumnRenamed("doc_id", "id"), 5, 80)
    assert edges.where("local").count() and edges.where("NOT local").count()
    assert {r.component_id for r in ngram_join.ngram_groups(docs).collect()} == {0}

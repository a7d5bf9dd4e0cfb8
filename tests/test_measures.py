from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from gritsieve.operators import calendar, duplicates, profile, quantiles, values


def as_dict(df, key="column"):
    return {row[key]: row.asDict() for row in df.collect()}


HARD_COLUMNS = {
    "uniform": [random.Random(1).uniform(-50, 50) for _ in range(5000)],
    "heavy tail": [10 ** random.Random(i).uniform(-12, 12) for i in range(3000)],
    "mostly one value": [7.0] * 4000 + [float(i) for i in range(2000)],
    "constant": [3.5] * 100,
    "single": [42.0],
    "two": [1.0, 2.0],
    "far apart": [-1e308, 1e308, 0.0, 1.0, 2.0, 3.0],
    "infinite": [float("inf")] * 3 + [float("-inf")] * 2 + [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0],
    "tiny": [1e-300 * i for i in range(500)],
}


@pytest.mark.parametrize("name", HARD_COLUMNS)
@pytest.mark.parametrize("finish", [5, 1000])
def test_narrowing_finds_the_exact_quantiles(frame, name, finish):
    data = HARD_COLUMNS[name]
    df = frame([(v,) for v in [*data, None]], "`a b` double", partitions=5)
    found = quantiles.exact_quantiles(df, {"a b": len(data)}, in_memory=0, finish=finish)["a b"]
    assert found == pytest.approx(np.quantile(data, quantiles.QUARTILES), rel=1e-12)


def test_both_ways_agree_on_several_columns(frame):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 1), rng.randint(0, 9), rng.expovariate(1)) for _ in range(2000)]
    df = frame(rows, "a double, b int, c double")
    counts = {"a": 2000, "b": 2000, "c": 2000}
    direct = quantiles.exact_quantiles(df, counts)
    narrowed = quantiles.exact_quantiles(df, counts, in_memory=0, finish=50)
    for name in counts:
        assert narrowed[name] == pytest.approx(direct[name], rel=1e-12)


ROWS = [(1, "a", None)] * 5 + [(1, "a", 2.0)] * 2 + [(2, None, None)] * 3 + [(3, "b", 1.0)]


def test_duplicate_rows_all_ways(frame):
    df = frame(ROWS, "i int, s string, d double")
    expected = len(ROWS) - len(set(ROWS))
    for way in (
        duplicates.surplus_rows(df),
        duplicates.duplicate_rows(df),
        duplicates.duplicate_rows(df, rows=len(ROWS)),
        duplicates.duplicate_rows(df, bound=1),
    ):
        assert way.first()[0] == expected


def test_no_duplicates(frame):
    df = frame([(i, str(i)) for i in range(50)], "i int, s string")
    assert duplicates.duplicate_rows(df).first()[0] == 0
    assert duplicates.surplus_rows(df.where("i < 0")).first()[0] == 0


def test_key_summary_hashed_and_counted(frame):
    rows = [(k, f"c{c}", None if k == 3 else "x") for k, c in [
        (1, 1), (1, 2), (2, 1), (2, 1), (3, 5), (3, 6), (None, 1), (None, 2)
    ]]
    df = frame(rows, "k int, a string, b string")
    for hashable in ((), ("a",), ("a", "b")):
        row = duplicates.key_summary(df, {"k": ["a", "b"]}, hashable).first()
        assert row["n_distinct"] == 3
        assert {link["category"]: link["n_keys"] for link in row["links"]} == {"a": 2, "b": 0}
    assert duplicates.key_summary(df, {"k": []}).first()["n_distinct"] == 3


def test_hot_key_is_one_record_per_task(spark):
    """A third of all rows share one key; nothing is lost."""
    df = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "CAST(id % 7 AS STRING) AS c"
    )
    row = duplicates.key_summary(df, {"k": ["c"]}, ("c",)).first()
    assert row["n_distinct"] == 20_001
    assert row["links"][0]["n_keys"] == 1
    assert duplicates.surplus_rows(df, ["k"]).first()[0] == 9_999


def test_category_values(frame):
    cells = [" toys", "Toys", "BOOKS", "books", "n/a", "-", None, "Garden", "Garden"]
    df = frame([(c,) for c in cells], "category string")
    row = as_dict(values.category_values(df, ["category"]))["category"]
    assert row["n_values"] == 8
    assert row["n_distinct"] == 7
    assert row["n_normalised"] == 5
    assert row["n_hashes"] == 7
    assert row["n_placeholder"] == 2


def test_category_candidates_leave_out_free_text(frame):
    rows = [(i, f"text {i}", "ab"[i % 2], str(i % 51)) for i in range(600)]
    df = frame(rows, "i int, free string, few string, fifty_one string")
    candidates = values.category_candidates(df)
    assert "few" in candidates and "free" not in candidates
    found = as_dict(values.category_summary(df))
    assert found["few"]["n_distinct"] == 2


def test_distinct_floor_never_exceeds_the_distinct_count(frame):
    for n in (1, 10, 50, 400):
        df = frame([(f"v{i % n}",) for i in range(800)], "name string")
        row = profile.column_profile(df, "distinct_floor").first()
        assert row["distinct_floor"] <= n
        assert n < 200 or row["distinct_floor"] > profile.FEW_VALUES


def test_smallest_values(frame):
    df = frame([(f"v{i:03d}",) for i in range(100)] * 2, "v string")
    assert values.smallest_values(df, ["v"], 3).first()["listed"] == ["v000", "v001", "v002"]


def test_lengths(frame):
    ids = ["a"] * 3 + ["bb"] * 5 + ["ccc"] + ["dddd"] * 2 + [None] + ["eeeee"] + ["ffffff"]
    df = frame([(v,) for v in ids], "id string")
    counts = {r["length"]: r["n"] for r in values.length_histogram(df, ["id"]).collect()}
    assert counts == dict(Counter(len(v) for v in ids if v is not None))
    row = values.length_summary(df, ["id"]).first()
    assert row["n_lengths"] == 6
    assert [(e["length"], e["n"]) for e in row["top_lengths"]] == [
        (2, 5), (1, 3), (4, 2), (3, 1), (5, 1),
    ]


def test_samples_follow_the_row_order(frame):
    df = frame([(i, None if i % 2 else f"v{9 - i}") for i in range(10)], "i int, s string")
    rows = as_dict(values.column_samples(df, ["s"], ["i"]))
    assert rows["s"]["sample"] == ["v9", "v7", "v5", "v3", "v1"]


def test_date_summary(frame):
    cells = ["2020-01-01", "2020-01-01", "2021-01-01", "2199-01-01", "1975-06-01", "x", None]
    df = frame([(c,) for c in cells], "order_date string")
    row = calendar.date_summary(df, {"order_date": "%Y-%m-%d"}, "2026-01-01").first()
    assert row["n_dates"] == 5 and row["n_unparsed"] == 1 and row["n_days"] == 4
    assert row["n_future"] == 1 and row["n_old"] == 1


def test_numeric_year_column_is_read_as_text(frame):
    df = frame([(2019,), (2020,), (2021,)], "year int")
    formats = calendar.date_formats(df)
    assert formats == {"year": "auto-inferred"}
    row = calendar.date_summary(df, formats, "2026-01-01").first()
    assert row["first_date"].year == 2019 and row["n_old"] == 0


def test_total_rule_reads_percent_and_fraction(frame):
    schema = "quantity double, price double, discount double, total_amount double"
    percent = frame([(2.0, 10.0, 50.0, 10.0), (1.0, 10.0, 0.0, 10.0), (1.0, 10.0, 0.0, 99.0)], schema)
    fraction = frame([(2.0, 10.0, 0.5, 10.0), (2.0, 10.0, 0.5, 20.0), (None, 1.0, 0.0, 5.0)], schema)
    assert profile.table_profile(percent, "n_mismatch").first()["n_mismatch"] == 1
    assert profile.table_profile(fraction, "n_mismatch").first()["n_mismatch"] == 1


def test_total_rule_is_skipped_when_columns_coincide(frame):
    df = frame([(1.0, 2.0)], "quantity double, o_totalprice double")
    assert profile.table_profile(df, "n_mismatch").first()["n_mismatch"] is None

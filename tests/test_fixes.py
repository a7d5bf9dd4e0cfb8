from __future__ import annotations

from datetime import datetime

import pytest

import gritsieve
from catalog.fixture import dirty_sales
from catalog.queries import AUDITED, PLAN, ROW_ORDER
from gritsieve.operators import fixes
from gritsieve.operators.fixes import FIXES, WITHOUT_COLUMN, Watched
from gritsieve.plans.clean import told

AS_OF = "2026-01-01"
NAN = float("nan")


def fixed(df, fix_id, order="i", **params):
    out = gritsieve.apply_fix(df, fix_id, params, as_of=AS_OF, order_by=[order])
    return out.orderBy(order).collect()


def cells(df, fix_id, **params):
    return [row["x"] for row in fixed(df, fix_id, col="x", **params)]


@pytest.fixture
def numbers(frame):
    values = [1.0, None, NAN, -3.0, 0.0, 8.0]
    return frame(list(enumerate(values)), "i int, x double")


@pytest.fixture
def words(frame):
    values = [" Toys", "toys", None, "n/a", "it's", "toys"]
    return frame(list(enumerate(values)), "i int, x string")


def test_fill_mean_counts_nan_as_missing(numbers):
    assert cells(numbers, "fill_mean") == [1.0, 1.5, 1.5, -3.0, 0.0, 8.0]


def test_fill_mean_of_text_numbers_rounds(frame):
    df = frame([(0, "1"), (1, "2"), (2, "x"), (3, "2")], "i int, x string")
    assert cells(df, "fill_mean") == [1.0, 2.0, 1.6667, 2.0]


def test_fill_median(numbers):
    assert cells(numbers, "fill_median") == [1.0, 0.5, 0.5, -3.0, 0.0, 8.0]


def test_fill_of_nothing_changes_nothing(frame):
    df = frame([(0, None), (1, None)], "i int, x double")
    for fix_id in ("fill_mean", "fill_median", "fill_mode", "cap_outliers_iqr"):
        assert cells(df, fix_id) == [None, None]


def test_fill_mode_takes_the_smallest_on_ties(words, frame):
    assert cells(words, "fill_mode")[2] == "toys"
    df = frame(list(enumerate(["b", "a", None, "a", "b"])), "i int, x string")
    assert cells(df, "fill_mode")[2] == "a"


def test_fill_zero_and_unknown(numbers, words):
    assert cells(numbers, "fill_zero") == [1.0, 0.0, 0.0, -3.0, 0.0, 8.0]
    assert cells(words, "fill_zero")[2] == "0"
    assert cells(words, "fill_unknown")[2] == "Unknown"
    assert cells(numbers, "fill_unknown")[1] == "Unknown"


def test_drop_null_rows(numbers):
    assert cells(numbers, "drop_null_rows") == [1.0, -3.0, 0.0, 8.0]


def test_drop_full_duplicates(frame):
    df = frame([(1, "a"), (1, "a"), (1, None), (1, None), (2, "a")], "i int, x string")
    assert gritsieve.apply_fix(df, "drop_full_duplicates").count() == 3


def test_drop_col_duplicates_keeps_the_first_and_one_null(frame):
    rows = [(3, "a"), (1, "a"), (5, None), (4, None), (2, "b")]
    df = frame(rows, "i int, x string")
    assert [tuple(r) for r in fixed(df, "drop_col_duplicates", col="x")] == [
        (1, "a"), (2, "b"), (4, None),
    ]


def test_drop_col_duplicates_limits_groups_before_the_shuffle(frame):
    df = frame([(i, "hot") for i in range(50)], "i int, x string")
    out = gritsieve.apply_fix(df, "drop_col_duplicates", {"col": "x"}, order_by=["i"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert [tuple(r) for r in out.collect()] == [(0, "hot")]


def test_cast_to_numeric(frame):
    df = frame(list(enumerate(["$1,234.50", "10,5", "x", None])), "i int, x string")
    assert cells(df, "cast_to_numeric") == [1234.5, 105.0, None, None]


def test_cast_to_datetime(frame):
    df = frame(list(enumerate(["31/12/2020", "2020-12-31", "x"])), "i int, x string")
    day = datetime(2020, 12, 31)
    assert cells(df, "cast_to_datetime", format="%d/%m/%Y") == [day, None, None]
    assert cells(df, "cast_to_datetime", format="auto-inferred") == [day, day, None]


def test_casts_and_text_fixes(words, frame):
    assert cells(words, "strip_lowercase") == ["toys", "toys", None, "n/a", "it's", "toys"]
    assert cells(words, "strip_titlecase") == ["Toys", "Toys", None, "N/A", "It'S", "Toys"]
    assert cells(words, "replace_pseudo_nulls") == [" Toys", "toys", None, None, "it's", "toys"]
    df = frame([(0, 5), (1, None)], "i int, x int")
    assert cells(df, "cast_to_string") == ["5", None]


def test_numeric_fixes(numbers):
    assert cells(numbers, "drop_negative_rows") == [1.0, None, None, 0.0, 8.0]
    assert cells(numbers, "abs_negative") == [1.0, None, None, 3.0, 0.0, 8.0]
    assert cells(numbers, "drop_zero_rows") == [1.0, None, None, -3.0, 8.0]
    assert cells(numbers, "percent_divide_100") == [0.01, None, None, -0.03, 0.0, 0.08]


def test_row_fixes_parse_text(frame):
    df = frame(list(enumerate(["-1", "2", "x", None])), "i int, x string")
    assert cells(df, "drop_negative_rows") == [2.0, None, None]


def test_cap_outliers(frame):
    values = [1.0, 2.0, 3.0, 4.0, 1000.0, None]
    df = frame(list(enumerate(values)), "i int, x double")
    assert cells(df, "cap_outliers_iqr") == [1.0, 2.0, 3.0, 4.0, 10.0, None]
    same = frame(list(enumerate([5.0, 5.0, 5.0, 5.0, 9.0])), "i int, x double")
    assert cells(same, "cap_outliers_iqr") == [5.0] * 5


def test_column_fixes(frame):
    df = frame([(1, None, "a"), (2, None, "b")], "i int, gone double, x string")
    assert gritsieve.apply_fix(df, "drop_column", {"col": "gone"}).columns == ["i", "x"]
    assert gritsieve.apply_fix(df, "drop_column", {"col": "absent"}).columns == df.columns
    assert gritsieve.apply_fix(df, "drop_empty_columns").columns == ["i", "x"]
    twice = df.select("x", "i", "x")
    out = gritsieve.apply_fix(twice, "drop_full_duplicate_columns")
    assert out.columns == ["x", "i"] and out.count() == 2


def test_drop_future_dates_keeps_unparsed(frame):
    df = frame(list(enumerate(["2025-01-01", "2199-01-01", "x", None])), "i int, x string")
    assert cells(df, "drop_future_dates") == ["2025-01-01", "x", None]


def test_unknown_fix(numbers):
    with pytest.raises(ValueError):
        gritsieve.apply_plan(numbers, [("drop_empty_columns", {}), ("polish", {})])


def test_missing_column_is_refused(numbers):
    with pytest.raises(ValueError):
        gritsieve.apply_fix(numbers, "fill_mean", {"col": "y"})


@pytest.mark.parametrize("fix_id", [f for f in FIXES if f != "percent_divide_100"])
def test_fixes_are_idempotent(frame, fix_id):
    if fix_id == "cast_to_datetime":
        rows = [(0, "2020-01-02"), (1, "x")]
    elif fix_id in ("drop_future_dates",):
        rows = [(0, "2020-01-02"), (1, "2199-01-02"), (2, None)]
    elif fix_id in ("abs_negative", "cap_outliers_iqr", "drop_negative_rows", "drop_zero_rows"):
        rows = [(i, v) for i, v in enumerate(["1", "-2", "0", None, "4", "3"])]
    else:
        rows = [(0, "1"), (1, " N/A"), (2, None), (3, "1"), (4, "$2")]
    df = frame(rows, "i int, x string")
    params = {} if fix_id in WITHOUT_COLUMN else {"col": "x"}
    if fix_id == "cast_to_datetime":
        params["format"] = "%Y-%m-%d"
    once = gritsieve.apply_fix(df, fix_id, params, as_of=AS_OF, order_by=["i"])
    twice = gritsieve.apply_fix(once, fix_id, params, as_of=AS_OF, order_by=["i"])
    assert once.schema == twice.schema
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_names_with_dots_and_spaces(frame):
    df = frame([(0, " A "), (1, None)], "i int, `my.odd col` string")
    out = gritsieve.apply_fix(df, "strip_lowercase", {"col": "my.odd col"})
    assert out.columns == ["i", "my.odd col"]
    assert {r[1] for r in out.collect()} == {"a", None}


def test_plan_folds_fixes(words):
    plan = [("replace_pseudo_nulls", {"col": "x"}), ("strip_lowercase", {"col": "x"}),
            ("drop_null_rows", {"col": "x"})]
    out = gritsieve.apply_plan(words, plan)
    assert sorted(r["x"] for r in out.collect()) == ["it's", "toys", "toys", "toys"]


def test_plan_stages_once_between_a_shuffle_and_the_statistics(words):
    staged = []

    def stage(df):
        staged.append(df.columns)
        return df

    plan = [("fill_mode", {"col": "x"}), ("drop_full_duplicates", {}),
            ("strip_lowercase", {"col": "x"}), ("fill_mode", {"col": "x"}),
            ("drop_empty_columns", {})]
    assert gritsieve.apply_plan(words, plan, stage=stage).count() == 6
    assert len(staged) == 1


def test_large_quantiles_are_narrowed(frame, monkeypatch):
    monkeypatch.setattr(fixes.quantiles.exact_quantiles, "__defaults__",
                        (fixes.quantiles.QUARTILES, 0, 3))
    df = frame([(i, float(i)) for i in range(101)] + [(101, None)], "i int, x double")
    assert cells(df, "fill_median")[101] == 50.0


@pytest.mark.parametrize(
    ("fix_id", "params", "dropped", "changed", "columns"),
    [
        ("fill_mean", {"col": "x"}, 0, 2, 0),
        ("drop_null_rows", {"col": "x"}, 2, 0, 0),
        ("drop_negative_rows", {"col": "x"}, 1, 0, 0),
        ("abs_negative", {"col": "x"}, 0, 1, 0),
        ("drop_full_duplicates", {}, 0, 0, 0),
        ("drop_column", {"col": "x"}, 0, 0, 1),
    ],
)
def test_audit(numbers, fix_id, params, dropped, changed, columns):
    row = gritsieve.audit(numbers, fix_id, params).first()
    assert (row["rows_dropped"], row["values_changed"], row["columns_dropped"]) == (
        dropped, changed, columns,
    )
    assert fix_id in row["message"]


def test_audit_tells_the_statistic(numbers):
    assert gritsieve.audit(numbers, "fill_mean", {"col": "x"}).first()["statistic"] == "1.5"


def test_outcomes_are_those_of_single_audits(spark):
    df = dirty_sales(spark, "/root/testdata/sf0.001")
    for fix_id, params in (*AUDITED, ("drop_column", {"col": "price"}), ("fill_median", {"col": "price"}), ("cast_to_string", {"col": "price"})):
        cleaned, outcomes = gritsieve.clean(df, [(fix_id, params)], as_of=AS_OF, order_by=ROW_ORDER)
        wanted = gritsieve.audit(df, fix_id, params, as_of=AS_OF, order_by=ROW_ORDER).first()
        found = outcomes.first()
        for name in ("fix_id", "column", "rows_before", "rows_after", "rows_dropped", "values_changed", "columns_dropped"):
            assert found[name] == wanted[name], (fix_id, name)
        expected = gritsieve.apply_fix(df, fix_id, params, as_of=AS_OF, order_by=ROW_ORDER)
        assert sorted(map(str, cleaned.collect())) == sorted(map(str, expected.collect()))


def test_outcomes_that_do_not_fit_are_counted_again(spark, monkeypatch):
    df = dirty_sales(spark, "/root/testdata/sf0.001")
    plan = PLAN[:7]
    _, expected = gritsieve.clean(df, plan, as_of=AS_OF, order_by=ROW_ORDER)
    counted = Watched.counts

    def twice(self):  # as if tasks of the first stage had run again
        found = counted(self)
        return found | {"rows_before": found["rows_before"] + 5} if self.fix_id == "drop_full_duplicates" else found | {"rows_after": found["rows_after"] + 7}

    monkeypatch.setattr(Watched, "counts", twice)
    _, found = gritsieve.clean(df, plan, as_of=AS_OF, order_by=ROW_ORDER)
    assert found.collect() == expected.collect()
    assert told(found).first()["message"] == "drop_full_duplicates: 3 rows dropped, 0 values changed, 0 columns dropped"


def test_an_empty_plan_has_no_outcomes(spark):
    cleaned, outcomes = gritsieve.clean(spark.range(3), [])
    assert cleaned.count() == 3 and outcomes.count() == 0

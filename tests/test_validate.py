from __future__ import annotations

from collections import Counter
from dataclasses import replace

import pytest

import gritsieve
from gritsieve.operators import calendar, duplicates, profile
from catalog.fixture import dirty_sales
from catalog.queries import shown
from gritsieve.operators.fixes import COLUMN_FIXES
from gritsieve.plans.validate import measured, revalidated, unique_names, validate

AS_OF = "2026-01-01"


def issues_of(df, **options):
    return validate(df, as_of=AS_OF, **options).collect()


def pick(issues, check, column=None):
    return [i for i in issues if i["check"] == check and i["column"] == column]


def only(issues, check, column=None):
    (issue,) = pick(issues, check, column)
    return issue


def no_errors(issues):
    assert not [i["message"] for i in issues if i["section"] == "Error"]


@pytest.fixture
def tiny(frame):
    return frame(
        [(1, 10.5, 2), (2, 20.0, 1), (3, None, 3)], "order_id bigint, price double, quantity bigint"
    )


def test_small_table(tiny):
    issues = issues_of(tiny)
    no_errors(issues)
    assert Counter(i["severity"] for i in issues) == {"CRITICAL": 1, "WARNING": 2, "INFO": 4, "OK": 7}
    missing = only(issues, "null_severity", "price")
    assert missing["severity"] == "CRITICAL"
    assert [f["fix_id"] for f in missing["fixes"]] == [
        "fill_mean", "fill_median", "fill_zero", "drop_null_rows",
    ]
    assert [f["label"] for f in missing["fixes"][:2]] == [
        "Fill 'price' with the mean (15.25)", "Fill 'price' with the median (15.25)",
    ]
    assert missing["fixes"][0]["params"] == {"col": "price"}
    assert only(issues, "id_duplicates", "order_id")["severity"] == "OK"


def test_issue_ids_are_stable_and_unique(tiny):
    first, second = issues_of(tiny), issues_of(tiny.repartition(1))
    assert {i["issue_id"] for i in first} == {i["issue_id"] for i in second}
    assert len({i["issue_id"] for i in first}) == len(first)


def test_empty_table_runs_every_section(frame, spark):
    issues = issues_of(spark.createDataFrame([], "order_id bigint, order_date string, price double"))
    no_errors(issues)
    assert only(issues, "empty_table")["severity"] == "CRITICAL"
    assert not [i for i in issues if i["check"] == "section_ok" and i["section"].startswith("1")]
    assert {i["section"][0] for i in issues} == set("123456789")


def test_structure_checks(frame):
    rows = [(i, None, i, "x") for i in range(6)]
    df = frame(rows, "id int, gone string, col1 int, note string")
    issues = issues_of(df, header=["id", "gone", " ", "id"], expected_columns=["id", "price"])
    no_errors(issues)
    assert only(issues, "blank_names")["value"] == 1
    assert only(issues, "duplicate_names")["value"] == 1
    assert only(issues, "empty_columns")["fixes"][0]["fix_id"] == "drop_empty_columns"
    technical = only(issues, "technical_columns")
    assert [f["params"]["col"] for f in technical["fixes"]] == ["col1"]
    expected = only(issues, "expected_columns")
    assert expected["severity"] == "CRITICAL" and "price" in expected["message"]
    assert "section_ok" not in {i["check"] for i in issues if i["section"].startswith("1")}


def test_expected_columns_present(tiny):
    issues = issues_of(tiny, expected_columns=["price"])
    assert only(issues, "expected_columns")["severity"] == "OK"


def test_duplicate_names_in_the_frame(frame):
    df = frame([(i, i) for i in range(5)], "a int, b int").toDF("a", "a")
    issues = issues_of(df)
    no_errors(issues)
    assert only(issues, "duplicate_names")["severity"] == "CRITICAL"


def test_unique_names():
    assert unique_names(["a", "a", "", "a.1", " "]) == ["a", "a.1", "Unnamed: 2", "a.1.1", "Unnamed: 4"]


def test_type_checks(frame):
    rows = [
        (f"2020-01-{i:02d}", f"nope {i}", f"${i},000", str(i) if i % 2 else f"x{i}")
        for i in range(1, 21)
    ]
    df = frame(rows, "order_date string, created string, revenue string, note string")
    issues = issues_of(df)
    no_errors(issues)
    good = only(issues, "text_dates", "order_date")
    assert good["severity"] == "WARNING"
    assert good["fixes"][0]["params"] == {"col": "order_date", "format": "%Y-%m-%d"}
    bad = only(issues, "text_dates", "created")
    assert bad["severity"] == "CRITICAL" and "nope 1" in bad["message"]
    assert bad["fixes"][0]["params"]["format"] == "auto-inferred"
    assert only(issues, "text_numbers", "revenue")["value"] == 1.0
    assert only(issues, "mixed_types", "note")["value"] == 0.5
    assert only(issues, "date_parse_ratio", "created")["severity"] == "CRITICAL"
    assert not pick(issues, "date_range", "created")


def test_missing_value_checks(frame):
    rows = [(i, None if i % 2 else 1.0, "N/A" if i == 1 else "ok", None) for i in range(10)]
    rows += [(None, None, None, None)]
    df = frame(rows, "id int, price double, note string, other double")
    issues = issues_of(df)
    no_errors(issues)
    assert only(issues, "null_summary")["value"] == 4
    assert only(issues, "null_severity", "price")["severity"] == "CRITICAL"
    assert only(issues, "null_severity", "other")["severity"] == "WARNING"
    assert [f["fix_id"] for f in only(issues, "null_severity", "note")["fixes"]] == [
        "fill_mode", "fill_unknown", "drop_null_rows",
    ]
    assert only(issues, "mostly_empty_rows")["value"] == 1
    pseudo = only(issues, "pseudo_nulls")
    assert pseudo["fixes"][0]["params"] == {"col": "note"}
    assert only(issues, "null_ids", "id")["value"] == 1


def test_duplicate_checks(frame):
    rows = [(1, 1, "p", "2020-01-01", 5.0)] * 2 + [(2, 1, "p", "2020-01-01", 5.0)]
    rows += [(i, i, "p", "2020-01-02", 5.0) for i in range(3, 8)]
    df = frame(rows, "order_id int, customer int, product string, sale_date string, price double")
    issues = issues_of(df)
    no_errors(issues)
    assert only(issues, "full_duplicates")["severity"] == "CRITICAL"
    assert only(issues, "full_duplicates")["value"] == 1
    repeated = only(issues, "id_duplicates", "order_id")
    assert repeated["severity"] == "CRITICAL" and repeated["value"] == 1
    assert only(issues, "soft_key_duplicates")["value"] == 2


def test_numeric_checks(frame):
    rows = [(float(i % 10 + 1), 1.0, 10.0) for i in range(95)]
    rows += [(-5.0, 0.0, 10.0), (1e6, 1.0, 200.0), (2e6, 1.0, 10.0), (None, 1.0, 10.0)]
    df = frame(rows, "price double, amount double, discount double")
    issues = issues_of(df)
    no_errors(issues)
    assert only(issues, "negative_values", "price")["metrics"] == {}
    assert only(issues, "negative_values", "price")["value"] == 1
    assert only(issues, "zero_values", "amount")["value"] == 1
    assert only(issues, "percent_out_of_range", "discount")["value"] == 1
    assert only(issues, "iqr_outliers", "price")["value"] == 2


def test_category_checks(frame):
    rows = [(["Toys", " toys", "-", "Books"][i % 4], f"city {i}") for i in range(120)]
    df = frame(rows, "kind string, city string")
    issues = issues_of(df)
    no_errors(issues)
    assert only(issues, "case_variants", "kind")["value"] == 1
    assert only(issues, "category_placeholders", "kind")["value"] == 30
    assert only(issues, "high_cardinality", "city")["value"] == 120
    listed = only(issues, "category_values", "kind")
    assert listed["severity"] == "INFO" and "Books" in listed["message"]


def test_categories_between_31_and_100_values_are_silent(frame):
    df = frame([(f"c{i % 40}",) for i in range(80)], "city string")
    issues = issues_of(df)
    assert not pick(issues, "category_values", "city")
    assert not pick(issues, "high_cardinality", "city")


def test_date_checks(frame):
    cells = ["2020-01-01"] * 31 + ["2199-01-01", "1975-01-01", "x"]
    slashes = [f"{i % 28 + 1:02d}/01/2020" for i in range(34)]
    df = frame(list(zip(cells, slashes)), "order_date string, updated string")
    issues = issues_of(df)
    no_errors(issues)
    assert only(issues, "future_dates", "order_date")["fixes"][0]["fix_id"] == "drop_future_dates"
    assert only(issues, "old_dates", "order_date")["value"] == 1
    assert only(issues, "unparsed_dates", "order_date")["value"] == 1
    assert only(issues, "date_density", "order_date")["value"] == 3
    assert only(issues, "ambiguous_dates", "updated")["value"] == 34
    assert only(issues, "date_range", "updated")["value"] == 27


def test_key_checks(frame):
    ids = ["1", "22", "333", "a", "bbbbb", "cccc", None]
    rows = [(ids[i % 7], "ab"[i % 2]) for i in range(70)]
    df = frame(rows, "order_id string, status string")
    issues = issues_of(df)
    no_errors(issues)
    assert only(issues, "id_lengths", "order_id")["value"] == 5
    assert only(issues, "mixed_id_types", "order_id")["value"] == 0.5
    link = only(issues, "id_maps_to_many_categories", "order_id")
    assert link["related"] == "status" and link["value"] == 6


def test_business_checks(frame):
    rows = [(1, "a", 10.0, 20.0, 5.0, "-"), (1, "b", 10.0, 5.0, 5.0, "cash"),
            (2, "a", 10.0, 20.0, 0.0, "x" * 51)]
    schema = ("product_id int, category string, price double, total double, discount double, "
              "payment string")
    issues = issues_of(frame(rows, schema))
    no_errors(issues)
    assert only(issues, "discount_not_applied")["value"] == 1
    assert only(issues, "product_multi_category")["severity"] == "CRITICAL"
    assert only(issues, "suspicious_payment")["value"] == 2


def test_a_failing_pass_does_not_stop_the_others(tiny, monkeypatch):
    def broken(*_):
        raise RuntimeError("no such luck")

    monkeypatch.setattr(calendar, "date_summary", broken)
    monkeypatch.setattr(duplicates, "duplicate_rows", broken)
    issues = issues_of(tiny)
    (error,) = [i for i in issues if i["section"] == "Error"]
    assert error["severity"] == "WARNING" and "no such luck" in error["message"]
    assert pick(issues, "null_severity", "price")
    assert not pick(issues, "full_duplicates")


def test_a_failing_scan_is_reported(tiny, monkeypatch):
    def broken(*_):
        raise RuntimeError("nothing readable")

    monkeypatch.setattr(profile, "scan", broken)
    issues = issues_of(tiny)
    assert [i["section"] for i in issues] == ["Error"]


def test_other_column_types(spark):
    df = spark.range(20).selectExpr(
        "id", "array(id) AS list", "id % 2 = 0 AS flag", "CAST(id AS DECIMAL(10, 2)) AS amount",
        "date_add(date'2020-01-01', CAST(id AS INT)) AS day", "current_timestamp() AS stamp",
        "named_struct('a', id) AS nested", "CAST(id AS FLOAT) AS `rate.x`",
    )
    issues = issues_of(df)
    no_errors(issues)
    assert only(issues, "date_range", "day")["value"] == 19


def test_views(tiny):
    issues = gritsieve.validate(tiny, as_of=AS_OF)
    summary = {r["severity"]: r["n_issues"] for r in gritsieve.severity_summary(issues).collect()}
    assert summary == {"CRITICAL": 1, "WARNING": 2, "INFO": 4, "OK": 7}
    status = {r["section"]: r["status"] for r in gritsieve.section_status(issues).collect()}
    assert status["3. Missing Values"] == "CRITICAL" and status["2. Data Types"] == "INFO"
    assert gritsieve.overall_status(issues).first()["status"] == "critical"
    assert gritsieve.with_severity(issues, "OK").count() == 7
    rows = gritsieve.ordered(issues).collect()
    sections = [r["section_no"] for r in rows]
    assert sections == sorted(sections)
    rank = {"CRITICAL": 0, "WARNING": 1, "INFO": 2, "OK": 3}
    third = [rank[r["severity"]] for r in rows if r["section_no"] == 3]
    assert third == sorted(third)


def test_status_without_serious_issues(spark):
    df = spark.range(10).selectExpr("id AS value_id", "CAST(id AS DOUBLE) AS w")
    issues = gritsieve.validate(df)
    assert gritsieve.overall_status(issues).first()["status"] == "ok"


def test_clean_then_validate(frame):
    rows = [(i, "n/a" if i % 5 == 0 else "Toys", f"${i},0") for i in range(20)] + [(1, "Toys", "$1,0")]
    df = frame(rows, "id int, category string, revenue string")
    plan = [("drop_full_duplicates", {}), ("replace_pseudo_nulls", {"col": "category"}),
            ("cast_to_numeric", {"col": "revenue"})]
    before = {i["check"] for i in issues_of(df)}
    cleaned, issues = gritsieve.clean_then_validate(df, plan, as_of=AS_OF)
    after = issues.collect()
    no_errors(after)
    assert {"pseudo_nulls", "text_numbers"} <= before
    assert not {"pseudo_nulls", "text_numbers"} & {i["check"] for i in after}
    assert cleaned.count() == 20
    assert only(after, "full_duplicates")["severity"] == "OK"


def broken(name, kind="INT"):
    return f"CAST(concat('x', order_id) AS {kind}) AS {name}"


def found_in(df):
    return sorted(map(str, shown(validate(df, as_of="2026-01-01")).collect()))


@pytest.mark.parametrize("count", [1, 3])
def test_columns_that_cannot_be_read_leave_the_rest(spark, frame, count):
    rows = [(i, f"c{i % 3}", float(i % 7) - 1, f"2020-01-{1 + i % 28:02}") for i in range(60)]
    df = frame(rows, "order_id int, category string, price double, order_date string")
    names = [f"broken_{i}" for i in range(count)]
    both = df.selectExpr("order_id", *(broken(name) for name in names), "category", "price", "order_date")
    whole = {x for x in found_in(df) if "column_types" not in x and "section_ok" not in x}
    found = validate(both, as_of="2026-01-01").collect()
    errors = [i for i in found if i["section"] == "Error"]
    assert [(i["check"], i["column"], i["severity"]) for i in errors] == [("unreadable", name, "WARNING") for name in names]
    assert len({i["issue_id"] for i in found}) == len(found)
    rest = {x for x in found_in(both) if "column_types" not in x and "section_ok" not in x and "unreadable" not in x}
    assert rest == whole
    closed = {i["section_no"] for i in found if i["check"] == "section_ok"}
    assert 3 not in closed and 1 in closed  # nothing is said to be all right that was not measured


def test_rows_that_cannot_be_counted_are_one_failure(spark):
    df = spark.range(10).where("CAST(concat('x', id) AS INT) > 1").selectExpr("id", "id AS price")
    found = validate(df).collect()
    assert [(i["section"], i["check"], i["severity"]) for i in found] == [("Error", "error", "WARNING")]


def test_a_rule_that_fails_leaves_the_columns(frame, monkeypatch):
    monkeypatch.setitem(profile.TABLE_MEASURES, "n_mismatch", lambda df: {"n_mismatch": "CAST(concat('x', max(price)) AS BIGINT)"})
    df = frame([(1, 2.0), (2, 3.0)], "order_id int, price double")
    found = validate(df).collect()
    assert [(i["check"], i["column"]) for i in found if i["section"] == "Error"] == [("unreadable", "n_mismatch")]
    assert [i for i in found if i["check"] == "shape"]


ORDER = {"as_of": AS_OF, "order_by": ("row_id", "order_id")}
REACHES = [
    *((fix_id, {"col": name}) for fix_id, name in zip(COLUMN_FIXES, 5 * ("price", "category", "order_date"))),
    ("drop_column", {"col": "category"}), ("drop_column", {"col": "total_amount"}), ("drop_empty_columns", {}),
    ("cast_to_string", {"col": "product_id"}), ("strip_lowercase", {"col": "payment_method"}),
    ("fill_mode", {"col": "order_id"}), ("cast_to_numeric", {"col": "revenue"}), ("percent_divide_100", {"col": "discount"}),
    ("drop_negative_rows", {"col": "quantity"}), ("drop_full_duplicates", {}),
]


def everything(issues):
    return sorted(map(str, issues.collect()))


@pytest.fixture(scope="module")
def before(spark):
    return measured(dirty_sales(spark, "/root/testdata/sf0.001"), **ORDER)


@pytest.mark.parametrize(("fix_id", "params"), REACHES)
def test_measuring_again_what_a_fix_reaches_is_as_good_as_all(before, fix_id, params):
    after = revalidated(before, fix_id, params)
    assert everything(after.issues) == everything(validate(after.df, **ORDER))


def test_fixes_after_fixes(before):
    after = before
    for fix_id, params in [
        ("replace_pseudo_nulls", {"col": "category"}), ("drop_column", {"col": "payment_method"}),
        ("cast_to_datetime", {"col": "order_date"}), ("fill_unknown", {"col": "category"}), ("drop_empty_columns", {}),
    ]:
        after = revalidated(after, fix_id, params)
    assert everything(after.issues) == everything(validate(after.df, **ORDER))


def test_a_fix_reads_its_column_alone(before, monkeypatch):
    """All other columns fail when they are read; whole rows are compared in one pass only."""
    def failing(item):
        if item.name in ("revenue", *ORDER["order_by"]):  # samples follow the row order
            return item.name
        return f"CAST(assert_true(row_id IS NULL AND row_id IS NOT NULL) AS {item.dataType.simpleString()}) AS {item.name}"

    df = before.df
    broken_df = df.selectExpr(*map(failing, df.schema.fields))
    assert broken_df.dtypes == df.dtypes
    monkeypatch.setattr(duplicates, "duplicate_rows", lambda df, rows: df.sparkSession.range(1).selectExpr("3L AS n"))
    after = revalidated(replace(before, df=broken_df), "strip_lowercase", {"col": "revenue"})
    found = after.issues.collect()
    no_errors(found)
    assert after.measurements.before is not None and pick(found, "full_duplicates")[0]["value"] == 3


def test_a_table_is_written_after_a_fix_that_parses_text(spark, frame):
    df = frame([(i, f"${i},100.50", f"{1 + i % 28:02}/01/2020") for i in range(50)], "id int, amount string, day string")
    state = measured(df, as_of="2026-01-01", order_by=["id"])
    for fix_id, col in (("cast_to_numeric", "amount"), ("cast_to_datetime", "day")):
        state = revalidated(state, fix_id, {"col": col})
        assert "regexp" not in state.df._jdf.queryExecution().optimizedPlan().toString().lower()
    again = validate(state.df, as_of="2026-01-01", order_by=["id"])
    assert sorted(map(str, state.issues.collect())) == sorted(map(str, again.collect()))

from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import types as T

from catalog.fixture import dealt
from gritsieve import roles, validate
from gritsieve.functions import date_grammar, dates, numbers, text
from gritsieve.operators import date_shapes


@pytest.mark.parametrize(
    ("name", "test", "expected"),
    [
        ("Order_ID", roles.is_id, True),
        ("l_linenumber", roles.is_id, True),
        ("width", roles.is_id, True),
        ("price", roles.is_id, False),
        ("country", roles.is_numeric_name, True),
        ("Discount", roles.is_numeric_name, True),
        ("name", roles.is_numeric_name, False),
        ("PaymentMethod", roles.is_category_name, True),
        ("o_totalprice", roles.is_critical, True),
        ("comment", roles.is_critical, False),
        ("Unnamed: 0", roles.is_technical, True),
        ("index", roles.is_technical, True),
        ("indexes", roles.is_technical, False),
        ("col12", roles.is_technical, True),
        ("_c3", roles.is_technical, True),
        ("color", roles.is_technical, False),
    ],
)
def test_roles_go_by_substrings(name, test, expected):
    assert test(name) is expected


def test_date_role_by_type_or_name():
    assert roles.is_date(T.StructField("when", T.TimestampNTZType()))
    assert roles.is_date(T.StructField("created", T.StringType()))
    assert not roles.is_date(T.StructField("when", T.StringType()))


def test_pickers_take_the_first_match():
    columns = ["id", "qty", "unit_price", "total_price", "discount"]
    assert roles.amount_columns(columns) == {
        "quantity": "qty", "price": "unit_price", "total": "total_price", "discount": "discount",
    }
    assert roles.product_id_column(["id", "product", "product_id"]) == "product_id"
    assert roles.payment_column(["pay_method"]) == "pay_method"
    assert roles.soft_key(["customer", "product", "note"]) == []
    assert roles.soft_key(["customer", "product", "date", "price"]) == [
        "customer", "product", "date", "price",
    ]


def test_strip_knows_all_whitespace(evaluate):
    values = ["  a b ", "\t\na\r", " x　", "\x1cq\x1f", "", "   ", None, "é "]
    assert evaluate(text.strip("v"), values) == [
        None if v is None else v.strip() for v in values
    ]


def test_strip_lower_matches_python(evaluate):
    values = [" ABC ", "ÀÉ ", "Straße"]
    assert evaluate(text.strip_lower("v"), values) == [v.strip().lower() for v in values]


def test_title_case_capitalises_every_letter_run(evaluate):
    values = ["it's foo-bar", "ÉCOLE élan", "a1b2", "", None, "x  y"]
    expected = ["It'S Foo-Bar", "École Élan", "A1B2", "", None, "X  Y"]
    assert evaluate(text.title_case("v"), values) == expected


def test_placeholders(evaluate):
    values = [" N/A ", "Unknown", "-", "", "  ", "nano", "none.", "Not Available", None]
    expected = [True, True, True, True, True, False, False, True, None]
    assert evaluate(text.is_placeholder("v"), values) == expected


def test_null_tokens_are_exact(evaluate):
    values = ["", "NA", "na", "Null", "null", "None", "-", "unknown", "<NA>", " NA"]
    expected = [None, None, "na", "Null", None, None, "-", "unknown", None, " NA"]
    assert evaluate(text.csv_null_tokens_to_null("v"), values) == expected


def test_percent_text(spark):
    row = spark.range(1).selectExpr(
        f"{text.percent_text('1', '3')} AS a", f"{text.percent_text('5', '0')} AS b"
    ).first()
    assert tuple(row) == ("33.3%", "0.0%")


def test_number_text(evaluate):
    values = [
        "1", " 2.5 ", "-3e2", "+.5", "5.", "1d", "nan", "1e400", "inf", "-Infinity", "0x1A",
        "1_000", "1,000", "True", "", None, ".", "e5", "-", "i",
    ]
    expected = [
        1.0, 2.5, -300.0, 0.5, 5.0, None, None, None, math.inf, -math.inf, None, None, None,
        None, None, None, None, None, None, None,
    ]
    assert evaluate(numbers.text_to_number("v"), values) == expected


def test_currency_text_drops_commas(evaluate):
    values = ["$1,234.50", "10,5", "12 %", "€ 7", "£x", "1 000", None]
    expected = [1234.5, 105.0, 12.0, 7.0, None, 1000.0, None]
    assert evaluate(numbers.clean_currency("v"), values) == expected


def test_clip_keeps_null(evaluate):
    assert evaluate(numbers.clip("v", "0D", "10D"), [-5.0, 5.0, 50.0, None], "double") == [
        0.0, 5.0, 10.0, None,
    ]


def test_nan_becomes_null(frame):
    df = frame([(float("nan"), 1), (2.0, 2)], "x double, i int")
    assert {r["x"] for r in numbers.nan_to_null(df).collect()} == {None, 2.0}


@pytest.mark.parametrize(
    ("fmt", "good", "bad"),
    [
        ("%Y-%m-%d", "2020-1-5", "20-01-05"),
        ("%d/%m/%Y", "31/12/2020", "12/31/2020"),
        ("%m/%d/%Y", "12/31/2020", "31/12/2020"),
        ("%d.%m.%Y", "31.12.2020", "31-12-2020"),
        ("%Y/%m/%d", "2020/12/31", "2020-12-31"),
        ("%d-%m-%Y", "31-12-2020", "2020-12-31"),
        ("%Y-%m-%d %H:%M:%S", "2020-12-31 1:2:3", "2020-12-31"),
        ("%d/%m/%Y %H:%M:%S", "31/12/2020 01:02:03", "31/12/2020"),
        ("%m/%d/%Y %H:%M:%S", "12/31/2020 01:02:03", "31/12/2020 01:02:03"),
        ("%Y-%m-%dT%H:%M:%S", "2020-12-31T01:02:03", "2020-12-31 01:02:03"),
    ],
)
def test_formats(evaluate, fmt, good, bad):
    found = evaluate(dates.parse_format("v", fmt), [good, bad, " " + good, good + "x", None])
    assert found == [datetime.strptime(good, fmt), None, None, None, None]


def test_impossible_days_are_null(evaluate):
    assert evaluate(dates.parse_format("v", "%Y-%m-%d"), ["2021-02-29", "2020-02-29"]) == [
        None, datetime(2020, 2, 29),
    ]


def test_any_format_reads_iso_and_known_formats(evaluate):
    values = ["2020", "2020-05-06T07:08:09", "05/06/2020", "12:30", "12345", "x"]
    assert evaluate(dates.parse_any("v"), values) == [
        datetime(2020, 1, 1), datetime(2020, 5, 6, 7, 8, 9), datetime(2020, 6, 5), None, None, None,
    ]


def test_unknown_directive_is_refused():
    with pytest.raises(ValueError):
        dates.parse_format("v", "%A %d")


def test_earlier_format_wins_ties(spark):
    df = spark.createDataFrame([("01/02/2020",), ("03/04/2020",)], "v string")
    hits = df.selectExpr(f"{dates.format_hits('v')} AS hits")
    assert hits.selectExpr(dates.best_format("hits")).first()[0] == "%d/%m/%Y"


def test_whole_days_between(spark):
    days = dates.days_between("timestamp_ntz'2020-01-01 23:00:00'", "timestamp_ntz'2020-01-03 01:00:00'")
    assert spark.range(1).selectExpr(days).first()[0] == 1


MOMENT = datetime(2020, 6, 5, 19, 8, 9, 250000)


@pytest.mark.parametrize("moment", [MOMENT, datetime(1969, 12, 31, 0, 0, 59), datetime(2068, 2, 29, 12, 30)])
@pytest.mark.parametrize(
    "fmt",
    [
        "%d %b %Y", "%B %d, %Y", "%d-%b-%y", "%m/%d/%y", "%y%m%d", "%Y%m%d", "%Y-%j", "%j/%Y", "%a, %d %b %Y", "%A %d %B %Y",
        "%d.%m.%Y %I:%M %p", "%I:%M:%S %p on %d %B %Y", "%Y-%m-%dT%H:%M:%S.%f", "%b %Y", "%H:%M", "100%% %Y",
    ],
)
def test_any_strptime_format(evaluate, fmt, moment):
    shown = moment.strftime(fmt)
    found = evaluate(dates.parse_format("v", fmt), [shown, shown.upper(), shown.lower(), shown + "x", "", None])
    expected = datetime.strptime(shown, fmt)
    assert found[3:] == [None, None, None] and found[0] == expected
    assert {found[1], found[2]} <= {expected} | ({None} if "T%H" in fmt or " on " in fmt else set())


def test_zones_are_moved_to_utc(evaluate):
    values = ["5 Jan 2020 01:30 +0230", "5 Jan 2020 23:30 -01:00", "5 Jan 2020 01:30 Z", "5 Jan 2020 01:30 utc", "5 Jan 2020 01:30"]
    assert evaluate(dates.parse_format("v", "%d %b %Y %H:%M %z"), values) == [
        datetime(2020, 1, 4, 23, 0), datetime(2020, 1, 6, 0, 30), datetime(2020, 1, 5, 1, 30), datetime(2020, 1, 5, 1, 30), None,
    ]


def test_impossible_parts_are_null(evaluate):
    assert evaluate(dates.parse_format("v", "%d %b %Y"), ["30 Feb 2020", "29 Feb 2020", "5 Foo 2020", "5 January 2020"]) == [
        None, datetime(2020, 2, 29), None, None,
    ]
    assert evaluate(dates.parse_format("v", "%Y-%j"), ["2020-366", "2021-366", "2020-0"]) == [datetime(2020, 12, 31), None, None]
    assert evaluate(dates.parse_format("v", "%d.%m.%Y %I %p"), ["1.1.2020 12 AM", "1.1.2020 13 AM", "1.1.2020 12 PM"]) == [
        datetime(2020, 1, 1), None, datetime(2020, 1, 1, 12),
    ]


@pytest.mark.parametrize("fmt", ["%Q", "%d %d", "%H %I", "%B %b", "%Y %y", "%j %m %Y", "%p", "no directive", "%a"])
def test_formats_that_cannot_be_read(fmt):
    with pytest.raises(ValueError):
        dates.parse_format("v", fmt)


def test_shapes(evaluate):
    expected = {
        "5 Jan 2020": "%2 %b %Y", "January 5, 2020": "%B %2, %Y", "05-JAN-20": "%2-%b-%2", "20200105": "%8", "2020-061": "%Y-%j",
        "Mon, 05 Feb 2020 07:08:09 PM": "%a, %2 %b %Y %2:%2:%2 %p", "2020-01-05T07:08:09.123+02:00": "%Y-%2-%2T%2:%2:%2.%f%z",
        "7 May 1999 11:59pm": "%2 %b %Y %2:%2%p", "2020-01-05 07:08Z": "%Y-%2-%2 %2:%2%z", "05Jan2020": "%2%b%Y",
        "soon": "", "12 bananas": "", "mayor 5": "", " 5 Jan 2020": "", "12345": "", "": "", "100%": None,
    }
    assert evaluate(date_grammar.shape("v"), list(expected)) == list(expected.values())


@pytest.mark.parametrize(
    ("shape", "formats"),
    [
        ("%2/%2/%Y", ("%d/%m/%Y", "%m/%d/%Y")), ("%2.%2.%2 %2:%2", ("%d.%m.%y %H:%M", "%m.%d.%y %H:%M")), ("%8", ("%Y%m%d",)),
        ("%a, %2 %B %Y %2:%2:%2.%f %p %z", ("%a, %d %B %Y %I:%M:%S.%f %p %z",)), ("%2:%2", ()), ("%2 %2", ()), ("%a", ()),
        ("%Y-%2-%2T%2:%2%z", ("%Y-%m-%dT%H:%M%z",)), ("%b %Y", ("%b %Y",)), ("%2 %a %Y", ()),
    ],
)
def test_formats_of_shapes(shape, formats):
    assert date_grammar.formats_of(shape) == formats
    for fmt in formats:
        dates.parse_format("v", fmt)


@pytest.mark.parametrize(
    ("values", "formats"),
    [
        (["01/02/2020", "13/02/2020"], ("%d/%m/%Y",)), (["01/02/2020", "02/13/2020"], ("%m/%d/%Y",)),
        (["01/02/2020"], ("%d/%m/%Y",)), (["01/02/20"], ("%m/%d/%y",)), (["01/02/20", "01/13/2020", "01/02/2020"], ("%m/%d/%Y", "%m/%d/%y")),
        (["01/02/20", "13/02/2020", "01/02/2020"], ("%d/%m/%Y", "%d/%m/%y")), (["soon", None], ()),
    ],
)
def test_the_column_decides_which_is_the_day(spark, values, formats):
    df = spark.createDataFrame([(v,) for v in values], "when string")
    assert date_shapes.inferred_formats(df, ["when"]) == {"when": formats}


def test_validation_reads_dates_in_other_spellings(spark):
    rows = [(i, f"{1 + i % 28} {['Jan', 'Feb', 'March'][i % 3]} 2020") for i in range(40)]
    issues = validate(spark.createDataFrame(rows, "n int, order_date string"), as_of="2026-01-01").collect()
    found = {i["check"]: i for i in issues if i["column"] == "order_date"}
    assert "date_parse_ratio" not in found and not [i for i in issues if i["section"] == "Error"]
    assert found["text_dates"]["severity"] == "WARNING" and found["date_range"]["value"] == (datetime(2020, 3, 27) - datetime(2020, 1, 1)).days


def test_a_shape_is_sought_once_for_all_values_of_a_spelling(spark, evaluate):
    odd = [
        "5 Jan 2020", "13/02/99", "1/2/3", "20200131", "2020-01-05T07:08:09.250+02:30", "12:05 pm", "a12", "%2",
        "31.12.1999 11:59:59 PM", "Mon, 07 May 2021", "2020 366", "٣/٤/٢٠", "1e5", "", " ", "week 07", "9" * 9,
    ]
    whole = evaluate(date_grammar.shape("v"), odd)
    assert evaluate(date_grammar.shape(date_grammar.spelling("v")), odd) == whole
    days = spark.range(1000).selectExpr("date_format(date_add(DATE'2001-01-01', CAST(id AS INT)), 'dd/MM/yyyy') AS day")
    found = date_shapes.spellings(days, ["day"]).collect()
    assert [(r["spelling"], r["shape"], r["n_values"]) for r in found] == [("00/00/0000", "%2/%2/%Y", 1000)]
    assert found[0]["n_first"] > 500 and found[0]["n_second"] == 0


def test_rows_of_one_partition_are_dealt_to_every_task(spark):
    rows = spark.range(0, 1000, 1, 1)
    sizes = [len(part) for part in dealt(rows).rdd.glom().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism
    assert sum(sizes) == 1000 and max(sizes) <= 2 * 1000 / len(sizes)

from __future__ import annotations

import csv
import io
import random
from collections import Counter
from datetime import datetime
from pathlib import Path

import pytest

import gritsieve
from gritsieve.functions import text
from gritsieve.sources import delimited, quoted, staging

GOLDEN = "order_id,price,quantity\n1,10.5,2\n2,20.0,1\n3,,3\n"


@pytest.fixture
def write(tmp_path):
    def put(content, name="data.csv", encoding="utf-8"):
        path = tmp_path / name
        path.write_bytes(content.encode(encoding) if isinstance(content, str) else content)
        return str(path)

    return put


def rows_of(loaded):
    return sorted(map(tuple, loaded.df.collect()), key=str)


def test_golden_file(spark, write):
    loaded = gritsieve.validate_file(spark, write(GOLDEN), as_of="2026-01-01")
    assert loaded.df.dtypes == [("order_id", "bigint"), ("price", "double"), ("quantity", "bigint")]
    issues = loaded.issues.collect()
    assert Counter(i["severity"] for i in issues) == {"CRITICAL": 1, "WARNING": 2, "INFO": 5, "OK": 7}
    assert not [i for i in issues if i["section"] == "Error"]


@pytest.mark.parametrize("separator", [",", ";", "\t", "|"])
def test_separators(spark, write, separator):
    loaded = gritsieve.load(spark, write(f"a{separator}b\n1{separator}x\n2{separator}y\n"))
    assert loaded.layout.separator == separator
    assert rows_of(loaded) == [(1, "x"), (2, "y")]


def test_single_column_counts_as_comma(spark, write):
    loaded = gritsieve.load(spark, write("word\nx\ny\n"))
    assert loaded.layout.separator == "," and rows_of(loaded) == [("x",), ("y",)]


@pytest.mark.parametrize(
    ("encoding", "found", "word"),
    [("utf-8", "utf-8", "привет"), ("utf-8-sig", "utf-8", "привет"), ("cp1251", "cp1251", "привет"),
     ("latin-1", "latin-1", "caf\xe9\x98")],
)
def test_encodings(spark, write, encoding, found, word):
    path = write(f"{word},n\n{word},1\n{word} 2,2\n", encoding=encoding)
    loaded = gritsieve.load(spark, path)
    assert loaded.layout.encoding == found
    assert loaded.df.columns == [word, "n"]
    assert set(rows_of(loaded)) == {(word, 1), (f"{word} 2", 2)}


def test_bad_byte_at_the_end_of_the_file_decides(spark, write):
    body = "a,b\n" + "x,1\n" * 5000 + "п,2\n"
    assert gritsieve.load(spark, write(body, encoding="cp1251")).layout.encoding == "cp1251"


def test_quotes_and_line_breaks(spark, write):
    loaded = gritsieve.load(spark, write('a,b\n"x ""y"", z",1\n"two\nlines",2\n'))
    assert loaded.layout.multi_line
    assert rows_of(loaded) == [('two\nlines', 2), ('x "y", z', 1)]
    assert not gritsieve.load(spark, write('a,b\n"x ""y""",1\n')).layout.multi_line


def test_null_tokens_and_types(spark, write):
    content = (
        "whole,gap,dec,flag,flaggap,none,word,lower\n"
        "1,1,1.5,True,True,,a,na\n 2,NA,2,false,,N/A,b,Null\n3,3,1e3,TRUE,False,nan,1,-\n"
    )
    loaded = gritsieve.load(spark, write(content))
    assert dict(loaded.df.dtypes) == {
        "whole": "bigint", "gap": "double", "dec": "double", "flag": "boolean",
        "flaggap": "string", "none": "double", "word": "string", "lower": "string",
    }
    assert rows_of(loaded)[0] == (1, 1.0, 1.5, True, "True", None, "a", "na")
    assert rows_of(loaded)[1] == (2, None, 2.0, False, None, None, "b", "Null")


def test_huge_integers_become_doubles(spark, write):
    loaded = gritsieve.load(spark, write("n,x\n99999999999999999999,1\n1,2\n"))
    assert dict(loaded.df.dtypes)["n"] == "double"


def test_repeated_and_blank_headers_are_reported(spark, write):
    loaded = gritsieve.validate_file(spark, write("a,,a\n1,2,3\n4,5,6\n"))
    assert loaded.df.columns == ["a", "Unnamed: 1", "a.1"]
    checks = {i["check"]: i["severity"] for i in loaded.issues.collect()}
    assert checks["blank_names"] == "CRITICAL" and checks["duplicate_names"] == "CRITICAL"
    assert checks["technical_columns"] == "WARNING"


def test_missing_file_and_odd_extension(spark, write, tmp_path):
    gone = gritsieve.load(spark, str(tmp_path / "gone.csv"))
    assert not gone.ok
    assert [(i["severity"], i["check"]) for i in gone.issues.collect()] == [
        ("CRITICAL", "file_missing")
    ]
    odd = gritsieve.load(spark, write(GOLDEN, name="data.txt"))
    assert odd.ok
    assert [i["severity"] for i in odd.issues.collect()] == ["WARNING", "INFO"]


def test_empty_file_is_critical(spark, write):
    loaded = gritsieve.validate_file(spark, write(""))
    assert not loaded.ok
    assert [i["check"] for i in loaded.issues.collect()] == ["file_unreadable"]


def test_header_only(spark, write):
    loaded = gritsieve.load(spark, write("a,b\n"))
    assert loaded.ok and loaded.df.count() == 0


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'say "x", y', 1.5, datetime(2020, 1, 2, 3, 4, 5)), (2, None, None, None)],
        "i bigint, s string, d double, t timestamp_ntz",
    )
    path = gritsieve.write_cleaned(df, str(tmp_path), "/in/sales.csv")
    assert path.endswith("sales_cleaned.csv")
    loaded = gritsieve.load(spark, path)
    assert rows_of(loaded) == [
        (1, 'say "x", y', 1.5, "2020-01-02 03:04:05"), (2, None, None, None),
    ]


def test_preview(spark):
    df = spark.range(300).selectExpr(
        "id", "CAST('NaN' AS DOUBLE) AS x", "CAST('2020-01-02' AS TIMESTAMP_NTZ) AS t",
        "date'2020-01-02' AS d",
    )
    rows = gritsieve.preview(df.repartition(4), ["id"]).collect()
    assert [r["id"] for r in rows] == list(range(100))
    assert tuple(rows[0]) == (0, None, "2020-01-02 00:00:00", "2020-01-02")
    plan = gritsieve.preview(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_describe(spark):
    rows = delimited.describe(spark.range(7).selectExpr("id", "'x' AS s")).collect()
    assert [tuple(r) for r in rows] == [(0, "id", "bigint", 7, 2), (1, "s", "string", 7, 2)]


def test_staging_uses_the_shared_folder(spark):
    staged = staging.stage(spark.range(5).selectExpr("id AS `odd name`"))
    (file, *_) = staged.inputFiles()
    assert spark.conf.get("spark.checkpoint.dir") in file
    assert staged.count() == 5


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of a few bytes, so that records lie over many of them."""
    names = {"spark.sql.files.maxPartitionBytes": "61", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def as_read(cells):
    return tuple(cell if cell not in text.CSV_NULL_TOKENS else None for cell in cells)


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", range(2))
def test_quoted_line_breaks_over_many_ranges(spark, write, small_ranges, seed, line_end):
    rng = random.Random(seed)
    cells = lambda: ["".join(rng.choices('ab",\n é', k=rng.randint(0, 30))) for _ in range(3)]
    rows = [cells() for _ in range(60)] + [["x" * 200 + "\n" * 70 + '"', "", "y"], ["1", "2", "3"]]
    out = io.StringIO()
    csv.writer(out, lineterminator=line_end).writerows([["first\nname", "b", "c"], *rows])
    path = write(out.getvalue().encode())
    layout = delimited.Layout(",", "utf-8", ("first\nname", "b", "c"), True)
    ranges = quoted.lines(spark, path).select("start").distinct().count()
    assert ranges > 20
    found = delimited.read_text_table(spark, path, layout).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(as_read, rows), key=str)


def test_ranges_that_begin_inside_a_cell(spark, write, small_ranges):
    path = write('a,b\n1,"' + "long\ntext " * 30 + '"\n5" pipe,x\n' + "plain,row\n" * 20 + '"open\n')
    states = quoted.range_states(quoted.lines(spark, path), ",").orderBy("start").collect()
    begins = [row["begins_inside"] for row in states]
    data = Path(path).read_bytes()
    closing = data.index(b'"\n5"')
    firsts = [data.index(b"\n", row["start"]) + 1 if row["start"] else 0 for row in states]  # lines, not bytes
    assert begins == [7 < first <= closing for first in firsts] and sum(begins) > 3


def test_state_of_a_line_is_that_of_a_csv_reader():
    rng = random.Random(3)
    for _ in range(3000):
        content = "".join(rng.choices('ab,"\n', weights=[3, 2, 3, 4, 2], k=rng.randint(1, 25)))
        inside, records = False, 0
        for line in content.split("\n"):
            inside = quoted.ends_inside(line.encode(), inside, b',"')
            records += not inside
        ended = content if inside else content + "\n"
        assert records + inside == len(list(csv.reader(io.StringIO(ended, newline=""))))


def test_cp1251_with_quoted_line_breaks(spark, write, small_ranges):
    content = 'имя;n\n"два\nслова ""и"" ещё";1\nпривет;2\n\n  \n'
    loaded = gritsieve.load(spark, write(content, encoding="cp1251"))
    assert loaded.layout.multi_line and loaded.layout.encoding == "cp1251"
    assert rows_of(loaded) == [("два\nслова \"и\" ещё", 1), ("привет", 2)]


def test_carriage_returns_alone_end_lines(spark, write):
    loaded = gritsieve.load(spark, write('a,b\r"x\ry",1\rz,2\r'))
    assert rows_of(loaded) == [("x\ry", 1), ("z", 2)]


def test_folder_of_files_with_layouts_of_their_own(spark, write):
    write("id,name\n1,x\n2,y\n", "one.csv")
    write("id,name\n5,z\n", "two words.csv")
    path = write("name;id;more\nпривет;3;4\n", "three.csv", encoding="cp1251")
    write("", "empty.csv")
    loaded = gritsieve.load(spark, str(Path(path).parent))
    assert sorted(loaded.df.select("id", "name", "more").collect()) == [
        (1, "x", None), (2, "y", None), (3, "привет", 4.0), (5, "z", None),
    ]
    assert loaded.header == ("id", "name", "more") and [len(x.files) for x in loaded.layouts] == [2, 1]
    issues = [i for i in loaded.issues.collect() if i["check"] != "file_extension"]
    assert Counter((i["check"], i["severity"]) for i in issues) == {
        ("files_differ", "WARNING"): 1, ("file_loaded", "INFO"): 2,
    }
    assert len({i["issue_id"] for i in issues}) == 3


def test_export_keeps_spaces_around_cells(spark, tmp_path):
    df = spark.createDataFrame([(1, "  x "), (2, "y\n "), (3, ' "q" ')], "id long, word string")
    path = gritsieve.write_cleaned(df, str(tmp_path), "/data/words.csv")
    loaded = gritsieve.load(spark, path)
    assert sorted(map(tuple, loaded.df.collect())) == [(1, "  x "), (2, "y\n "), (3, ' "q" ')]

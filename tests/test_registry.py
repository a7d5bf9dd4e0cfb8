"""Every registered query against its reference SQL, and properties of the plans."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as registry
from catalog import queries as catalog_queries
from catalog.fixture import dirty_sales
from catalog.queries import PLAN, report, shown
from gritsieve.operators.fixes import FIXES, apply_plan
from tests.compare import connect, difference

ROOT = Path(__file__).resolve().parents[1]
FOLDER = "/root/testdata/sf0.001"
REPORTS = (
    "validate_report", "validate_lineitem", "severity_summary", "report_ordered",
    "section_status", "report_filtered", "overall_status", "clean_then_validate",
    "revalidated_plan", "unreadable_column", "plan_outcomes", "file_layouts",
)
QUERIES, ORACLES = catalog_queries.QUERIES, registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_reference_sql():
    assert set(QUERIES) <= set(ORACLES)


def test_every_fix_has_a_query():
    registered = {name.removeprefix("fix_") for name in QUERIES if name.startswith("fix_")}
    assert set(FIXES) - registered == {"drop_full_duplicate_columns"}
    assert "drop_duplicate_columns" in registered


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert difference(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) is None


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["section", "check", "column", "severity", "value"]
    assert df.count() > 0


@pytest.mark.parametrize("partitions", [1, 17])
def test_results_do_not_depend_on_partitioning(spark, partitions):
    df = dirty_sales(spark, FOLDER)
    expected = sorted(map(str, shown(report(df)).collect()))
    assert sorted(map(str, shown(report(df.repartition(partitions))).collect())) == expected
    plan = (("drop_col_duplicates", {"col": "order_id"}), *PLAN)
    cleaned = sorted(map(str, apply_plan(df, plan, order_by=["row_id"]).collect()))
    moved = apply_plan(df.repartition(partitions), plan, order_by=["row_id"])
    assert sorted(map(str, moved.collect())) == cleaned


def test_plans_have_no_cross_join_and_no_python(spark):
    for name, query in QUERIES.items():
        if name in REPORTS:  # a report is a local relation by then
            continue
        plan = query(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|NestedLoopJoin|EvalPython|InPandas", plan), name


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["date_density"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan


def test_names_in_the_catalogue():
    assert catalog_queries.QUERIES.keys() <= registry.queries().keys()


@pytest.mark.parametrize("missing", ["gritsieve.llm", "corpus_pipeline", "ahocorasick", "public_tokenizers"])
def test_other_queries_are_there_without_the_text_part(missing):
    """Whether the part is not there at all or a module that it needs cannot be imported."""
    code = (
        f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; "
        "print(len(e.queries()), 'validate_report' in e.queries(), any(x.startswith('op') for x in e.queries()))"
    )
    done = subprocess.run([sys.executable, "-W", "always", "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(QUERIES)), "True", "False"], done.stderr
    assert ("left out" in done.stderr) == (missing in ("ahocorasick", "public_tokenizers"))

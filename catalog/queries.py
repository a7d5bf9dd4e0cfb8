"""The registered queries: every operator on tables derived from the given ones."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import gritsieve
from catalog.fixture import (
    AS_OF, DATED, MONTHLY, SPELLED, TOKENS, TYPED, dealt, derived, dirty_sales, spelled, table,
)
from gritsieve import roles
from gritsieve.functions import dates, numbers, text
from gritsieve.functions.text import ident, literal
from gritsieve.operators import calendar, checks, duplicates, quantiles, values
from gritsieve.operators import date_shapes as spellings
from gritsieve.operators.checks import run_check
from gritsieve.operators.fixes import apply_plan
from gritsieve.operators.profile import column_profile, table_profile
from gritsieve.plans.clean import clean, clean_then_validate
from gritsieve.sources import delimited
from gritsieve.sources.staging import shared_folder, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ROW_ORDER = ("row_id", "order_id")


def on_dirty(function: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: function(dirty_sales(spark, folder))


def register(name: str, query: Query) -> None:
    QUERIES[name] = query


def query(function: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a function of ``dirty_sales`` under its name."""
    register(function.__name__, on_dirty(function))
    return function


def profile_check(name: str, measures: tuple[str, ...], *shown: str) -> None:
    """A check of single columns that needs only the scan."""
    register(name, on_dirty(
        lambda df: run_check(name, column_profile(df, *measures)).selectExpr(
            "column", "severity", *shown
        )
    ))


def ids(df: DataFrame) -> list[str]:
    return [name for name in df.columns if roles.is_id(name)]


# Scans, sources, sinks


@query
def describe_shape(df: DataFrame) -> DataFrame:
    return delimited.describe(df)


@query
def preview_100(df: DataFrame) -> DataFrame:
    return gritsieve.preview(df, ("row_id", *(n for n in df.columns if n != "row_id")))


def null_tokens_on_load(spark: SparkSession, folder: str) -> DataFrame:
    df = derived(spark, folder, TOKENS)
    return df.selectExpr("o_orderkey", f"{text.csv_null_tokens_to_null('raw')} AS cleaned")


def infer_types(spark: SparkSession, folder: str) -> DataFrame:
    return delimited.inferred_types(derived(spark, folder, TYPED))


# Scalars


@query
def to_number(df: DataFrame) -> DataFrame:
    return df.selectExpr("row_id", f"{numbers.text_to_number('order_id')} AS number")


@query
def clean_currency(df: DataFrame) -> DataFrame:
    return df.selectExpr("row_id", f"{numbers.clean_currency('revenue')} AS amount")


@query
def strip_lower(df: DataFrame) -> DataFrame:
    return df.selectExpr("row_id", f"{text.strip_lower('category')} AS normal")


def title_case(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.selectExpr("o_orderkey", f"{text.title_case('o_orderpriority')} AS title")


@query
def pseudo_null_flag(df: DataFrame) -> DataFrame:
    return df.selectExpr("row_id", f"{text.is_placeholder('category')} AS is_placeholder")


# Structure


def few_rows(spark: SparkSession, folder: str) -> DataFrame:
    by_status = table(spark, folder, "orders").groupBy("o_orderstatus").count()
    sources = {"region": table(spark, folder, "region"), "orders_by_status": by_status}
    return values.union(
        [
            run_check("few_rows", table_profile(df)).select(
                F.lit(name).alias("source"), "n_rows", "severity"
            )
            for name, df in sources.items()
        ]
    )


@query
def empty_columns(df: DataFrame) -> DataFrame:
    return column_profile(df, "n_values").where("n_values = 0").select("column", "n_rows")


def _written_csv(df: DataFrame, path: str, **options) -> str:
    """A folder of delimited files that lose nothing of the cells."""
    df.write.options(
        header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False, **options,
    ).csv(path)
    return path


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def quoted_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The documents written as text with quoted line breaks, and read back by many tasks."""
    path = _written_csv(table(spark, folder, "documents"), _new_folder(spark, "quoted"))
    read = delimited.read_text_table(spark, path, delimited.sniff(spark, path))
    return read.selectExpr(
        "try_cast(doc_id AS BIGINT) AS doc_id", "text", "lang", "source",
        "try_cast(n_chars AS BIGINT) AS n_chars",
    )


def mixed_layouts(spark: SparkSession, folder: str) -> str:
    """Suppliers, customers and nations in one folder, each table in a layout of its own."""
    path = _new_folder(spark, "mixed")
    _written_csv(table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS id", "s_name AS name", "s_nationkey AS nation", "s_acctbal AS balance"
    ), f"{path}/suppliers")
    word = "Заказчик".encode("cp1251").decode("latin-1")  # the same bytes in a charset that Spark writes
    _written_csv(table(spark, folder, "customer").selectExpr(
        "c_acctbal AS balance", "c_custkey AS id", f"concat('{word} ', c_name) AS name",
        "c_mktsegment AS segment",
    ), f"{path}/customers", sep=";", encoding="ISO-8859-1")
    _written_csv(table(spark, folder, "nation").selectExpr(
        "concat(n_name, '\n', n_regionkey) AS name", "n_nationkey AS id"
    ), f"{path}/nations", sep="\t")
    return f"{path}/*"


def folder_of_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Files of three layouts read as one table, their columns put together by name."""
    loaded = delimited.load(spark, mixed_layouts(spark, folder))
    return loaded.df.selectExpr("id", "name", "nation", "balance", "segment")


def file_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """The layouts that were found in that folder."""
    found = delimited.layouts(spark, mixed_layouts(spark, folder))
    return found.select("encoding", "separator", "n_columns", "quoted_line_breaks").distinct()


# Types


def date_format_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each date column each candidate format reads."""
    profile = column_profile(derived(spark, folder, DATED), "n_values", "date_hits")
    names = f"array{text.one_of(dates.CANDIDATES)}"
    return (
        profile.where("date_hits IS NOT NULL")
        .selectExpr("`column`", "n_values", "posexplode(date_hits) AS (place, n_parsed)")
        .selectExpr(
            "`column`",
            f"get({names}, place) AS date_format",
            "n_parsed",
            "round(try_divide(n_parsed, n_values), 6) AS ratio",
        )
    )


def best_date_format(spark: SparkSession, folder: str) -> DataFrame:
    profile = column_profile(derived(spark, folder, DATED), "n_values", "date_hits")
    return profile.where("date_hits IS NOT NULL").selectExpr(
        "`column`",
        f"{dates.best_format('date_hits')} AS date_format",
        "array_max(date_hits) AS n_parsed",
    )


SPELLED_COLUMNS = tuple(name for name in SPELLED if name != "o_orderkey")


def date_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """How the dates of each column are spelled, and what the format of each spelling reads."""
    return spellings.date_shapes(spelled(spark, folder), SPELLED_COLUMNS)


def spelled_dates(spark: SparkSession, folder: str) -> DataFrame:
    """All these columns converted without being told a format."""
    plan = [("cast_to_datetime", {"col": name}) for name in SPELLED_COLUMNS]
    return apply_plan(spelled(spark, folder), plan)


@query
def text_dates(df: DataFrame) -> DataFrame:
    profile = column_profile(df, "n_values", "date_hits")
    return run_check("text_dates", profile).selectExpr(
        "`column`", "severity", f"{dates.best_format('date_hits')} AS date_format",
        f"round({checks.DATE_RATIO}, 6) AS ratio",
    )


profile_check(
    "text_numbers", ("n_values", "n_clean"), "n_clean", "round(n_clean / n_values, 6) AS ratio"
)
profile_check(
    "mixed_types", ("n_values", "n_numeric"), "n_numeric",
    "round(n_numeric / n_values, 6) AS ratio",
)

# Missing values


@query
def null_counts(df: DataFrame) -> DataFrame:
    return column_profile(df, "n_values").selectExpr(
        "column", f"{checks.NULLS} AS n_null", f"{checks.NAMED_CRITICAL} AS is_critical"
    )


profile_check("null_severity", ("n_values",), f"{checks.NULLS} AS n_null")


@query
def fix_proposals(df: DataFrame) -> DataFrame:
    """The fixes offered for each column with missing values."""
    profile = column_profile(df, "n_values", "mean")
    gaps = profile.where("n_rows > n_values AND n_values > 0 AND kind = 'numeric'")
    counts = {row["column"]: row["n_values"] for row in gaps.collect()}
    medians = quantiles.exact_quantiles(df, counts, (0.5,))
    cases = " ".join(
        f"WHEN `column` = {literal(name)} THEN {quantiles.double(value)}"
        for name, (value,) in medians.items()
    )
    median = f"CASE {cases} END" if cases else "CAST(NULL AS DOUBLE)"
    finding = checks.BY_NAME["null_severity"].finding(0)
    return (
        profile.selectExpr("*", f"{median} AS median")
        .selectExpr(f"inline(array_compact(array({finding})))")
        .selectExpr("`column`", "inline(fixes)")
        .select("column", "fix_id", "label")
    )


@query
def mostly_empty_rows(df: DataFrame) -> DataFrame:
    narrow = df.select("order_id", "quantity", "price", "unnamed_0")
    return run_check("mostly_empty_rows", table_profile(narrow, "n_mostly_empty")).select(
        "n_rows", "n_mostly_empty", "severity"
    )


@query
def pseudo_null_counts(df: DataFrame) -> DataFrame:
    return column_profile(df, "n_pseudo").where("kind = 'text'").select("column", "n_pseudo")


# Duplicates


@query
def full_duplicates(df: DataFrame) -> DataFrame:
    return duplicates.duplicate_rows(df)


@query
def id_duplicates(df: DataFrame) -> DataFrame:
    return run_check("id_duplicates", values.distinct_counts(df, ids(df))).selectExpr(
        "column", "severity", "n_values", "n_values - n_distinct AS n_duplicates"
    )


@query
def soft_key_duplicates(df: DataFrame) -> DataFrame:
    return duplicates.surplus_rows(df, roles.soft_key(df.columns))


# Numbers

profile_check("negative_values", ("n_negative", "min_value"), "n_negative", "min_value")
profile_check("zero_values", ("n_zero",), "n_zero")
profile_check("percent_out_of_range", ("n_out_of_range",), "n_out_of_range")


@query
def iqr_outliers(df: DataFrame) -> DataFrame:
    numeric = [field.name for field in roles.fields_of(df, "numeric")]
    profile = column_profile(df.select(*map(ident, numeric)), "n_values").collect()
    counts = {row["column"]: row["n_values"] for row in profile if row["n_values"] > 0}
    found = quantiles.outlier_counts(df, quantiles.exact_quantiles(df, counts))
    return run_check("iqr_outliers", found).selectExpr(
        "column", "severity", "n_outliers", "min_value", "max_value",
        "round(q1, 4) AS q1", "round(median, 4) AS median", "round(q3, 4) AS q3",
    )


@query
def total_mismatch(df: DataFrame) -> DataFrame:
    return table_profile(df, "n_mismatch").select("n_mismatch")


# Categories


@query
def category_columns(df: DataFrame) -> DataFrame:
    return values.category_summary(df).where(checks.IS_CATEGORY).select(
        "column", "n_values", "n_distinct"
    )


def category_check(name: str, *shown: str) -> None:
    register(name, on_dirty(
        lambda df: run_check(name, values.category_summary(df)).selectExpr(
            "column", "severity", *shown
        )
    ))


category_check("case_variants", "n_distinct", "n_normalised")
category_check("category_placeholders", "n_placeholder")


def high_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "CAST(o_custkey AS STRING) AS segment"
    )
    return run_check("high_cardinality", values.category_summary(customers)).select(
        "column", "severity", "n_distinct"
    )


@query
def category_values(df: DataFrame) -> DataFrame:
    few = run_check("category_values", values.category_summary(df)).select(
        "column", "severity", "n_distinct"
    )
    listed = values.smallest_values(df, values.category_candidates(df))
    return few.join(listed, "column").select(
        "column", "severity", "n_distinct", F.array_join("listed", "|").alias("listed")
    )


# Dates


@query
def date_parse_ratio(df: DataFrame) -> DataFrame:
    return column_profile(df, "n_values", "date_hits").where("date_hits IS NOT NULL").selectExpr(
        "column", "n_values", "array_max(date_hits) AS n_parsed",
        f"{checks.DATE_RATIO} < 0.8 AS too_few",
    )


def date_check(name: str, *shown: str) -> None:
    register(name, on_dirty(
        lambda df: run_check(
            name, calendar.date_summary(df, calendar.date_formats(df), AS_OF)
        ).selectExpr("column", "severity", *shown)
    ))


SPAN = "timestampdiff(DAY, first_date, last_date)"
date_check("unparsed_dates", "n_unparsed")
date_check("future_dates", "n_future")
date_check("old_dates", "n_old")
date_check(
    "date_range", "date_format(first_date, 'yyyy-MM-dd') AS first_date",
    "date_format(last_date, 'yyyy-MM-dd') AS last_date", f"{SPAN} AS n_days",
)


def ambiguous_dates(spark: SparkSession, folder: str) -> DataFrame:
    df = derived(spark, folder, DATED)
    return column_profile(df, "n_ambiguous").where("n_ambiguous > 0").select(
        "column", "n_ambiguous"
    )


def date_density(spark: SparkSession, folder: str) -> DataFrame:
    df = derived(spark, folder, MONTHLY)
    summary = calendar.date_summary(df, calendar.date_formats(df), AS_OF)
    return run_check("date_density", summary).selectExpr(
        "column", "severity", "n_days", f"{SPAN} + 1 AS n_possible"
    )


# Keys

profile_check(
    "null_ids", ("n_values",), f"{checks.NULLS} AS n_null"
)
profile_check(
    "mixed_id_types", ("n_values", "n_numeric"), "n_numeric",
    "round(n_numeric / n_values, 6) AS ratio",
)


@query
def id_length_histogram(df: DataFrame) -> DataFrame:
    return values.length_histogram(df, ids(df))


@query
def id_lengths(df: DataFrame) -> DataFrame:
    """Keys of uneven length with their most frequent lengths."""
    return run_check("id_lengths", values.length_summary(df, ids(df))).selectExpr(
        "column", "severity", "n_lengths",
        "array_join(transform(top_lengths, e -> concat(e.length, ':', e.n)), '|') AS top_lengths",
    )


@query
def id_maps_to_many_categories(df: DataFrame) -> DataFrame:
    found = {
        row["column"]: row["n_hashes"] == row["n_distinct"]
        for row in values.category_summary(df).where(checks.IS_CATEGORY).collect()
    }
    chosen = [name for name in df.columns if name in found]
    wanted = {key: [name for name in chosen if name != key][:2] for key in ids(df)}
    hashable = [name for name in chosen if found[name]]
    return run_check(
        "id_maps_to_many_categories", duplicates.multi_valued_keys(df, wanted, hashable)
    ).select("column", "category", "n_keys", "severity")


# Business logic


@query
def discount_not_applied(df: DataFrame) -> DataFrame:
    return table_profile(df, "n_discount_ignored").select("n_discount_ignored")


@query
def product_multi_category(df: DataFrame) -> DataFrame:
    product, category = roles.product_id_column(df.columns), roles.category_column(df.columns)
    return duplicates.multi_valued_keys(df, {product: [category]})


@query
def suspicious_payment(df: DataFrame) -> DataFrame:
    return values.suspicious_values(df, roles.payment_column(df.columns))


# Fixes


def fix_query(name: str, fix_id: str | None = None, **params: str) -> None:
    register(name, on_dirty(
        lambda df: gritsieve.apply_fix(
            df, fix_id or name.removeprefix("fix_"), params, as_of=AS_OF, order_by=ROW_ORDER
        )
    ))


fix_query("fix_fill_mean", col="price")
fix_query("fix_fill_median", col="price")
fix_query("fix_fill_mode", col="order_id")
fix_query("fix_fill_zero", col="quantity")
fix_query("fix_fill_unknown", col="order_id")
fix_query("fix_drop_null_rows", col="price")
fix_query("fix_drop_full_duplicates")
fix_query("fix_drop_col_duplicates", col="order_id")
fix_query("fix_cast_to_numeric", col="revenue")
fix_query("fix_cast_to_datetime", col="order_date", format="%Y-%m-%d")
fix_query("fix_cast_to_string", col="customer_id")
fix_query("fix_strip_lowercase", col="category")
fix_query("fix_strip_titlecase", col="category")
fix_query("fix_replace_pseudo_nulls", col="category")
fix_query("fix_drop_negative_rows", col="quantity")
fix_query("fix_abs_negative", col="quantity")
fix_query("fix_cap_outliers_iqr", col="price")
fix_query("fix_drop_zero_rows", col="price")
fix_query("fix_percent_divide_100", col="discount")
fix_query("fix_drop_column", col="unnamed_0")
fix_query("fix_drop_empty_columns")
fix_query("fix_drop_future_dates", col="order_date")


@query
def fix_drop_duplicate_columns(df: DataFrame) -> DataFrame:
    repeated = df.select("*", F.col("price"), F.col("row_id"))
    return gritsieve.apply_fix(repeated, "drop_full_duplicate_columns")


AUDITED = (
    ("fill_mean", {"col": "price"}),
    ("fill_mode", {"col": "order_id"}),
    ("drop_null_rows", {"col": "price"}),
    ("drop_full_duplicates", {}),
    ("drop_col_duplicates", {"col": "order_id"}),
    ("replace_pseudo_nulls", {"col": "category"}),
    ("drop_negative_rows", {"col": "quantity"}),
    ("cap_outliers_iqr", {"col": "price"}),
    ("drop_zero_rows", {"col": "price"}),
    ("drop_future_dates", {"col": "order_date"}),
    ("drop_empty_columns", {}),
)


@query
def fix_audit(df: DataFrame) -> DataFrame:
    return values.union(
        [
            gritsieve.audit(df, fix_id, params, as_of=AS_OF, order_by=ROW_ORDER)
            for fix_id, params in AUDITED
        ]
    ).drop("statistic", "message")


# Reports

REPORTED = ("section", "check", "column", "severity", "value")


def report(df: DataFrame) -> DataFrame:
    return gritsieve.validate(df, as_of=AS_OF, order_by=ROW_ORDER)


def shown(issues: DataFrame) -> DataFrame:
    return issues.select(*REPORTED[:-1], F.round("value", 6).alias("value"))


@query
def validate_report(df: DataFrame) -> DataFrame:
    return shown(report(df))


def validate_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return shown(report(table(spark, folder, "lineitem")))


@query
def unreadable_column(df: DataFrame) -> DataFrame:
    """The report of a table with a column that fails in some row whenever it is read."""
    return shown(report(df.withColumn("broken", F.expr("CAST(substring(revenue, 1, 3) AS INT)"))))


@query
def severity_summary(df: DataFrame) -> DataFrame:
    return gritsieve.severity_summary(report(df))


@query
def report_ordered(df: DataFrame) -> DataFrame:
    return shown(gritsieve.ordered(report(df)))


@query
def section_status(df: DataFrame) -> DataFrame:
    return gritsieve.section_status(report(df))


@query
def report_filtered(df: DataFrame) -> DataFrame:
    return shown(gritsieve.with_severity(report(df), "CRITICAL"))


@query
def overall_status(df: DataFrame) -> DataFrame:
    return gritsieve.overall_status(report(df))


PLAN = (
    ("drop_full_duplicates", {}),
    ("replace_pseudo_nulls", {"col": "category"}),
    ("strip_lowercase", {"col": "category"}),
    ("cast_to_numeric", {"col": "revenue"}),
    ("cast_to_datetime", {"col": "order_date", "format": "%Y-%m-%d"}),
    ("drop_future_dates", {"col": "order_date"}),
    ("drop_negative_rows", {"col": "quantity"}),
    ("cap_outliers_iqr", {"col": "price"}),
    ("fill_median", {"col": "price"}),
    ("drop_empty_columns", {}),
)


def clean_and_report(df: DataFrame) -> DataFrame:
    _, issues = clean_then_validate(df, PLAN, as_of=AS_OF, order_by=ROW_ORDER)
    return shown(issues)


register("clean_then_validate", on_dirty(clean_and_report))


@query
def revalidated_plan(df: DataFrame) -> DataFrame:
    """The report after that plan, measured again after each fix as far as the fix reaches."""
    state = gritsieve.measured(stage(dealt(df)), as_of=AS_OF, order_by=ROW_ORDER)
    for fix_id, params in PLAN:
        state = gritsieve.revalidated(state, fix_id, params)
    return shown(state.issues)


@query
def plan_outcomes(df: DataFrame) -> DataFrame:
    """What each fix of that plan did, counted while the cleaned table was written."""
    return clean(df, PLAN, as_of=AS_OF, order_by=ROW_ORDER)[1]


@query
def column_samples(df: DataFrame) -> DataFrame:
    """The first five values of each text column in row order."""
    columns = [field.name for field in roles.fields_of(df, "text")]
    return values.column_samples(df, columns, ROW_ORDER).select(
        "column", F.array_join("sample", "|").alias("sample")
    )


for _function in (
    null_tokens_on_load, infer_types, title_case, few_rows, date_format_ratios, best_date_format,
    high_cardinality, ambiguous_dates, date_density, validate_lineitem, quoted_csv,
    folder_of_layouts, file_layouts, date_shapes, spelled_dates,
):
    register(_function.__name__, _function)

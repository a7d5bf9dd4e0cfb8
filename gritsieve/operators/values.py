"""Measures that need grouping by value.

A histogram of values is built with partial aggregation, so a value that fills a
third of the table leaves each task as one row. Later steps read only the
histogram.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gritsieve import roles
from gritsieve.functions import text
from gritsieve.functions.text import ident, literal
from gritsieve.operators.profile import FEW_VALUES, column_profile

LISTED_VALUES = 20
LISTED_LENGTHS = 5
LISTED_SUSPECTS = 5
LONGEST_PAYMENT = 50

_HISTOGRAM = "column string, value string, n bigint"


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns as text, one (column, value) row per non-null cell."""
    cells = (
        f"struct({literal(name)} AS `column`, CAST({ident(name)} AS STRING) AS value)"
        for name in columns
    )
    return df.selectExpr(f"inline(array({', '.join(cells)}))").where("value IS NOT NULL")


def histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): how often each non-null value occurs."""
    if not columns:
        return df.sparkSession.createDataFrame([], _HISTOGRAM)
    return _cells(df, columns).groupBy("column", "value").agg(F.expr("count(1) AS n"))


def category_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column with any value: distinct values raw and normalised, placeholder rows.

    ``n_hashes`` tells whether 64-bit hashes keep the values apart, see
    ``duplicates.key_summary``.
    """
    normal = text.strip_lower("value")
    placeholder = f"{normal} IN {text.one_of(text.PLACEHOLDERS)}"
    return (
        histogram(df, columns)
        .groupBy("column")
        .agg(
            F.expr("sum(n) AS n_values"),
            F.expr("count(1) AS n_distinct"),
            F.expr(f"count(DISTINCT {normal}) AS n_normalised"),
            F.expr("count(DISTINCT xxhash64(value)) AS n_hashes"),
            F.expr(f"sum(CASE WHEN {placeholder} THEN n ELSE 0 END) AS n_placeholder"),
        )
    )


def category_candidates(df: DataFrame) -> list[str]:
    """Columns that are categories by name, or may be by having few values.

    The second kind is found by one scan without a shuffle, so that free text is
    never grouped by value.
    """
    named = [name for name in df.columns if roles.is_category_name(name)]
    if not any(field.name not in named for field in roles.fields_of(df, "text")):
        return named
    few = column_profile(df, "n_values", "distinct_floor").where(
        f"n_values > 0 AND distinct_floor <= {FEW_VALUES}"
    )
    found = {row["column"] for row in few.select("column").collect()}
    return [name for name in df.columns if name in named or name in found]


def category_summary(df: DataFrame) -> DataFrame:
    """``category_values`` of the candidates, with the kind of the column."""
    columns = category_candidates(df)
    kinds = ", ".join(
        f"{literal(field.name)}, {literal(roles.kind(field.dataType))}"
        for field in df.schema.fields
    )
    return category_values(df, columns).selectExpr("*", f"map({kinds})[`column`] AS kind")


def smallest_values(df: DataFrame, columns: Sequence[str], k: int = LISTED_VALUES) -> DataFrame:
    """(column, listed): up to k distinct values of each column, in order.

    The rank limit is applied before the shuffle as well (a partial group limit),
    so no task holds more than k values of a column.
    """
    place = "row_number() OVER (PARTITION BY `column` ORDER BY value) AS place"
    return (
        histogram(df, columns)
        .selectExpr("`column`", "value", place)
        .where(f"place <= {k}")
        .groupBy("column")
        .agg(F.expr("array_sort(collect_list(value)) AS listed"))
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_values, n_distinct), each column counted in its own type.

    One branch per column: a single multi-column distinct aggregate would copy
    every row once per column before the shuffle.
    """
    return union(
        [
            df.selectExpr(
                f"{literal(name)} AS `column`",
                f"count({ident(name)}) AS n_values",
                f"count(DISTINCT {ident(name)}) AS n_distinct",
            )
            for name in columns
        ]
    )


def length_histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, length, n): text lengths of the non-null values."""
    lengths = (
        f"struct({literal(name)} AS `column`, "
        f"CAST(length(CAST({ident(name)} AS STRING)) AS BIGINT) AS length)"
        for name in columns
    )
    return (
        df.selectExpr(f"inline(array({', '.join(lengths)}))")
        .where("length IS NOT NULL")
        .groupBy("column", "length")
        .agg(F.expr("count(1) AS n"))
    )


def length_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_lengths, top_lengths): the five most frequent lengths."""
    ranked = length_histogram(df, columns).selectExpr(
        "*",
        "row_number() OVER (PARTITION BY `column` ORDER BY n DESC, length) AS place",
        "count(1) OVER (PARTITION BY `column`) AS n_lengths",
    )
    return (
        ranked.where(f"place <= {LISTED_LENGTHS}")
        .groupBy("column")
        .agg(
            F.expr("max(n_lengths) AS n_lengths"),
            F.expr("array_sort(collect_list(struct(place, length, n))) AS top"),
        )
        .selectExpr(
            "`column`",
            "n_lengths",
            "transform(top, e -> struct(e.length AS length, e.n AS n)) AS top_lengths",
        )
    )


def suspicious_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct normalised values that are placeholders or overlong."""
    normal = text.strip_lower(f"CAST({ident(column)} AS STRING)")
    return (
        df.selectExpr(f"{literal(column)} AS `column`", f"{normal} AS value")
        .where(
            f"value IN {text.one_of(text.PLACEHOLDERS)} OR length(value) > {LONGEST_PAYMENT}"
        )
        .distinct()
    )


def column_samples(
    df: DataFrame, columns: Sequence[str], order_by: Sequence[str] = (), k: int = 5
) -> DataFrame:
    """(column, sample): the first k non-null values in the given row order.

    Each branch is a top-k (TakeOrderedAndProject): k rows per task, no full sort.
    Without a row order the smallest values are quoted.
    """
    branches = []
    for name in columns:
        value = f"CAST({ident(name)} AS STRING)"
        keys = [*map(ident, order_by), value]
        places = [f"key_{i}" for i in range(len(keys))]
        first = (
            df.where(f"{ident(name)} IS NOT NULL")
            .selectExpr(*(f"{key} AS {place}" for key, place in zip(keys, places)))
            .orderBy(*places)
            .limit(k)
        )
        entries = f"array_sort(collect_list(struct({', '.join(places)})))"
        branches.append(
            first.selectExpr(
                f"{literal(name)} AS `column`", f"{entries}.{places[-1]} AS sample"
            ).where("size(sample) > 0")
        )
    return union(branches)

"""Formats of text columns by the shapes of their values.

One aggregate counts the spellings of all columns, which have few shapes. A shape has one format, unless day and
month can change places; that is decided for a whole column by the numbers above twelve.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gritsieve.functions import date_grammar as grammar
from gritsieve.functions.dates import parse_first, parse_format
from gritsieve.functions.text import count_where, ident, literal
from gritsieve.sources.staging import stage

_TWO = r"r'(\d{1,2})\D+(\d{1,2})'"


def _spelled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, spelling) of the values that are not null."""
    cells = (
        f"struct({literal(name)} AS `column`, CAST({ident(name)} AS STRING) AS value)" for name in columns
    )
    values = df.selectExpr(f"inline(array({', '.join(cells)}))").where("value IS NOT NULL")
    return values.selectExpr("*", f"{grammar.spelling('value')} AS spelling")


def spellings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, spelling, shape, n_values, and how many have a first and a second number above
    twelve). A shape is sought once for all values of a spelling; none is null."""
    counted = (
        _spelled(df, columns)
        .groupBy("column", "spelling")
        .agg(
            F.expr("count(1) AS n_values"),
            F.expr(f"{count_where(f'try_cast(regexp_extract(value, {_TWO}, 1) AS INT) > 12')} AS n_first"),
            F.expr(f"{count_where(f'try_cast(regexp_extract(value, {_TWO}, 2) AS INT) > 12')} AS n_second"),
        )
    )
    return counted.selectExpr("*", f"nullif({grammar.shape('spelling')}, '') AS shape")


def shape_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, shape, n_values, and how many have a first and a second number above twelve).

    Each task sends a row per spelling: values that differ in their digits only are one.
    Values without a shape are counted under a null.
    """
    return _shapes(spellings(df, columns))


def _shapes(found: DataFrame) -> DataFrame:
    return found.groupBy("column", "shape").agg(
        *(F.sum(name).alias(name) for name in ("n_values", "n_first", "n_second"))
    )


def shape_formats(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, str]]:
    """For each column the format of each shape that is one of a date, the most frequent first."""
    return _formats(shape_counts(df, columns), columns)


def _formats(counts: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, str]]:
    counted: dict[str, list] = {name: [] for name in columns}
    for row in counts.where("shape IS NOT NULL").collect():
        counted[row["column"]].append(row)
    result = {}
    for name, rows in counted.items():
        open_rows = [row for row in rows if grammar.day_or_month(row["shape"])]
        # numbers above twelve in first place speak for the day there
        days_first = sum(row["n_first"] for row in open_rows)
        months_first = sum(row["n_second"] for row in open_rows)
        result[name] = {}
        for row in sorted(rows, key=lambda row: (-row["n_values"], row["shape"])):
            formats = grammar.formats_of(row["shape"])
            if len(formats) == 2:
                tie = grammar.month_first_on_tie(row["shape"])
                formats = formats[months_first > days_first or (tie and months_first == days_first) :]
            if formats:
                result[name][row["shape"]] = formats[0]
    return result


def inferred_formats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The formats that together read each column, the most frequent first."""
    found = shape_formats(df, columns)
    return {name: tuple(dict.fromkeys(formats.values())) for name, formats in found.items()}


def spelled_dates(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[tuple[str, ...], int]]:
    """For each column the formats that its spellings show, and how many values they read."""
    formats = inferred_formats(df, columns)
    counts = (
        f"count({parse_first(f'CAST({ident(name)} AS STRING)', found)}) AS {ident(name)}"
        for name, found in formats.items()
    )
    row = df.selectExpr(*counts).first()
    return {name: (found, row[name]) for name, found in formats.items()}


def date_shapes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, shape, date_format, n_values, n_parsed): how the dates of text columns are
    spelled. Each value is read by the format of its own shape only."""
    found = stage(spellings(df, columns))
    formats = _formats(_shapes(found), columns)
    known = [(name, s, f) for name, shapes in formats.items() for s, f in shapes.items()]
    chosen = " ".join(f"WHEN `column` = {literal(n)} AND shape = {literal(s)} THEN {literal(f)}" for n, s, f in known)
    parsed = " ".join(f"WHEN {literal(f)} THEN {parse_format('value', f)}" for f in dict.fromkeys(f for *_, f in known))
    format_of = f"CASE {chosen} END" if known else "CAST(NULL AS STRING)"
    moment = f"CASE date_format {parsed} END" if known else "CAST(NULL AS TIMESTAMP_NTZ)"
    shaped = found.where("shape IS NOT NULL").selectExpr("column", "spelling", "shape", f"{format_of} AS date_format")
    return (
        _spelled(df, columns).join(shaped, ["column", "spelling"], "left")
        .selectExpr("column", "shape", "date_format", f"{moment} AS moment")
        .groupBy("column", "shape", "date_format")
        .agg(F.expr("count(1) AS n_values"), F.expr("count(moment) AS n_parsed"))
    )

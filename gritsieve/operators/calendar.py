"""Range, gaps and outliers of the date columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, functions as F

from gritsieve import roles
from gritsieve.functions import dates
from gritsieve.functions.text import count_where, ident, literal
from gritsieve.operators.profile import column_profile

# Share of the values that must parse before the dates of a text column are used.
ENOUGH_DATES = 0.8


def usable_format(hits: Sequence[int], n_values: int) -> tuple[str | None, bool]:
    """The best format of a text column, and whether it reads enough of it."""
    most = max(hits)
    if most == 0:
        return None, False
    return dates.CANDIDATES[list(hits).index(most)], most / n_values >= ENOUGH_DATES


def date_formats(df: DataFrame) -> dict[str, str | None]:
    """The date columns whose dates can be used, with the format of those held as text."""
    fields = [field for field in df.schema.fields if roles.is_date(field)]
    formats: dict[str, str | None] = {}
    rows = {}
    if any(roles.kind(field.dataType) != "datetime" for field in fields):
        named = df.select(*(ident(field.name) for field in fields))
        rows = {r["column"]: r for r in column_profile(named, "n_values", "date_hits").collect()}
    for field in fields:
        if roles.kind(field.dataType) == "datetime":
            formats[field.name] = None
            continue
        row = rows[field.name]
        found, enough = usable_format(row["date_hits"], row["n_values"])
        if enough:
            formats[field.name] = found
    return formats


def date_summary(
    df: DataFrame,
    formats: Mapping[str, str | Sequence[str] | None],
    as_of: str | date | datetime | None = None,
) -> DataFrame:
    """Per date column: range, days covered, future and implausibly old dates.

    ``formats`` maps a column to the format or formats of its text (None for datetime columns).
    Dates are first folded to one row per calendar day inside each task, so what is
    shuffled is bounded by the days in the range, not by the rows.
    """
    types_by_name = {field.name: field.dataType for field in df.schema.fields}
    cells = (
        f"struct({literal(name)} AS `column`, "
        f"{dates.to_timestamp(ident(name), types_by_name[name], fmt)} AS moment, "
        f"{ident(name)} IS NOT NULL AS filled)"
        for name, fmt in formats.items()
    )
    per_day = (
        df.selectExpr(f"inline(array({', '.join(cells)}))")
        .selectExpr("*", "to_date(moment) AS day")
        .groupBy("column", "day")
        .agg(
            F.expr(f"{count_where('filled')} AS n_filled"),
            F.expr("count(moment) AS n_dates"),
            F.expr("min(moment) AS first_date"),
            F.expr("max(moment) AS last_date"),
            F.expr(f"{count_where(f'moment > {dates.moment(as_of)}')} AS n_future"),
            F.expr(f"{count_where(f'moment < {dates.OLDEST_PLAUSIBLE}')} AS n_old"),
        )
    )
    return per_day.groupBy("column").agg(
        F.expr("sum(n_filled) - sum(n_dates) AS n_unparsed"),
        F.expr("sum(n_dates) AS n_dates"),
        F.expr("count(day) AS n_days"),
        F.expr("min(first_date) AS first_date"),
        F.expr("max(last_date) AS last_date"),
        F.expr("sum(n_future) AS n_future"),
        F.expr("sum(n_old) AS n_old"),
    )

"""The cleaning transforms, each a pure DataFrame -> DataFrame function.

A fix is a new value for one column, a condition on the rows to keep, or a change
of the whole table. Statistics that a fix fills in come from scalar subqueries, so
applying it starts no job; only quantiles (``fill_median``, ``cap_outliers_iqr``),
``drop_empty_columns`` and dates of text columns without a given format look at the
data first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from gritsieve import roles
from gritsieve.functions import dates, numbers, text
from gritsieve.functions.numbers import nan_to_null
from gritsieve.functions.text import ident
from gritsieve.operators import quantiles
from gritsieve.operators.date_shapes import inferred_formats


@dataclass(frozen=True)
class Target:
    """What a fix is applied to."""

    df: DataFrame
    name: str | None
    params: Mapping[str, str] = field(default_factory=dict)
    as_of: str | date | datetime | None = None
    order_by: Sequence[str] = ()

    @property
    def column(self) -> str:
        return ident(self.name)

    @property
    def data_type(self) -> T.DataType:
        return self.df.schema[self.name].dataType

    @property
    def number(self) -> str:
        return numbers.to_number(self.column, self.data_type)

    @property
    def as_text(self) -> str:
        return f"CAST({self.column} AS STRING)"

    def date_format(self) -> str | tuple[str, ...] | None:
        """The format asked for, else those that the spellings of a text column show."""
        asked = self.params.get("format")
        if (asked is not None and asked != dates.AUTO) or roles.kind(self.data_type) != "text":
            return asked
        return inferred_formats(self.df, [self.name])[self.name]

    def quantiles(self, *probabilities: float) -> list[float | None]:
        """Exact quantiles; the count decides how they are found."""
        values = self.df.selectExpr(f"CAST({self.number} AS DOUBLE) AS value")
        counted = values.selectExpr("count(value)").first()[0]
        if counted == 0:
            return [None] * len(probabilities)
        return quantiles.exact_quantiles(values, {"value": counted}, probabilities)["value"]


@dataclass(frozen=True)
class ColumnFix:
    """A new value for every row of one column, with the statistic it used."""

    value: Column
    statistic: Column | None = None


@dataclass(frozen=True)
class RowFix:
    """Rows to keep; ``value`` replaces the tested column where the fix parses it."""

    keep: Column
    value: Column | None = None


@dataclass(frozen=True)
class TableFix:
    result: DataFrame


Fix = ColumnFix | RowFix | TableFix


def column_fix(value: str, statistic: str | None = None) -> ColumnFix:
    return ColumnFix(F.expr(value), None if statistic is None else F.expr(statistic))


def row_fix(keep: str, value: str | None = None) -> RowFix:
    return RowFix(F.expr(keep), None if value is None else F.expr(value))


def fill_mean(t: Target) -> Fix:
    mean = t.df.selectExpr(f"round(CAST(avg({t.number}) AS DOUBLE), 4) AS mean").scalar()
    return ColumnFix(F.coalesce(F.expr(f"CAST({t.number} AS DOUBLE)"), mean), mean)


def fill_median(t: Target) -> Fix:
    found = t.quantiles(0.5)[0]
    if found is None:
        return column_fix(f"CAST({t.number} AS DOUBLE)")
    median = f"round({quantiles.double(found)}, 4)"
    return column_fix(f"coalesce(CAST({t.number} AS DOUBLE), {median})", median)


def fill_mode(t: Target) -> Fix:
    """The most frequent value, the smallest on ties: a top-1 over the histogram."""
    top = (
        t.df.selectExpr(f"{t.column} AS value")
        .where("value IS NOT NULL")
        .groupBy("value")
        .agg(F.expr("count(1) AS n"))
        .orderBy(F.expr("n").desc(), "value")
        .limit(1)
    )
    mode = top.select("value").scalar()
    return ColumnFix(F.coalesce(F.expr(t.column), mode), mode.cast("string"))


def fill_zero(t: Target) -> Fix:
    of = roles.kind(t.data_type)
    if of not in ("numeric", "text"):
        return column_fix(t.column)
    return column_fix(f"coalesce({t.column}, CAST(0 AS {t.data_type.simpleString()}))")


def fill_unknown(t: Target) -> Fix:
    return column_fix(f"coalesce({t.as_text}, 'Unknown')")


def drop_null_rows(t: Target) -> Fix:
    return row_fix(f"{t.column} IS NOT NULL")


def drop_full_duplicates(t: Target) -> Fix:
    return TableFix(t.df.dropDuplicates())


def drop_col_duplicates(t: Target) -> Fix:
    """The first row of each value in the given row order; nulls count as one value.

    Rows are ranked within their value, and the planner keeps only the first of each
    value before the shuffle too, so a value that fills a third of the table costs a
    task one row. All columns are the final tie-break, which makes the result
    independent of the partitioning.
    """
    keys = [*t.order_by, *(name for name in t.df.columns if name not in t.order_by)]
    order = ", ".join(map(ident, keys))
    place = f"row_number() OVER (PARTITION BY {t.column} ORDER BY {order}) AS `place in group`"
    ranked = t.df.selectExpr("*", place)
    return TableFix(ranked.where("`place in group` = 1").drop("place in group"))


def cast_to_numeric(t: Target) -> Fix:
    if roles.kind(t.data_type) == "text":
        return column_fix(numbers.clean_currency(t.column))
    return column_fix(t.number)


def cast_to_datetime(t: Target) -> Fix:
    return column_fix(dates.to_timestamp(t.column, t.data_type, t.date_format()))


def cast_to_string(t: Target) -> Fix:
    return column_fix(t.as_text)


def strip_lowercase(t: Target) -> Fix:
    return column_fix(text.strip_lower(t.as_text))


def strip_titlecase(t: Target) -> Fix:
    return column_fix(text.title_case(text.strip(t.as_text)))


def replace_pseudo_nulls(t: Target) -> Fix:
    return column_fix(
        f"CASE WHEN NOT ({text.is_placeholder(t.as_text)}) THEN {t.column} END"
    )


def drop_negative_rows(t: Target) -> Fix:
    return row_fix(f"{t.number} IS NULL OR {t.number} >= 0", t.number)


def abs_negative(t: Target) -> Fix:
    return column_fix(f"abs({t.number})")


def cap_outliers_iqr(t: Target) -> Fix:
    quartiles = t.quantiles(*quantiles.QUARTILES)
    if None in quartiles:
        return column_fix(t.number)
    low, high = map(quantiles.double, quantiles.fences(quartiles))
    capped = numbers.clip(f"CAST({t.number} AS DOUBLE)", low, high)
    return column_fix(capped, f"format_string('[%.2f, %.2f]', {low}, {high})")


def drop_zero_rows(t: Target) -> Fix:
    return row_fix(f"{t.number} IS NULL OR {t.number} <> 0", t.number)


def percent_divide_100(t: Target) -> Fix:
    return column_fix(f"CAST({t.number} AS DOUBLE) / 100")


def drop_column(t: Target) -> Fix:
    return TableFix(t.df.drop(t.name))


def drop_empty_columns(t: Target) -> Fix:
    row = t.df.selectExpr(*(f"count({ident(name)})" for name in t.df.columns)).first()
    empty = [name for name, n in zip(t.df.columns, row) if n == 0]
    return TableFix(t.df.drop(*empty))


def drop_full_duplicate_columns(t: Target) -> Fix:
    """Equal names cannot be told apart by name, so columns are picked by position."""
    names = t.df.columns
    first = [i for i, name in enumerate(names) if names.index(name) == i]
    numbered = t.df.toDF(*(str(i) for i in range(len(names))))
    return TableFix(numbered.selectExpr(*(f"`{i}` AS {ident(names[i])}" for i in first)))


def drop_future_dates(t: Target) -> Fix:
    parsed = dates.to_timestamp(t.column, t.data_type, t.date_format())
    return row_fix(f"{parsed} IS NULL OR {parsed} <= {dates.moment(t.as_of)}")


# The names that fixes are requested by.
FIXES: dict[str, Callable[[Target], Fix]] = {
    function.__name__: function
    for function in (
        fill_mean, fill_median, fill_mode, fill_zero, fill_unknown, drop_null_rows,
        drop_full_duplicates, drop_col_duplicates, cast_to_numeric, cast_to_datetime,
        cast_to_string, strip_lowercase, strip_titlecase, replace_pseudo_nulls,
        drop_negative_rows, abs_negative, cap_outliers_iqr, drop_zero_rows, percent_divide_100,
        drop_column, drop_empty_columns, drop_full_duplicate_columns, drop_future_dates,
    )
}
# Fixes that shuffle whole rows, and fixes that look at the table before they change it.
SHUFFLES = ("drop_full_duplicates", "drop_col_duplicates")
LOOKS_FIRST = ("fill_mean", "fill_median", "fill_mode", "cap_outliers_iqr", "drop_empty_columns")
# Fixes that change the values of one column, and fixes that only take columns away.
COLUMN_FIXES = (
    "fill_mean", "fill_median", "fill_mode", "fill_zero", "fill_unknown", "cast_to_numeric",
    "cast_to_datetime", "cast_to_string", "strip_lowercase", "strip_titlecase",
    "replace_pseudo_nulls", "abs_negative", "cap_outliers_iqr", "percent_divide_100",
)
COLUMN_DROPS = ("drop_column", "drop_empty_columns")
WITHOUT_COLUMN = ("drop_full_duplicates", "drop_empty_columns", "drop_full_duplicate_columns")


def _prepare(
    df: DataFrame,
    fix_id: str,
    params: Mapping[str, str] | None,
    as_of: str | date | datetime | None,
    order_by: Sequence[str],
) -> tuple[Target, Fix]:
    params = dict(params or {})
    name = params.get("col")
    if fix_id not in WITHOUT_COLUMN and fix_id != "drop_column" and name not in df.columns:
        raise ValueError(f"{fix_id} needs an existing column, got {name!r}")
    target = Target(df, name, params, as_of, order_by)
    return target, FIXES[fix_id](target)


def _with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Replace one column in place."""
    return df.select(
        *(value.alias(name) if other == name else ident(other) for other in df.columns)
    )


def apply_fix(
    df: DataFrame,
    fix_id: str,
    params: Mapping[str, str] | None = None,
    *,
    as_of: str | date | datetime | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Apply one fix. ``params`` holds ``col`` and, for dates, ``format``.

    ``as_of`` is the time ``drop_future_dates`` compares with; ``order_by`` says
    which row is the first for ``drop_col_duplicates``.
    """
    return apply_plan(df, [(fix_id, params or {})], as_of=as_of, order_by=order_by)


def _apply(target: Target, fix: Fix) -> DataFrame:
    if isinstance(fix, ColumnFix):
        return _with_column(target.df, target.name, fix.value)
    if isinstance(fix, RowFix):
        kept = target.df.where(fix.keep)
        return kept if fix.value is None else _with_column(kept, target.name, fix.value)
    return fix.result


def apply_plan(
    df: DataFrame,
    plan: Sequence[tuple[str, Mapping[str, str]]],
    *,
    as_of: str | date | datetime | None = None,
    order_by: Sequence[str] = (),
    stage: Callable[[DataFrame], DataFrame] | None = None,
    watch: list[Watched] | None = None,
) -> DataFrame:
    """Apply a list of (fix_id, params) in order. Float NaN counts as missing throughout.

    With ``stage`` the table is written after a shuffle of whole rows when the next
    fixes need a statistic of it, so that the shuffle is not repeated for each one.
    ``watch`` is a list that gets a ``Watched`` for each fix: counts that are taken while
    the result is computed.
    """
    unknown = [fix_id for fix_id, _ in plan if fix_id not in FIXES]
    if unknown:
        raise ValueError(f"unknown fix: {', '.join(map(repr, unknown))}")
    if len(set(df.columns)) == len(df.columns):
        df = nan_to_null(df)
    shuffled = False
    for fix_id, params in plan:
        if stage is not None and shuffled and fix_id in LOOKS_FIRST:
            df, shuffled = stage(df), False
        shuffled = shuffled or fix_id in SHUFFLES
        target, fix = _prepare(df, fix_id, params, as_of, order_by)
        if watch is None:
            df = _apply(target, fix)
        else:
            watched, df = _watched(fix_id, target, fix)
            watch.append(watched)
    return df


@dataclass(frozen=True)
class Watched:
    """The counts of one fix, known once the table behind it has been computed."""

    fix_id: str
    column: str | None
    columns_dropped: int
    before: Observation
    after: Observation | None = None

    def counts(self) -> dict[str, int]:
        """rows_before, rows_after and values_changed; waits for the first computation."""
        found = dict(self.before.get)
        return found if self.after is None else found | self.after.get


def _watched(fix_id: str, target: Target, fix: Fix) -> tuple[Watched, DataFrame]:
    """Apply a fix between counters. They stand in the plan itself, so nothing is read for
    them, and no column is needed that the fix does not need."""
    rows, none = F.count(F.lit(1)), F.count(F.lit(None))
    before = Observation()

    def counted(df: DataFrame, kept: Column, changed: Column) -> DataFrame:
        return df.observe(
            before, rows.alias("rows_before"), kept.alias("rows_after"), changed.alias("values_changed")
        )

    if isinstance(fix, TableFix):
        dropped = len(target.df.columns) - len(fix.result.columns)
        if fix_id not in SHUFFLES:  # all rows stay
            return Watched(fix_id, target.name, dropped, before), counted(fix.result, rows, none)
        after = Observation()
        fix = FIXES[fix_id](replace(target, df=counted(target.df, rows, none)))
        result = fix.result.observe(after, rows.alias("rows_after"))
        return Watched(fix_id, target.name, dropped, before, after), result
    if isinstance(fix, RowFix):
        df = counted(target.df, F.count(F.when(fix.keep, True)), none)
    else:
        df = counted(target.df, rows, _changed(target, fix))
    return Watched(fix_id, target.name, 0, before), _apply(replace(target, df=df), fix)


def _changed(target: Target, fix: ColumnFix) -> Column:
    """How many values a fix changes; across types, by their text."""
    after = fix.value
    if target.df.select(after).schema[0].dataType == target.data_type:
        same = F.expr(target.column).eqNullSafe(after)
    else:
        same = F.expr(target.as_text).eqNullSafe(after.cast("string"))
    return F.count(F.when(~same, True))


def audit(
    df: DataFrame,
    fix_id: str,
    params: Mapping[str, str] | None = None,
    *,
    as_of: str | date | datetime | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """One row telling what a fix would do: rows and columns dropped, values changed."""
    if fix_id not in FIXES:
        raise ValueError(f"unknown fix: {fix_id!r}")
    if fix_id != "drop_full_duplicate_columns":
        df = nan_to_null(df)
    target, fix = _prepare(df, fix_id, params, as_of, order_by)
    columns_after = len(df.columns)
    rows_after, changed, statistic = F.expr("count(1)"), F.expr("0L"), F.expr("NULL")
    if isinstance(fix, ColumnFix):
        changed = _changed(target, fix)
        if fix.statistic is not None:
            statistic = F.first(fix.statistic)
    elif isinstance(fix, RowFix):
        rows_after = F.count(F.when(fix.keep, True))
    else:
        columns_after = len(fix.result.columns)
        if fix_id in ("drop_full_duplicates", "drop_col_duplicates"):
            rows_after = F.first(fix.result.selectExpr("count(1) AS n").scalar())
    counts = target.df.agg(
        F.expr("count(1) AS rows_before"),
        rows_after.alias("rows_after"),
        changed.alias("values_changed"),
        statistic.cast("string").alias("statistic"),
    )
    name = "NULL" if target.name is None else text.literal(target.name)
    return counts.selectExpr(
        f"{text.literal(fix_id)} AS fix_id",
        f"CAST({name} AS STRING) AS `column`",
        "rows_before",
        "rows_after",
        "rows_before - rows_after AS rows_dropped",
        "values_changed",
        f"{len(df.columns) - columns_after} AS columns_dropped",
        "statistic",
    ).selectExpr(
        "*",
        "format_string('%s: %,d rows dropped, %,d values changed, %d columns dropped%s', fix_id, "
        "rows_dropped, values_changed, columns_dropped, coalesce(concat(', using ', statistic), "
        "'')) AS message",
    )

"""One scan of the table that measures every column at once.

All measures are partial aggregates with fixed-size buffers, so a task sends one
small row however much it reads, and nothing is shuffled by value. What needs
grouping by value lives in ``values``, ``quantiles``, ``duplicates`` and ``calendar``.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from gritsieve import roles
from gritsieve.functions import dates, numbers, text
from gritsieve.functions.text import count_where, ident

# Text columns with at most this many values may be categories by content.
FEW_VALUES = 50
FEW_VALUES_SHARE = 0.1

# Deviation from quantity x price x (1 - discount) that counts as a mismatch.
TOTAL_TOLERANCE = 0.05


@dataclass(frozen=True)
class Measure:
    """An aggregate (SQL over a column) and the columns it is taken of."""

    sql_type: str
    applies: Callable[[T.StructField], bool]
    aggregate: Callable[[str], str]


def _of(*kinds: str, words: Collection[str] = ()) -> Callable[[T.StructField], bool]:
    return lambda field: roles.kind(field.dataType) in kinds and (
        not words or roles.named(field.name, words)
    )


def _date_by_name(field: T.StructField) -> bool:
    return roles.named(field.name, roles.DATE_WORDS) and roles.kind(field.dataType) != "datetime"


def _number_by_name(field: T.StructField) -> bool:
    return (
        roles.kind(field.dataType) == "text"
        and roles.is_numeric_name(field.name)
        and not roles.named(field.name, roles.DATE_WORDS)
    )


def _maybe_category(field: T.StructField) -> bool:
    return roles.kind(field.dataType) == "text" and not roles.is_category_name(field.name)


def _distinct_floor(value: str) -> str:
    """A lower bound of the distinct count: bits set in a 64-bit map of hashes.

    Up to fifty distinct values set at most fifty bits, so a column showing more
    can be ruled out as a category without counting its values.
    """
    slot = f"CAST(pmod(xxhash64({value}), 64) AS INT)"
    bit = f"CASE WHEN {value} IS NOT NULL THEN shiftleft(1L, {slot}) END"
    return f"coalesce(bit_count(bit_or({bit})), 0)"


MEASURES: dict[str, Measure] = {
    "n_values": Measure("bigint", lambda field: True, lambda c: f"count({c})"),
    "n_pseudo": Measure("bigint", _of("text"), lambda c: count_where(text.is_placeholder(c))),
    "n_numeric": Measure(
        "bigint", _of("text"), lambda c: f"count({numbers.text_to_number(c)})"
    ),
    "n_clean": Measure(
        "bigint", _number_by_name, lambda c: f"count({numbers.clean_currency(c)})"
    ),
    "distinct_floor": Measure("bigint", _maybe_category, _distinct_floor),
    "min_value": Measure("double", _of("numeric"), lambda c: f"min({c})"),
    "max_value": Measure("double", _of("numeric"), lambda c: f"max({c})"),
    "mean": Measure("double", _of("numeric"), lambda c: f"avg({c})"),
    "n_negative": Measure(
        "bigint", _of("numeric", words=roles.NON_NEGATIVE_WORDS), lambda c: count_where(f"{c} < 0")
    ),
    "n_zero": Measure(
        "bigint", _of("numeric", words=roles.NON_ZERO_WORDS), lambda c: count_where(f"{c} = 0")
    ),
    "n_out_of_range": Measure(
        "bigint",
        _of("numeric", words=roles.PERCENT_WORDS),
        lambda c: count_where(f"{c} < 0 OR {c} > 100"),
    ),
    "date_hits": Measure(
        "array<bigint>", _date_by_name, lambda c: dates.format_hits(f"CAST({c} AS STRING)")
    ),
    "n_ambiguous": Measure(
        "bigint",
        _of("text", words=roles.DATE_WORDS),
        lambda c: count_where(f"{c} RLIKE {dates.AMBIGUOUS}"),
    ),
}


def _column_aggregates(df: DataFrame, measures: Iterable[str]) -> dict[str, str]:
    """The aggregates of every column, under the name ``position.measure``."""
    found = {}
    for position, field in enumerate(df.schema.fields):
        for name in measures:
            measure = MEASURES[name]
            if measure.applies(field):
                value = measure.aggregate(ident(field.name))
                found[f"{position}.{name}"] = f"CAST({value} AS {measure.sql_type})"
    return found


def _numbers_of(df: DataFrame, names: Iterable[str]) -> list[str]:
    types_by_name = {field.name: field.dataType for field in df.schema.fields}
    return [numbers.to_number(ident(name), types_by_name[name]) for name in names]


def _complete(names: Iterable[str]) -> str:
    return " AND ".join(f"{ident(name)} IS NOT NULL" for name in names)


def total_rule(df: DataFrame) -> dict[str, str] | None:
    """Columns of the amount rule, or None where it cannot be told apart."""
    picks = roles.amount_columns(df.columns)
    found = {role: name for role, name in picks.items() if name is not None}
    required = {"quantity", "price", "total"} <= found.keys()
    return found if required and len(set(found.values())) == len(found) else None


def _total_measures(df: DataFrame) -> dict[str, str]:
    """Both readings of the discount in one pass: as a fraction and as a percent."""
    rule = total_rule(df)
    if rule is None:
        return {}
    complete = _complete(rule.values())
    quantity, price, total = _numbers_of(df, (rule["quantity"], rule["price"], rule["total"]))

    def mismatches(factor: str) -> str:
        expected = f"CAST({quantity} AS DOUBLE) * CAST({price} AS DOUBLE) * {factor}"
        deviation = f"abs(CAST({total} AS DOUBLE) - {expected}) / (abs({expected}) + 1e-9D)"
        return count_where(
            f"{complete} AND {deviation} > {TOTAL_TOLERANCE}D AND NOT isnan({deviation})"
        )

    if "discount" not in rule:
        return {"n_mismatch": mismatches("1D")}
    discount = f"CAST({_numbers_of(df, (rule['discount'],))[0]} AS DOUBLE)"
    in_percent = f"max(CASE WHEN {complete} THEN {discount} END) > 1"
    return {
        "n_mismatch": f"CASE WHEN {in_percent} THEN {mismatches(f'(1 - {discount} / 100)')} "
        f"ELSE {mismatches(f'(1 - {discount})')} END"
    }


def discount_rule(df: DataFrame) -> tuple[str, str, str] | None:
    """Discount, total and price column, or None where two of them coincide."""
    picks = roles.amount_columns(df.columns)
    names = (picks["discount"], picks["total"], picks["price"])
    return names if None not in names and len(set(names)) == 3 else None


def _discount_measures(df: DataFrame) -> dict[str, str]:
    rule = discount_rule(df)
    if rule is None:
        return {}
    discount, total, price = _numbers_of(df, rule)
    ignored = f"{_complete(rule)} AND {discount} > 0 AND {total} > {price}"
    return {"n_discount_ignored": count_where(ignored)}


def _mostly_empty(df: DataFrame) -> dict[str, str]:
    if not df.columns:
        return {"n_mostly_empty": "0"}
    empty = " + ".join(f"CAST({ident(name)} IS NULL AS INT)" for name in df.columns)
    return {"n_mostly_empty": count_where(f"({empty}) * 2 > {len(df.columns)}")}


TABLE_MEASURES: dict[str, Callable[[DataFrame], dict[str, str]]] = {
    "n_mostly_empty": _mostly_empty,
    "n_mismatch": _total_measures,
    "n_discount_ignored": _discount_measures,
}


def _table_aggregates(df: DataFrame, measures: Iterable[str]) -> dict[str, str]:
    found = {}
    for name in measures:
        found.update(TABLE_MEASURES[name](df))
    return found


def _aggregate(df: DataFrame, found: dict[str, str]) -> DataFrame:
    return df.agg(
        F.expr("count(1) AS n_rows"),
        *(F.expr(f"{aggregate} AS {ident(name)}") for name, aggregate in found.items()),
    )


def scan(df: DataFrame) -> tuple[list[dict], dict]:
    """All measures from one scan: a record per column, and one for the table.

    The result is a single row whose width depends on the schema alone.
    """
    row = _aggregate(
        df, _column_aggregates(df, MEASURES) | _table_aggregates(df, TABLE_MEASURES)
    ).first()
    return _records(df, row.asDict())


def _records(
    df: DataFrame, found: dict, without: Collection[str] = ()
) -> tuple[list[dict], dict]:
    columns = [
        _identity(position, field)
        | {"n_rows": found["n_rows"]}
        | {name: found.get(f"{position}.{name}") for name in MEASURES}
        for position, field in enumerate(df.schema.fields)
        if field.name not in without
    ]
    table = {"n_rows": found["n_rows"], "n_columns": len(df.columns)}
    return columns, table | {name: found.get(name) for name in TABLE_MEASURES}


def isolated_scan(df: DataFrame) -> tuple[list[dict], dict, dict[str, Exception]]:
    """What ``scan`` gives, but without the columns that cannot be read, and what failed there.

    If the one scan fails, its aggregates are halved until each failing column, or measure of
    the table, is alone: f failures among n columns take about 2 f log n scans of ever fewer
    columns. Measures of the table are taken over the columns that can be read. If not even
    the rows can be counted, or no part fails by itself, the failure is raised.
    """
    try:
        return *scan(df), {}
    except Exception as error:
        whole = error
    try:
        found = _aggregate(df, {}).first().asDict()
    except Exception:
        raise whole from None
    units: dict[str, dict[str, str]] = {}
    for position, field in enumerate(df.schema.fields):
        prefix = f"{position}."
        units[field.name] = {
            name: aggregate for name, aggregate in _column_aggregates(df, MEASURES).items() if name.startswith(prefix)
        }
    failures = _halved(df, units, found)
    readable = df.select(*(ident(name) for name in df.columns if name not in failures))
    table_units = {name: TABLE_MEASURES[name](readable) for name in TABLE_MEASURES}
    failures |= _halved(readable, {name: unit for name, unit in table_units.items() if unit}, found)
    if not failures:
        raise whole
    return *_records(df, found, failures), failures


def measured(
    df: DataFrame, names: Collection[str], table_measures: Iterable[str]
) -> tuple[dict[str, dict], dict]:
    """The measures of some columns, and some of the table, from one scan of what they need."""
    own = df.select(*(ident(name) for name in names))
    aggregates = _column_aggregates(own, MEASURES)
    rules = _table_aggregates(df, table_measures)
    found = dict.fromkeys(table_measures)
    if not aggregates and not rules:
        return {}, found
    row = _aggregate(df, aggregates | rules).first().asDict()
    columns, _ = _records(own, row)
    return {record["column"]: record for record in columns}, found | {name: row[name] for name in rules}


def _halved(df: DataFrame, units: dict[str, dict[str, str]], found: dict) -> dict[str, Exception]:
    """Take the aggregates of all units into ``found``; the units that fail, with why."""
    if not units:
        return {}
    try:
        merged = {name: aggregate for unit in units.values() for name, aggregate in unit.items()}
        found.update(_aggregate(df, merged).first().asDict())
        return {}
    except Exception as error:
        names = list(units)
        if len(names) == 1:
            return {names[0]: error}
    middle = len(names) // 2
    failures = {}
    for half in (names[:middle], names[middle:]):
        failures |= _halved(df, {name: units[name] for name in half}, found)
    return failures


def _identity(position: int, field: T.StructField) -> dict:
    return {
        "position": position,
        "column": field.name,
        "kind": roles.kind(field.dataType),
        "type": field.dataType.simpleString(),
    }


def column_profile(df: DataFrame, *measures: str) -> DataFrame:
    """One row per column with the measures asked for, from one scan."""
    found = _column_aggregates(df, measures)
    entries = []
    for position, field in enumerate(df.schema.fields):
        parts = [f"{position} AS position"]
        for key in ("column", "kind", "type"):
            parts.append(f"{text.literal(_identity(position, field)[key])} AS `{key}`")
        parts.append("n_rows")
        for name in measures:
            key = f"{position}.{name}"
            value = ident(key) if key in found else f"CAST(NULL AS {MEASURES[name].sql_type})"
            parts.append(f"{value} AS {name}")
        entries.append(f"struct({', '.join(parts)})")
    return _aggregate(df, found).selectExpr(f"inline(array({', '.join(entries)}))")


def table_profile(df: DataFrame, *measures: str) -> DataFrame:
    """One row with the table measures asked for, from one scan."""
    found = _table_aggregates(df, measures)
    return _aggregate(df, found).selectExpr(
        "n_rows",
        f"CAST({len(df.columns)} AS BIGINT) AS n_columns",
        *(
            f"CAST({name if name in found else 'NULL'} AS BIGINT) AS {name}"
            for name in measures
        ),
    )

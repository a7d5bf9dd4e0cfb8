"""SQL for numbers: lenient parsing, currency text, clipping, NaN."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

from gritsieve.functions.text import ident, strip
from gritsieve.roles import kind

# What counts as number text; a bare cast would also take "1d", "nan" and the like.
FINITE_TEXT = r"r'(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\z'"
INFINITE_TEXT = r"r'(?i)^[+-]?inf(inity)?\z'"


def text_to_number(value: str, stripped: bool = False) -> str:
    """Double, or null where the text is no number or overflows.

    A digit, sign or point (for infinity a sign or "i") must come first, and most
    text is ruled out by that alone.
    """
    text = value if stripped else strip(value)
    number = f"try_cast({text} AS DOUBLE)"
    return (
        f"CASE WHEN ascii({text}) BETWEEN 43 AND 57 AND {text} RLIKE {FINITE_TEXT} "
        f"THEN CASE WHEN abs({number}) < CAST('Infinity' AS DOUBLE) THEN {number} END "
        f"WHEN ascii({text}) IN (43, 45, 73, 105) AND {text} RLIKE {INFINITE_TEXT} "
        f"THEN {number} END"
    )


def to_number(value: str, data_type: T.DataType) -> str:
    """Numbers stay as they are, text is parsed, anything unparseable is null."""
    of = kind(data_type)
    if of == "numeric":
        return value
    if of == "text":
        return text_to_number(value)
    if of == "boolean":
        return f"CAST({value} AS DOUBLE)"
    return "CAST(NULL AS DOUBLE)"


def strip_currency(value: str) -> str:
    """Drop %, currency signs, commas and whitespace, so "10,5" reads as 105."""
    return rf"regexp_replace({value}, r'(?U)[%,$€£\s]', '')"


def clean_currency(value: str) -> str:
    return text_to_number(strip_currency(value), stripped=True)


def clip(value: str, low: str, high: str) -> str:
    """Null stays null: greatest and least alone would skip it."""
    return f"CASE WHEN {value} IS NOT NULL THEN least(greatest({value}, {low}), {high}) END"


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: float NaN becomes null, and the rest is untouched."""
    floats = (T.FloatType, T.DoubleType)
    if not any(isinstance(field.dataType, floats) for field in df.schema.fields):
        return df
    cells = []
    for field in df.schema.fields:
        name = ident(field.name)
        if isinstance(field.dataType, floats):
            of = field.dataType.simpleString()
            cells.append(f"nanvl({name}, CAST(NULL AS {of})) AS {name}")
        else:
            cells.append(name)
    return df.selectExpr(*cells)

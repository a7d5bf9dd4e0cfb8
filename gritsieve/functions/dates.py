"""SQL for dates held as text.

A format is tried by matching its shape with a regular expression and rearranging
the parts into ISO order for a cast. That never throws on bad text, accepts
one-digit days and months, and does not depend on the session time zone.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import types as T

from gritsieve.functions import date_grammar
from gritsieve.functions.text import literal
from gritsieve.roles import kind

# Formats in order of preference (an earlier one wins a tie).
DATE_FORMATS = (
    "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y", "%Y/%m/%d", "%d-%m-%Y",
    "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%Y-%m-%dT%H:%M:%S",
)
AUTO = "auto-inferred"
CANDIDATES = (*DATE_FORMATS, AUTO)

AMBIGUOUS = r"r'^\d{2}/\d{2}/\d{4}\z'"
OLDEST_PLAUSIBLE = "CAST('1990-01-01' AS TIMESTAMP_NTZ)"

_ISO_LIKE = r"r'^\d{4}(-\d{1,2}(-\d{1,2}([ T].*)?)?)?\z'"


def _shape(date_format: str) -> tuple[str, str]:
    """A strptime format as (matching pattern, replacement giving ISO order)."""
    order: list[str] = []

    def group(directive: str) -> str:
        if directive not in "YmdHMS" or directive in order:
            raise ValueError(f"date format not supported: {date_format!r}")
        order.append(directive)
        return r"(\d{4})" if directive == "Y" else r"(\d{1,2})"

    pattern = "".join(
        group(piece[1]) if piece.startswith("%") else re.escape(piece)
        for piece in re.split(r"(%.)", date_format)
    )
    place = {directive: f"${index}" for index, directive in enumerate(order, start=1)}
    day = "-".join((place.get("Y", "1900"), place.get("m", "1"), place.get("d", "1")))
    clock = ":".join(place.get(directive, "0") for directive in "HMS")
    has_clock = any(directive in place for directive in "HMS")
    return literal(f"^{pattern}\\z"), literal(f"{day} {clock}" if has_clock else day)


def parse_format(text: str, date_format: str) -> str:
    """Timestamp by one strptime format, null where the text does not fit it."""
    if "%%" in date_format or set(date_grammar.directives(date_format)) - set(date_grammar.BASIC):
        return date_grammar.parse(text, date_format)
    pattern, iso_order = _shape(date_format)
    return (
        f"CASE WHEN {text} RLIKE {pattern} THEN "
        f"try_cast(regexp_replace({text}, {pattern}, {iso_order}) AS TIMESTAMP_NTZ) END"
    )


def parse_iso(text: str) -> str:
    return f"CASE WHEN {text} RLIKE {_ISO_LIKE} THEN try_cast({text} AS TIMESTAMP_NTZ) END"


def parse_any(text: str) -> str:
    """Timestamp by ISO spelling, else by the first known format that fits."""
    known = (parse_format(text, fmt) for fmt in DATE_FORMATS)
    return f"coalesce({', '.join([parse_iso(text), *known])})"


def parse_first(text: str, formats: Sequence[str]) -> str:
    """Timestamp by the first of the formats of a column that fits, else by ISO spelling."""
    return f"coalesce({', '.join([*(parse_format(text, fmt) for fmt in formats), parse_iso(text)])})"


def to_timestamp(
    value: str, data_type: T.DataType, date_format: str | Sequence[str] | None
) -> str:
    """Timestamp from a column of any type; a datetime column is left alone.

    Without a format ISO spelling and the known ones are tried; a list of formats, as the
    spellings of a column show them, takes their place.
    """
    if kind(data_type) == "datetime":
        return f"CAST({value} AS TIMESTAMP_NTZ)"
    text = value if kind(data_type) == "text" else f"CAST({value} AS STRING)"
    if date_format is None or date_format == AUTO:
        return parse_any(text)
    if not isinstance(date_format, str):
        return parse_first(text, date_format)
    return parse_format(text, date_format)


def format_hits(text: str) -> str:
    """Aggregate: how many values each candidate parses, in order of preference."""
    parsed = [parse_format(text, fmt) for fmt in DATE_FORMATS] + [parse_any(text)]
    return f"array({', '.join(f'count({value})' for value in parsed)})"


def best_format(hits: str) -> str:
    """The first candidate with the most hits, null when nothing parses."""
    most = f"array_max({hits})"
    names = f"array({', '.join(map(literal, CANDIDATES))})"
    place = f"CAST(array_position({hits}, {most}) AS INT)"
    return f"CASE WHEN {most} > 0 THEN get({names}, {place} - 1) END"


def moment(as_of: str | date | datetime | None) -> str:
    """The time that dates are "in the future" of."""
    value = "current_timestamp()" if as_of is None else literal(str(as_of))
    return f"CAST({value} AS TIMESTAMP_NTZ)"


def days_between(first: str, last: str) -> str:
    """Whole 24-hour days, not midnights crossed."""
    return f"timestampdiff(DAY, {first}, {last})"

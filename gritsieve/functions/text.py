"""SQL for text: stripping, case, placeholder values, percent text.

These builders take and return SQL expression text. A wide scan holds thousands of
expression nodes, and one parsed string per aggregate is built far faster than the
same tree node by node.
"""

from __future__ import annotations

# Every character Unicode counts as whitespace, plus the ASCII separators.
WHITESPACE = "".join(chr(code) for code in range(0x10000) if chr(code).isspace())

# Text that stands for a missing value, compared after strip and lower.
PLACEHOLDERS = (
    "n/a", "na", "nan", "null", "none", "nil", "-", "--", "---", "unknown", "missing", "empty",
    "", " ", "not available", "undefined",
)

# The exact tokens a CSV reader takes for a missing value (case matters).
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def ident(name: str) -> str:
    """The column of exactly this name, dots and spaces included."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(words: tuple[str, ...]) -> str:
    return f"({', '.join(map(literal, words))})"


def count_where(condition: str) -> str:
    """``count_if`` without the extra projection the optimiser puts below it."""
    return f"count(CASE WHEN {condition} THEN 1 END)"


_WHITESPACE_SQL = "'" + "".join(f"\\u{ord(char):04x}" for char in WHITESPACE) + "'"


def strip(value: str) -> str:
    """Without leading and trailing Unicode whitespace."""
    return f"trim(BOTH {_WHITESPACE_SQL} FROM {value})"


def strip_lower(value: str) -> str:
    return f"lower({strip(value)})"


def title_case(value: str) -> str:
    """Capitalise every run of letters: "it's foo-bar" becomes "It'S Foo-Bar"."""
    runs = rf"regexp_extract_all(lower({value}), r'(\p{{L}}+|\P{{L}}+)', 1)"
    return f"array_join(transform({runs}, run -> initcap(run)), '')"


def is_placeholder(value: str) -> str:
    return f"{strip_lower(value)} IN {one_of(PLACEHOLDERS)}"


def csv_null_tokens_to_null(value: str) -> str:
    return f"CASE WHEN {value} NOT IN {one_of(CSV_NULL_TOKENS)} THEN {value} END"


def percent_text(part: str, whole: str) -> str:
    """One decimal, and 0.0% of nothing."""
    return f"format_string('%.1f%%', coalesce(try_divide(100D * {part}, {whole}), 0D))"

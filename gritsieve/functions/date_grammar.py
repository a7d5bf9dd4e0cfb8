"""SQL for dates spelled in any of the usual ways: month names, short years, clocks, zones.

A value's *shape* is the value with each token replaced by its directive: "5 Jan 2020" has the
shape "%2 %b %Y", where %2 is a number of one or two digits whose part is not yet known. A
column has few shapes, so they can be counted; what the numbers mean is then settled once for
each shape, and the formats that result are compiled to SQL.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from gritsieve.functions.text import literal

# Names and their abbreviations, in order.
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
)
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
# Fixed value: two-digit years below this lie in the 2000s.
CENTURY_TURN = 69

BASIC = "YmdHMS"


def _any(names: Iterable[str]) -> str:
    return "|".join(names)


def _short(names: Iterable[str]) -> list[str]:
    return [name[:3] for name in names]


_PATTERNS = {
    "Y": r"\d{4}", "y": r"\d{2}", "m": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}",
    "I": r"0?[1-9]|1[0-2]", "M": r"\d{1,2}", "S": r"\d{1,2}", "f": r"\d{1,9}", "j": r"\d{1,3}",
    "p": "am|pm", "b": _any(_short(MONTHS)), "B": _any(MONTHS), "a": _any(_short(WEEKDAYS)),
    "A": _any(WEEKDAYS), "z": r"z|utc|gmt|[+-]\d{2}:?\d{2}",
}


def directives(date_format: str) -> list[str]:
    """The directives of a strptime format; one that cannot be read raises ValueError."""
    found = [x[1] for x in re.findall(r"%.?", date_format) if x != "%%" and len(x) > 1]
    parts = set(found)
    clash = any(len(parts & set(group)) > 1 for group in ("Yy", "mbB", "HI", "aA"))
    undated = parts & set("aA") and not parts & set("mbBj")
    lone_clock = ("p" in parts) != ("I" in parts) and "H" not in parts
    if parts - _PATTERNS.keys() or len(parts) < len(found) or clash or undated or lone_clock or not parts:
        raise ValueError(f"date format not supported: {date_format!r}")
    if "j" in parts and (parts & set("mbBd") or not parts & set("Yy")):
        raise ValueError(f"a day of the year needs the year alone: {date_format!r}")
    return found


def _pattern(date_format: str) -> str:
    parts = []
    for piece in re.split(r"(%.|\s+)", date_format):
        if piece == "%%":
            parts.append("%")
        elif piece.startswith("%"):
            parts.append(f"({_PATTERNS[piece[1]]})")
        else:
            parts.append(r"\s+" if piece.isspace() else re.escape(piece))
    return literal(f"(?i)^{''.join(parts)}\\z")


def parse(text: str, date_format: str) -> str:
    """Timestamp by one strptime format, null where the text does not fit it.

    Names are English, in any case. A time with a zone is moved to UTC. What a format
    lacks is that of 1900-01-01 00:00:00.
    """
    order = directives(date_format)
    pattern = _pattern(date_format)
    groups = {x: f"regexp_extract({text}, {pattern}, {i})" for i, x in enumerate(order, start=1)}

    def number(directive: str) -> str:
        return f"CAST({groups[directive]} AS INT)"

    year = "1900"
    if "Y" in groups:
        year = groups["Y"]
    elif "y" in groups:
        year = f"({number('y')} + IF({number('y')} < {CENTURY_TURN}, 2000, 1900))"
    month = groups.get("m", "1")
    for name in ("b", "B"):
        if name in groups:
            starts = literal("".join(_short(MONTHS)).lower())
            month = f"((instr({starts}, lower(left({groups[name]}, 3))) + 2) div 3)"
    hour = groups.get("H", "0")
    if "I" in groups:
        hour = f"({number('I')} % 12 + IF(lower({groups['p']}) = 'pm', 12, 0))"
    fraction = f"rpad(left({groups['f']}, 6), 6, '0')" if "f" in groups else "'0'"
    clock = f"' ', {hour}, ':', {groups.get('M', '0')}, ':', {groups.get('S', '0')}, '.', {fraction}"
    moment = f"try_cast(concat({year}, '-', {month}, '-', {groups.get('d', '1')}, {clock}) AS TIMESTAMP_NTZ)"
    if "j" in groups:
        moved = f"timestampadd(DAY, {number('j')} - 1, {moment})"
        moment = f"CASE WHEN {number('j')} > 0 AND year({moved}) = CAST({year} AS INT) THEN {moved} END"
    if "z" in groups:
        digits = f"replace({groups['z']}, ':', '')"
        minutes = (
            f"CASE WHEN {groups['z']} RLIKE r'\\d' THEN (CAST(substring({digits}, 2, 2) AS INT) * 60 + "
            f"CAST(substring({digits}, 4, 2) AS INT)) * IF(left({digits}, 1) = '-', 1, -1) ELSE 0 END"
        )
        moment = f"timestampadd(MINUTE, {minutes}, {moment})"
    return f"CASE WHEN {text} RLIKE {pattern} THEN {moment} END"


def _alone(names: Iterable[str]) -> str:
    return rf"(?i)(?<![a-z])(?:{_any(names)})(?![a-z])"


# What is replaced by which directive, one after the other; names only where there are three
# letters in a row.
_NAMES = (
    (_alone(name for name in MONTHS if len(name) > 3), "%B"),
    (_alone(_short(MONTHS)), "%b"),
    (_alone(WEEKDAYS), "%A"),
    (_alone(_short(WEEKDAYS)), "%a"),
)
_NUMBERS = (
    (r"(?i)(?<=[\d ])[ap]m(?![a-z])", "%p"),
    (r"(?i)(:\d\d(?:\.\d{1,9})? ?|%p ?)(?:z|utc|gmt|[+-]\d\d:?\d\d)$", "$1%z"),
    (r"(:\d\d)\.\d{1,9}(?!\d)", "$1.%f"),
    (r"(?<![\d%])\d{1,2}(?!\d)", "%2"),
    (r"(?<!\d)\d{3}(?!\d)", "%j"),
    (r"(?<!\d)\d{4}(?!\d)", "%Y"),
    (r"(?<!\d)\d{8}(?!\d)", "%8"),
)
_SHAPE = r"^(?:%[AaBbYjpzf28][-/., :T]*)+\z"


def _replaced(text: str, tokens: Iterable[tuple[str, str]]) -> str:
    for pattern, directive in tokens:
        text = f"regexp_replace({text}, {literal(pattern)}, {literal(directive)})"
    return text


def spelling(text: str) -> str:
    """The value with a nought for each digit; its shape is that of the value."""
    return f"translate({text}, '123456789', '000000000')"


def shape(text: str) -> str:
    """The shape of a value, null where something is no part of a date."""
    found = f"CASE WHEN {text} RLIKE '[a-zA-Z]{{3}}' THEN {_replaced(text, _NAMES)} ELSE {text} END"
    found = _replaced(found, _NUMBERS)
    return f"CASE WHEN NOT contains({text}, '%') THEN regexp_extract({found}, {literal(_SHAPE)}, 0) END"


_CLOCK = re.compile(r"%2:%2(?::%2(?:\.%f)?)?( ?%p)?(?: ?%z)?$")
# What numbers and names mean, by their order; where day and month change places, both ways.
_DATES = {
    "Y22": ("Ymd",), "22Y": ("dmY", "mdY"), "222": ("dmy", "mdy"), "2bY": ("dbY",), "b2Y": ("bdY",),
    "Yb2": ("Ybd",), "2b2": ("dby",), "b22": ("bdy",), "bY": ("bY",), "Yb": ("Yb",), "Y2": ("Ym",),
    "2Y": ("mY",), "Yj": ("Yj",), "8": ("8",), "Y": ("Y",),
}


def formats_of(found: str) -> tuple[str, ...]:
    """The formats a shape can have: none, one, or day first and month first."""
    clock = _CLOCK.search(found)
    date = found[: clock.start()] if clock else found
    tokens = re.findall(r"%([bBYj28])", date)
    if len(tokens) + len(re.match(r"(%[Aa])?", date)[1] or "") // 2 != date.count("%"):
        return ()
    meant = _DATES.get("".join(tokens).replace("B", "b"), ())
    time = ""
    if clock:
        hour = "%I" if clock[1] else "%H"
        time = clock[0].replace("%2", hour, 1).replace("%2", "%M", 1).replace("%2", "%S", 1)
    return tuple(_filled(date, tokens, parts) + time for parts in meant)


def _filled(date: str, tokens: list[str], parts: str) -> str:
    meant = iter("%Y%m%d" if part == "8" else f"%{token if part == 'b' else part}" for token, part in zip(tokens, parts))
    return re.sub(r"%[bBYj28]", lambda _: next(meant), date)


def day_or_month(found: str) -> bool:
    """Whether the first two numbers of the shape can be day and month in either order."""
    return len(formats_of(found)) == 2


def month_first_on_tie(found: str) -> bool:
    """Which order holds where no value tells: as the known formats have it for full years,
    and as readers infer it for short years and twelve-hour clocks."""
    return "%Y" not in found or "%p" in found

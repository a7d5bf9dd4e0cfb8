"""Exact linear-interpolated quantiles of many columns, and outlier counts.

Spark's ``percentile`` is exact but keeps every distinct value of a column in the
buffer of its last task. It is used only where the number of values is known to be
small. Beyond that, each wanted rank is narrowed down by counting: a pass groups
the values of the current bracket into at most about a thousand bins per rank
(partial aggregates, a few kilobytes per task), and the bin holding the rank is the
next bracket. Each pass divides the bracket by about a thousand, so billions of
values take three or four scans of the numeric columns, and the answer is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Row, functions as F

from gritsieve.functions.text import count_where, ident, literal

QUARTILES = (0.25, 0.5, 0.75)
OUTLIER_SPREADS = 3

# Non-null values of one column that a single task may hold.
IN_MEMORY_VALUES = 100_000
# Values left in all brackets together that may be grouped by value.
FINISH_VALUES = 1_000_000
BINS = 1024
# Bins per doubling of the magnitude in the first pass.
FIRST_PASS_BINS = 64

_TARGETS = "bracket int, column string, rank bigint, below bigint"


def exact_quantiles(
    df: DataFrame,
    counts: Mapping[str, int],
    probabilities: Sequence[float] = QUARTILES,
    in_memory: int = IN_MEMORY_VALUES,
    finish: int = FINISH_VALUES,
) -> dict[str, list[float]]:
    """Quantiles per numeric column; ``counts`` holds its number of non-null values.

    The result has a fixed number of values per column, whatever the table size.
    """
    small = [name for name, n in counts.items() if 0 < n <= in_memory]
    large = {name: n for name, n in counts.items() if n > in_memory}
    result: dict[str, list[float]] = {}
    if small:
        wanted = ", ".join(f"{probability}D" for probability in probabilities)
        row = df.agg(
            *(
                F.expr(f"percentile(CAST({ident(name)} AS DOUBLE), array({wanted}))")
                for name in small
            )
        ).first()
        result.update({name: list(row[i]) for i, name in enumerate(small)})
    if large:
        result.update(_by_narrowing(df, large, probabilities, finish))
    return result


def _by_narrowing(
    df: DataFrame, counts: Mapping[str, int], probabilities: Sequence[float], finish: int
) -> dict[str, list[float]]:
    wanted = {
        (name, probability): _ranks(n, probability)
        for name, n in counts.items()
        for probability in probabilities
    }
    ranks = {(name, rank) for (name, _), pair in wanted.items() for rank in pair[:2]}
    values = _values_at(df, ranks, finish)
    result: dict[str, list[float]] = {name: [] for name in counts}
    for (name, _), (lower, upper, share) in wanted.items():
        a, b = values[name, lower], values[name, upper]
        result[name].append(a if a == b else (1 - share) * a + share * b)
    return result


def _ranks(n: int, probability: float) -> tuple[int, int, float]:
    position = (n - 1) * probability
    lower = math.floor(position)
    return lower, min(lower + 1, n - 1), position - lower


def _values_at(
    df: DataFrame, ranks: Iterable[tuple[str, int]], finish: int
) -> dict[tuple[str, int], float]:
    """The value at each (column, zero-based rank) of the sorted non-null values."""
    ranks = sorted(ranks)
    names = sorted({name for name, _ in ranks})

    # First pass: bins of equal ratio, so far-off outliers do not swallow the rest.
    cells = ", ".join(
        f"struct({i} AS bracket, CAST({ident(name)} AS DOUBLE) AS value)"
        for i, name in enumerate(names)
    )
    first_bin = (
        "CASE WHEN abs(value) = CAST('Infinity' AS DOUBLE) THEN value "
        f"ELSE signum(value) * floor(log2(abs(value) + 1) * {FIRST_PASS_BINS}) END AS bin"
    )
    values = df.selectExpr(f"inline(array({cells}))").where("value IS NOT NULL")
    targets = [(names.index(name), name, rank, 0) for name, rank in ranks]
    rows = _holding(values.selectExpr("*", first_bin), targets)

    found: dict[tuple[str, int], float] = {}
    while True:
        # One row per (column, rank): bounded by the columns asked for.
        found.update({(r["column"], r["rank"]): r["low"] for r in rows if r["low"] == r["high"]})
        rows = [r for r in rows if r["low"] != r["high"]]
        if not rows:
            return found
        brackets = sorted({(r["column"], r["low"], r["high"], r["n"]) for r in rows})
        last_pass = sum(bracket[-1] for bracket in brackets) <= finish
        scaled = f"CAST(floor((value - low) / (high - low) * {BINS}) AS DOUBLE) AS bin"
        values = _inside(df, brackets).selectExpr("*", "value AS bin" if last_pass else scaled)
        place = {bracket[:3]: i for i, bracket in enumerate(brackets)}
        targets = [
            (place[r["column"], r["low"], r["high"]], r["column"], r["rank"], r["below"])
            for r in rows
        ]
        rows = _holding(values, targets)


def _inside(df: DataFrame, brackets: Sequence[tuple[str, float, float, int]]) -> DataFrame:
    """(bracket, value, low, high) of the cells inside a bracket; the few brackets are literals."""
    tests, cells = [], []
    for i, (name, low, high, _) in enumerate(brackets):
        value = f"CAST({ident(name)} AS DOUBLE)"
        test = f"{value} BETWEEN {double(low)} AND {double(high)}"
        tests.append(test)
        cells.append(
            f"CASE WHEN {test} THEN struct({i} AS bracket, {value} AS value, "
            f"{double(low)} AS low, {double(high)} AS high) END"
        )
    return df.where(" OR ".join(tests)).selectExpr(
        f"inline(array_compact(array({', '.join(cells)})))"
    )


def _holding(values: DataFrame, targets: Sequence[tuple[int, str, int, int]]) -> list[Row]:
    """For each target rank, the bin that holds it, as the next bracket."""
    wanted = values.sparkSession.createDataFrame(list(targets), _TARGETS)
    placed = (
        values.groupBy("bracket", "bin")
        .agg(F.expr("count(1) AS n"), F.expr("min(value) AS low"), F.expr("max(value) AS high"))
        .selectExpr(
            "bracket", "low", "high", "n",
            "sum(n) OVER (PARTITION BY bracket ORDER BY bin) - n AS before",
        )
    )
    return (
        placed.join(F.broadcast(wanted), "bracket")
        .where("rank >= below + before AND rank < below + before + n")
        .selectExpr("`column`", "rank", "low", "high", "below + before AS below", "n")
        .collect()
    )


def fences(quartiles: Sequence[float]) -> tuple[float, float]:
    """Three interquartile ranges below the first and above the third quartile."""
    first, _, third = quartiles
    spread = third - first
    return first - OUTLIER_SPREADS * spread, third + OUTLIER_SPREADS * spread


def outlier_counts(df: DataFrame, quartiles: Mapping[str, Sequence[float]]) -> DataFrame:
    """Per column: values outside the fences, from one scan of these columns.

    A spread of zero gives no fences, hence a null count.
    """
    entries = []
    for name, (first, median, third) in quartiles.items():
        low, high = fences((first, median, third))
        value = f"CAST({ident(name)} AS DOUBLE)"
        outside = count_where(f"{value} < {double(low)} OR {value} > {double(high)}")
        entries.append(
            f"struct({literal(name)} AS `column`, count({value}) AS n_values, "
            f"min({value}) AS min_value, max({value}) AS max_value, {double(first)} AS q1, "
            f"{double(median)} AS median, {double(third)} AS q3, "
            f"{outside if third > first else 'CAST(NULL AS BIGINT)'} AS n_outliers)"
        )
    return df.selectExpr(f"inline(array({', '.join(entries)}))")


def double(value: float) -> str:
    """A double as SQL, to the last bit."""
    return f"CAST('{value!r}' AS DOUBLE)"

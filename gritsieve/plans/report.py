"""Views of an issues frame: counts, order, status and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gritsieve.functions.text import count_where, literal, one_of
from gritsieve.operators.checks import SEVERITIES

_NAMES = f"array{one_of(SEVERITIES)}"

# 0 for CRITICAL up to 3 for OK.
SEVERITY_RANK = f"array_position({_NAMES}, severity) - 1"


def severity_summary(issues: DataFrame) -> DataFrame:
    """Issues per severity, zeros included."""
    counts = (
        f"struct({literal(name)} AS severity, "
        f"{count_where(f'severity = {literal(name)}')} AS n_issues)"
        for name in SEVERITIES
    )
    return issues.selectExpr(f"inline(array({', '.join(counts)}))")


def ordered(issues: DataFrame) -> DataFrame:
    """By section, the worst first, then in the order of the checks."""
    return issues.orderBy("section_no", F.expr(SEVERITY_RANK), "seq", "message")


def section_status(issues: DataFrame) -> DataFrame:
    """The worst severity of every section."""
    worst = f"CAST(min({SEVERITY_RANK}) AS INT)"
    return issues.groupBy("section").agg(F.expr(f"get({_NAMES}, {worst}) AS status"))


def with_severity(issues: DataFrame, *severities: str) -> DataFrame:
    return issues.where(f"severity IN {one_of(severities)}")


def overall_status(issues: DataFrame) -> DataFrame:
    """One row: critical, warning or ok."""
    n_critical, n_warning = (
        count_where(f"severity = {literal(name)}") for name in ("CRITICAL", "WARNING")
    )
    return issues.selectExpr(
        f"CASE WHEN {n_critical} > 0 THEN 'critical' WHEN {n_warning} > 0 THEN 'warning' "
        "ELSE 'ok' END AS status",
        f"{n_critical} AS n_critical",
        f"{n_warning} AS n_warning",
    )

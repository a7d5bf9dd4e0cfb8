"""Clean a table by a list of fixes, tell what each one did, and validate the result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, functions as F

from gritsieve.operators.fixes import Watched, apply_plan, audit
from gritsieve.plans.validate import validate
from gritsieve.sources.staging import stage

OUTCOMES = (
    "position int, fix_id string, `column` string, rows_before bigint, rows_after bigint, "
    "rows_dropped bigint, values_changed bigint, columns_dropped bigint"
)


def clean_then_validate(
    df: DataFrame,
    plan: Sequence[tuple[str, Mapping[str, str]]],
    *,
    as_of: str | date | datetime | None = None,
    order_by: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """The cleaned table and its issues.

    The cleaned table is written once, so that the passes of the validation read
    columns of a file instead of repeating the fixes.
    """
    cleaned = stage(apply_plan(df, plan, as_of=as_of, order_by=order_by, stage=stage))
    return cleaned, validate(cleaned, as_of=as_of, order_by=order_by)


def clean(
    df: DataFrame,
    plan: Sequence[tuple[str, Mapping[str, str]]],
    *,
    as_of: str | date | datetime | None = None,
    order_by: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """The cleaned table and the outcome of each fix of the plan, in one go.

    Rows and changed values are counted by the job that writes the cleaned table, so the
    outcomes cost no scan. Where an executor was lost, tasks that ran twice may have counted
    twice; then the counts do not fit the written rows, and each fix is counted by itself.
    """
    watched: list[Watched] = []
    cleaned = stage(
        apply_plan(df, plan, as_of=as_of, order_by=order_by, stage=stage, watch=watched)
    )
    counts = [one.counts() for one in watched]
    if _fit(counts, cleaned.count()):
        dropped = [one.columns_dropped for one in watched]
    else:
        counts = _recounted(df, plan, as_of, order_by)
        dropped = [one["columns_dropped"] for one in counts]
    rows = [
        (
            position, one.fix_id, one.column, n["rows_before"], n["rows_after"],
            n["rows_before"] - n["rows_after"], n["values_changed"], columns,
        )
        for position, (one, n, columns) in enumerate(zip(watched, counts, dropped), start=1)
    ]
    return cleaned, df.sparkSession.createDataFrame(rows, OUTCOMES)


def _fit(counts: Sequence[Mapping[str, int]], written: int) -> bool:
    """Whether each fix begins with the rows that the one before left, and the last is written."""
    begins = [one["rows_before"] for one in counts[1:]] + [written]
    return not counts or [one["rows_after"] for one in counts] == begins


def _recounted(df: DataFrame, plan, as_of, order_by) -> list[dict[str, int]]:
    """The same counts from scans of their own: the table before each fix, and what it does."""
    found = []
    for position, (fix_id, params) in enumerate(plan):
        before = apply_plan(df, plan[:position], as_of=as_of, order_by=order_by)
        found.append(audit(before, fix_id, params, as_of=as_of, order_by=order_by).first().asDict())
    return found


def told(outcomes: DataFrame) -> DataFrame:
    """The outcomes with a message for each."""
    return outcomes.withColumn("message", F.expr(
        "format_string('%s: %,d rows dropped, %,d values changed, %,d columns dropped', "
        "concat_ws(' of ', fix_id, `column`), rows_dropped, values_changed, columns_dropped)"
    ))

"""Checks and cleaning for tables in Spark."""

from gritsieve.operators.fixes import apply_fix, apply_plan, audit
from gritsieve.plans.clean import clean, clean_then_validate
from gritsieve.plans.report import (
    ordered, overall_status, section_status, severity_summary, with_severity,
)
from gritsieve.plans.validate import measured, revalidated, validate
from gritsieve.sources.delimited import load, preview, validate_file, write_cleaned
from gritsieve.sources.staging import stage

__all__ = [
    "apply_fix", "apply_plan", "audit", "clean", "clean_then_validate", "load", "measured",
    "ordered", "overall_status", "preview", "revalidated", "section_status", "severity_summary",
    "stage", "validate", "validate_file", "with_severity", "write_cleaned",
]

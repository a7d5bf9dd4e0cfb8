"""The checks, as SQL expressions over frames of measures.

A check reads one row of measures and says whether there is a finding, how severe
it is and what can be done. Frames have a row per column (``columns``), a row per
pair of key and category (``links``) or a single row (``table``), so this work
never touches the data itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from gritsieve import roles
from gritsieve.functions import dates
from gritsieve.functions.text import literal as text

# Severities from worst to best, and the nine sections of a report.
SEVERITIES = ("CRITICAL", "WARNING", "INFO", "OK")
SECTIONS = (
    "1. Dataset Structure",
    "2. Data Types",
    "3. Missing Values",
    "4. Duplicates",
    "5. Numeric Values",
    "6. Categorical Data",
    "7. Dates & Time Range",
    "8. Keys & Identifiers",
    "9. Business Logic",
)
ERROR_SECTION = "Error"

FIX = "struct<label: string, fix_id: string, params: map<string, string>>"
FINDING = (
    "struct<check: string, section_no: int, severity: string, column: string, related: string, value: double, "
    "metrics: map<string, double>, message: string, fix_text: string, details: string, "
    f"fixes: array<{FIX}>, seq: bigint>"
)
NO_FIXES = f"cast(array() AS array<{FIX}>)"


def named(words: tuple[str, ...]) -> str:
    """SQL test: the column name contains one of the words."""
    tests = " OR ".join(f"contains(lower(`column`), {text(word)})" for word in words)
    return f"({tests})"


def say(template: str, *arguments: str) -> str:
    return f"format_string({', '.join((text(template), *arguments))})"


def percent(share: str, digits: int = 0) -> str:
    return f"format_string('%.{digits}f%%', 100 * ({share}))"


def fix(label: str, fix_id: str, column: str = "`column`", **params: str) -> str:
    pairs = ", ".join(
        [f"'col', {column}"] + [f"{text(name)}, {value}" for name, value in params.items()]
    )
    return f"named_struct('label', {label}, 'fix_id', {text(fix_id)}, 'params', map({pairs}))"


def table_fix(label: str, fix_id: str) -> str:
    params = "cast(map() AS map<string, string>)"
    return f"named_struct('label', {text(label)}, 'fix_id', {text(fix_id)}, 'params', {params})"


def fixes(*several: str) -> str:
    return f"array({', '.join(several)})"


def fix_each(names: str, label: str, fix_id: str) -> str:
    """One fix per name in an array column."""
    return f"transform({names}, c -> {fix(say(label, 'c'), fix_id, 'c')})"


def share(part: str, whole: str) -> str:
    return f"coalesce(try_divide(cast({part} AS double), {whole}), 0D)"


@dataclass(frozen=True)
class Check:
    name: str
    section: int
    frame: str
    when: str
    severity: str
    value: str
    message: str
    advice: str = ""
    details: str = "''"
    fixes: str = NO_FIXES
    metrics: tuple[str, ...] = ()
    # Whether a finding stands against the section's closing OK.
    problem: bool = True

    def finding(self, order: int) -> str:
        """The finding of one row, or null."""
        column = "CAST(NULL AS string)" if self.frame == "table" else "`column`"
        related = "category" if self.frame == "links" else "CAST(NULL AS string)"
        place = "0" if self.frame == "table" else "position"
        pairs = ", ".join(f"{text(m)}, cast({m} AS double)" for m in self.metrics)
        metrics = f"map({pairs})" if pairs else "map()"
        return (
            f"CASE WHEN {self.when} THEN cast(struct({text(self.name)}, {self.section}, "
            f"{self.severity_sql}, {column}, {related}, cast({self.value} AS double), "
            f"cast({metrics} AS map<string, double>), {self.message}, {text(self.advice)}, "
            f"{self.details}, {self.fixes}, {order} * 100000L + {place}) AS {FINDING}) END"
        )

    @property
    def severity_sql(self) -> str:
        return text(self.severity) if self.severity in SEVERITIES else self.severity


NAMED_CATEGORY = named(roles.CATEGORY_WORDS)
NAMED_DATE = named(roles.DATE_WORDS)
NAMED_ID = named(roles.ID_WORDS)
NAMED_CRITICAL = named(roles.CRITICAL_WORDS)
NAMED_NUMERIC = named(roles.NUMERIC_WORDS)

NULLS = "(n_rows - n_values)"
IS_CATEGORY = (
    f"({NAMED_CATEGORY} OR (kind = 'text' AND n_values > 0 AND n_distinct <= 50"
    f" AND {share('n_distinct', 'n_values')} < 0.1))"
)
DATE_RATIO = f"({share('array_max(date_hits)', 'n_values')})"
TEXT_DATE = f"kind = 'text' AND {NAMED_DATE}"
PARSED_DATE = "n_dates > 0"
SAMPLE = "array_join(coalesce(slice(sample, 1, {n}), array()), ', ')"


def sample(n: int) -> str:
    return SAMPLE.format(n=n)


CHECKS: tuple[Check, ...] = (
    # 1. Structure
    Check(
        "shape", 1, "table", "true", "INFO", "n_rows",
        say("%,d rows and %d columns", "n_rows", "n_columns"),
        metrics=("n_rows", "n_columns"), problem=False,
    ),
    Check(
        "empty_table", 1, "table", "n_rows = 0 OR n_columns = 0", "CRITICAL", "n_rows",
        text("The table holds no data."), "Look at where the data comes from.",
    ),
    Check(
        "few_rows", 1, "table", "n_columns > 0 AND n_rows BETWEEN 1 AND 4", "WARNING", "n_rows",
        say("Only %d rows; conclusions would rest on very little.", "n_rows"),
        metrics=("n_rows",), problem=False,
    ),
    Check(
        "blank_names", 1, "table", "n_rows > 0 AND n_blank_names > 0", "CRITICAL",
        "n_blank_names", say("%d column(s) without a name", "n_blank_names"),
        "Name the columns, or remove surplus separators from the header.",
    ),
    Check(
        "empty_columns", 1, "table", "n_rows > 0 AND size(empty_columns) > 0", "WARNING",
        "size(empty_columns)",
        say("Columns without any value: %s", "array_join(empty_columns, ', ')"),
        "They carry no information and can go.",
        fixes=fixes(table_fix("Drop all empty columns", "drop_empty_columns")),
    ),
    Check(
        "duplicate_names", 1, "table", "n_rows > 0 AND size(duplicate_names) > 0", "CRITICAL",
        "size(duplicate_names)",
        say("Column names used more than once: %s", "array_join(duplicate_names, ', ')"),
        "Give every column its own name.",
        fixes=fixes(
            table_fix("Keep the first column of each name", "drop_full_duplicate_columns")
        ),
    ),
    Check(
        "technical_columns", 1, "table", "n_rows > 0 AND size(technical_columns) > 0", "WARNING",
        "size(technical_columns)",
        say("Columns left over from a tool: %s", "array_join(technical_columns, ', ')"),
        "Drop them before the analysis.",
        fixes=fix_each("technical_columns", "Drop '%s'", "drop_column"),
    ),
    Check(
        "expected_columns", 1, "table", "n_rows > 0 AND missing_columns IS NOT NULL",
        "IF(size(missing_columns) > 0, 'CRITICAL', 'OK')", "size(missing_columns)",
        "IF(size(missing_columns) > 0, "
        + say("Expected columns that are missing: %s", "array_join(missing_columns, ', ')")
        + ", 'Every expected column is there.')",
        "Compare the source with the list of expected columns.", problem=False,
    ),
    # 2. Types
    Check(
        "column_types", 2, "table", "true", "INFO", "n_columns", text("Types of the columns"),
        details="array_join(transform(column_types, c -> concat(c.column, ': ', c.type)), '\\n')",
        problem=False,
    ),
    Check(
        "text_dates", 2, "columns", TEXT_DATE,
        f"IF({DATE_RATIO} > 0.7, 'WARNING', 'CRITICAL')", DATE_RATIO,
        f"IF({DATE_RATIO} > 0.7, "
        + say("'%s' holds dates as text; %s reads %s of them", "`column`", "date_format",
              percent(DATE_RATIO))
        + ", "
        + say("'%s' is named like a date but no format reads enough of it, e.g. %s", "`column`",
              sample(3))
        + ")",
        "Convert the column to timestamps.",
        fixes=fixes(fix(
            say("Convert '%s' to timestamps", "`column`"), "cast_to_datetime",
            format=f"IF({DATE_RATIO} > 0.7, date_format, {text(dates.AUTO)})",
        )),
        metrics=(DATE_RATIO,),
    ),
    Check(
        "text_numbers", 2, "columns",
        f"kind = 'text' AND NOT {NAMED_DATE} AND {NAMED_NUMERIC}"
        f" AND {share('n_clean', 'n_values')} > 0.7",
        "WARNING", share("n_clean", "n_values"),
        say("'%s' holds numbers as text; %s can be read, e.g. %s", "`column`",
            percent(share("n_clean", "n_values")), sample(3)),
        "Remove currency signs and convert the column.",
        fixes=fixes(fix(say("Convert '%s' to numbers", "`column`"), "cast_to_numeric")),
    ),
    Check(
        "mixed_types", 2, "columns",
        f"kind = 'text' AND {share('n_numeric', 'n_values')} > 0.1"
        f" AND {share('n_numeric', 'n_values')} < 0.9",
        "WARNING", share("n_numeric", "n_values"),
        say("'%s' mixes text with numbers (%s numbers), e.g. %s", "`column`",
            percent(share("n_numeric", "n_values")), sample(5)),
        "Split the column, or settle on one type.",
        fixes=fixes(
            fix(say("Keep all of '%s' as text", "`column`"), "cast_to_string"),
            fix(say("Convert '%s' to numbers, the rest to null", "`column`"), "cast_to_numeric"),
        ),
    ),
    # 3. Missing values
    Check(
        "null_summary", 3, "table", "size(null_columns) > 0", "WARNING", "size(null_columns)",
        say("%d column(s) have missing values", "size(null_columns)"),
        "Decide per column between filling and dropping.",
        details="array_join(transform(null_columns, c -> format_string('%s: %,d (%.1f%%)%s', "
        "c.column, c.n, 100D * c.n / n_rows, IF(c.critical, ', critical field', ''))), '\\n')",
    ),
    Check(
        "null_severity", 3, "columns", f"{NULLS} > 0",
        f"IF({NAMED_CRITICAL} AND {share(NULLS, 'n_rows')} > 0.3, 'CRITICAL', 'WARNING')", NULLS,
        say("'%s' misses %,d values (%s)", "`column`", NULLS,
            percent(share(NULLS, "n_rows"), 1)),
        "Restore the values, fill them, or drop the rows.",
        fixes="concat(IF(kind = 'numeric', "
        + fixes(
            fix(say("Fill '%s' with the mean (%s)", "`column`",
                    "coalesce(format_string('%.2f', mean), 'none')"), "fill_mean"),
            fix(say("Fill '%s' with the median (%s)", "`column`",
                    "coalesce(format_string('%.2f', median), 'none')"), "fill_median"),
            fix(say("Fill '%s' with 0", "`column`"), "fill_zero"),
        )
        + f", {NO_FIXES}), IF(kind = 'text', "
        + fixes(
            fix(say("Fill '%s' with its most frequent value", "`column`"), "fill_mode"),
            fix(say("Fill '%s' with Unknown", "`column`"), "fill_unknown"),
        )
        + f", {NO_FIXES}), "
        + fixes(fix(say("Drop the rows without '%s'", "`column`"), "drop_null_rows"))
        + ")",
    ),
    Check(
        "mostly_empty_rows", 3, "table", "n_mostly_empty > 0", "WARNING", "n_mostly_empty",
        say("%,d row(s) are more than half empty (%s)", "n_mostly_empty",
            percent(share("n_mostly_empty", "n_rows"), 1)),
        "Such rows are rarely worth keeping.", metrics=("n_mostly_empty",), problem=False,
    ),
    Check(
        "pseudo_nulls", 3, "table", "size(pseudo_columns) > 0", "WARNING", "size(pseudo_columns)",
        text("Text that stands for a missing value, such as 'n/a' or '-'"),
        "Turn it into real nulls.",
        details="array_join(transform(pseudo_columns, c -> "
        "format_string('%s: %,d', c.column, c.n)), '\\n')",
        fixes=fix_each("pseudo_columns.column", "Null the placeholders in '%s'",
                       "replace_pseudo_nulls"),
    ),
    # 4. Duplicates (each check closes with its own OK)
    Check(
        "full_duplicates", 4, "table", "n_duplicates IS NOT NULL",
        "IF(n_duplicates > 0, 'CRITICAL', 'OK')", "n_duplicates",
        "IF(n_duplicates > 0, "
        + say("%,d rows repeat an earlier row (%s)", "n_duplicates",
              percent(share("n_duplicates", "n_rows"), 1))
        + ", 'No row occurs twice.')",
        "Remove the repeated rows.",
        fixes=f"IF(n_duplicates > 0, "
        + fixes(table_fix("Remove repeated rows", "drop_full_duplicates"))
        + f", {NO_FIXES})",
    ),
    Check(
        "id_duplicates", 4, "columns", f"{NAMED_ID} AND n_distinct IS NOT NULL",
        f"CASE WHEN n_values = n_distinct THEN 'OK' WHEN {named(roles.TRANSACTION_WORDS)}"
        " THEN 'CRITICAL' ELSE 'WARNING' END",
        "n_values - n_distinct",
        "IF(n_values > n_distinct, "
        + say("'%s' repeats %,d key values (%s)", "`column`", "n_values - n_distinct",
              percent(share("n_values - n_distinct", "n_values"), 1))
        + ", "
        + say("'%s' is unique", "`column`")
        + ")",
        "Look at the repeated keys, or keep the first row of each.",
        fixes=f"IF(n_values > n_distinct, "
        + fixes(fix(say("Keep the first row of each '%s'", "`column`"), "drop_col_duplicates"))
        + f", {NO_FIXES})",
    ),
    Check(
        "soft_key_duplicates", 4, "table", "n_soft_duplicates > 0", "WARNING",
        "n_soft_duplicates",
        say("%,d rows share %s with another row", "n_soft_duplicates",
            "array_join(soft_key, ' + ')"),
        "These may be the same transaction entered twice.",
    ),
    # 5. Numeric values
    Check(
        "negative_values", 5, "columns", "n_negative > 0", "CRITICAL", "n_negative",
        say("'%s' has %,d negative values, down to %.2f", "`column`", "n_negative", "min_value"),
        "Drop these rows or take the absolute value.",
        fixes=fixes(
            fix(say("Drop the rows with '%s' below zero", "`column`"), "drop_negative_rows"),
            fix(say("Make '%s' positive", "`column`"), "abs_negative"),
        ),
    ),
    Check(
        "zero_values", 5, "columns", "n_zero > 0", "WARNING", "n_zero",
        say("'%s' is zero in %,d rows", "`column`", "n_zero"),
        "Find out whether zero is a real value here.",
        fixes=fixes(fix(say("Drop the rows with '%s' zero", "`column`"), "drop_zero_rows")),
    ),
    Check(
        "percent_out_of_range", 5, "columns", "n_out_of_range > 0", "WARNING", "n_out_of_range",
        say("'%s' leaves the range 0 to 100 in %,d rows", "`column`", "n_out_of_range"),
        "Find out whether it is a fraction or a percentage.",
        fixes=fixes(fix(say("Divide '%s' by 100", "`column`"), "percent_divide_100")),
    ),
    Check(
        "iqr_outliers", 5, "columns", f"n_outliers > 0 AND {share('n_outliers', 'n_values')} > 0.01",
        "WARNING", "n_outliers",
        say("'%s' has %,d values far outside its quartiles (range %.2f to %.2f, median %.2f)",
            "`column`", "n_outliers", "min_value", "max_value", "median"),
        "Look at these values; drop or cap them.",
        fixes=fixes(fix(
            say("Cap '%s' at three interquartile ranges", "`column`"), "cap_outliers_iqr"
        )),
    ),
    Check(
        "total_mismatch", 5, "table", "n_mismatch > 0", "WARNING", "n_mismatch",
        say("In %,d rows the total is not quantity x price x (1 - discount)", "n_mismatch"),
        "Taxes, rounding or a discount may be missing from the rule.",
        metrics=("n_mismatch",),
    ),
    # 6. Categories
    Check(
        "case_variants", 6, "columns", f"{IS_CATEGORY} AND n_normalised < n_distinct", "WARNING",
        "n_distinct - n_normalised",
        say("'%s' has %d values that differ only by case or whitespace", "`column`",
            "n_distinct - n_normalised"),
        "Bring the values to one spelling.",
        fixes=fixes(
            fix(say("Strip and lower '%s'", "`column`"), "strip_lowercase"),
            fix(say("Strip and capitalise '%s'", "`column`"), "strip_titlecase"),
        ),
    ),
    Check(
        "category_placeholders", 6, "columns", f"{IS_CATEGORY} AND n_placeholder > 0", "WARNING",
        "n_placeholder",
        say("'%s' has a placeholder in %,d rows", "`column`", "n_placeholder"),
        "Turn placeholders into nulls.",
        fixes=fixes(
            fix(say("Null the placeholders in '%s'", "`column`"), "replace_pseudo_nulls")
        ),
    ),
    Check(
        "high_cardinality", 6, "columns", f"{IS_CATEGORY} AND n_distinct > 100", "WARNING",
        "n_distinct",
        say("'%s' has %,d different values, many for a category", "`column`", "n_distinct"),
        "It may be a key or free text.",
    ),
    Check(
        "category_values", 6, "columns", f"{IS_CATEGORY} AND n_distinct <= 30", "INFO",
        "n_distinct",
        say("'%s' has %d values: %s%s", "`column`", "n_distinct",
            "array_join(coalesce(listed, array()), ', ')",
            "IF(n_distinct > 20, format_string(' and %d more', n_distinct - 20), '')"),
        problem=False,
    ),
    Check(
        "no_category", 6, "table", "n_category_columns = 0", "INFO", "0",
        text("No column looks like a category."), problem=False,
    ),
    # 7. Dates
    Check(
        "date_parse_ratio", 7, "columns",
        f"{NAMED_DATE} AND kind <> 'datetime' AND {DATE_RATIO} < 0.8", "CRITICAL", DATE_RATIO,
        say("Only %s of '%s' can be read as dates", percent(DATE_RATIO), "`column`"),
        "Convert what can be read; the rest becomes null.",
        fixes=fixes(fix(
            say("Convert '%s' to timestamps", "`column`"), "cast_to_datetime",
            format=text(dates.AUTO),
        )),
    ),
    Check(
        "unparsed_dates", 7, "columns", "n_unparsed > 0", "WARNING", "n_unparsed",
        say("'%s' has %,d values that are no dates", "`column`", "n_unparsed"),
        "Look for other spellings in these rows.",
    ),
    Check(
        "date_range", 7, "columns", PARSED_DATE, "INFO",
        "timestampdiff(DAY, first_date, last_date)",
        say("'%s' runs from %s to %s (%d days)", "`column`",
            "date_format(first_date, 'yyyy-MM-dd')", "date_format(last_date, 'yyyy-MM-dd')",
            "timestampdiff(DAY, first_date, last_date)"),
        problem=False,
    ),
    Check(
        "future_dates", 7, "columns", "n_future > 0", "WARNING", "n_future",
        say("'%s' lies in the future in %,d rows", "`column`", "n_future"),
        "These may be typing errors.",
        fixes=fixes(
            fix(say("Drop the rows with '%s' in the future", "`column`"), "drop_future_dates")
        ),
    ),
    Check(
        "old_dates", 7, "columns", "n_old > 0", "WARNING", "n_old",
        say("'%s' lies before 1990 in %,d rows", "`column`", "n_old"),
        "Look at these rows; the dates may be wrong.",
    ),
    Check(
        "ambiguous_dates", 7, "columns", f"{PARSED_DATE} AND n_ambiguous > 0", "WARNING",
        "n_ambiguous",
        say("'%s' does not tell day from month in %,d rows", "`column`", "n_ambiguous"),
        "Say which comes first when converting.",
    ),
    Check(
        "date_density", 7, "columns",
        "n_dates > 30 AND n_days / (timestampdiff(DAY, first_date, last_date) + 1) < 0.5",
        "WARNING", "n_days",
        say("'%s' covers %d of %d days; there may be gaps", "`column`", "n_days",
            "timestampdiff(DAY, first_date, last_date) + 1"),
        "Find out whether every period was exported.",
    ),
    Check(
        "no_date", 7, "table", "n_date_columns = 0", "INFO", "0",
        text("No column looks like a date."), problem=False,
    ),
    # 8. Keys
    Check(
        "null_ids", 8, "columns", f"{NAMED_ID} AND n_values > 0 AND {NULLS} > 0", "WARNING",
        NULLS, say("'%s' is missing in %,d rows", "`column`", NULLS),
        "A key should always be there; look at these rows or drop them.",
        fixes=fixes(fix(say("Drop the rows without '%s'", "`column`"), "drop_null_rows")),
    ),
    Check(
        "id_lengths", 8, "columns", f"{NAMED_ID} AND n_lengths > 3", "WARNING", "n_lengths",
        say("'%s' has %d different lengths, mostly %s", "`column`", "n_lengths",
            "array_join(transform(top_lengths, "
            "e -> format_string('%d (%,d rows)', e.length, e.n)), ', ')"),
        "Sources may have been mixed.",
    ),
    Check(
        "mixed_id_types", 8, "columns",
        f"{NAMED_ID} AND kind = 'text' AND {share('n_numeric', 'n_values')} > 0.05"
        f" AND {share('n_numeric', 'n_values')} < 0.95",
        "WARNING", share("n_numeric", "n_values"),
        say("'%s' mixes numeric and text keys (%s numeric)", "`column`",
            percent(share("n_numeric", "n_values"))),
        "Treat all keys as text.",
        fixes=fixes(fix(say("Keep '%s' as text", "`column`"), "cast_to_string")),
    ),
    Check(
        "id_maps_to_many_categories", 8, "links", "n_keys > 0", "WARNING", "n_keys",
        say("%,d values of '%s' come with several values of '%s'", "n_keys", "`column`",
            "category"),
        "Find out which of them is right.",
    ),
    Check(
        "no_id", 8, "table", "n_id_columns = 0", "INFO", "0",
        text("No column looks like a key."), problem=False,
    ),
    # 9. Business logic
    Check(
        "discount_not_applied", 9, "table", "n_discount_ignored > 0", "WARNING",
        "n_discount_ignored",
        say("%,d rows have a discount but a total above the price", "n_discount_ignored"),
        "The discount may be missing from the total.", metrics=("n_discount_ignored",),
    ),
    Check(
        "suspicious_payment", 9, "table", "n_suspicious > 0", "WARNING", "n_suspicious",
        say("Payment values that look wrong: %s", "array_join(suspicious, ', ')"),
        "Settle on a fixed list of payment methods.",
    ),
    Check(
        "product_multi_category", 9, "table", "n_multi_category > 0", "CRITICAL",
        "n_multi_category",
        say("%,d products belong to several categories", "n_multi_category"),
        "A product should have one category.",
    ),
)

BY_NAME = {check.name: check for check in CHECKS}


@dataclass(frozen=True)
class Closing:
    """The OK that ends a section without problems."""

    section: int
    when: str
    message: str


CLOSINGS = (
    Closing(1, "n_rows > 0 AND n_columns > 0", "The structure is sound."),
    Closing(2, "true", "The types fit the columns."),
    Closing(3, "true", "Nothing is missing."),
    Closing(5, "true", "Numbers are within their ranges."),
    Closing(6, "n_category_columns > 0", "Categories are consistent."),
    Closing(7, "n_date_columns > 0", "Dates are plausible."),
    Closing(8, "n_id_columns > 0", "Keys are consistent."),
    Closing(9, "true", "No business rule is broken."),
)


def findings(frame_name: str, frame: DataFrame) -> DataFrame:
    """Everything the checks of one frame have to say, in one projection."""
    entries = (
        check.finding(order) for order, check in enumerate(CHECKS) if check.frame == frame_name
    )
    return frame.selectExpr(f"inline(array_compact(array({', '.join(entries)})))")


def run_check(name: str, frame: DataFrame) -> DataFrame:
    """One check alone: the measures of the rows with a finding, and its severity."""
    check = BY_NAME[name]
    return frame.where(check.when).selectExpr("*", f"{check.severity_sql} AS severity")

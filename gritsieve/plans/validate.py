"""A full validation: measure the table in a few shared passes, then judge.

Every pass ends in a result whose size depends on the schema, not on the rows: a
record per column, per (key, category) pair, or one for the table. These records
make up three small frames, and the checks run over them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date, datetime
from functools import cache

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gritsieve import roles
from gritsieve.functions import dates
from gritsieve.functions.numbers import nan_to_null
from gritsieve.functions.text import ident, literal, one_of
from gritsieve.operators import (
    calendar, checks, date_shapes, duplicates, profile, quantiles, values,
)
from gritsieve.operators.fixes import COLUMN_DROPS, COLUMN_FIXES, apply_fix
from gritsieve.sources.staging import stage

COLUMNS_FRAME = (
    "position int, column string, kind string, type string, n_rows bigint, "
    + ", ".join(f"{name} {measure.sql_type}" for name, measure in profile.MEASURES.items())
    + ", sample array<string>, n_distinct bigint, n_normalised bigint, n_placeholder bigint, "
    "listed array<string>, n_lengths bigint, "
    "top_lengths array<struct<length: bigint, n: bigint>>, q1 double, median double, q3 double, "
    "n_outliers bigint, date_format string, n_unparsed bigint, n_dates bigint, n_days bigint, "
    "first_date timestamp_ntz, last_date timestamp_ntz, n_future bigint, n_old bigint"
)
LINKS_FRAME = "position int, column string, category string, n_keys bigint"
_COUNTED = "array<struct<column: string, n: bigint>>"
TABLE_FRAME = (
    "n_rows bigint, n_columns bigint, n_mostly_empty bigint, n_mismatch bigint, "
    "n_discount_ignored bigint, n_duplicates bigint, n_soft_duplicates bigint, "
    "soft_key array<string>, n_multi_category bigint, n_suspicious bigint, "
    "suspicious array<string>, n_blank_names bigint, duplicate_names array<string>, "
    "technical_columns array<string>, missing_columns array<string>, "
    "empty_columns array<string>, "
    "null_columns array<struct<column: string, n: bigint, critical: boolean>>, "
    f"pseudo_columns {_COUNTED}, column_types array<struct<column: string, type: string>>, "
    "n_category_columns bigint, n_id_columns bigint, n_date_columns bigint"
)
ISSUE_COLUMNS = (
    "issue_id", "check", "section", "severity", "column", "related", "value", "metrics", "message",
    "fix_text", "details", "fixes", "section_no", "seq",
)


# Fixes whose result costs many regular expressions per value.
PARSING_FIXES = ("cast_to_numeric", "cast_to_datetime")
# Jobs of one validation that may run side by side.
CONCURRENT_JOBS = 6


def unique_names(names: Sequence[str]) -> list[str]:
    """Tell repeated and blank names apart: "a", "a.1", "Unnamed: 2"."""
    result: list[str] = []
    for position, name in enumerate(names):
        base = name if name.strip() else f"Unnamed: {position}"
        candidate, copy = base, 0
        while candidate in result:
            copy += 1
            candidate = f"{base}.{copy}"
        result.append(candidate)
    return result


def _sections_of(field: T.StructField) -> set[int]:
    """The sections that cannot be said to be all right without a column."""
    roles_of = {
        5: roles.kind(field.dataType) == "numeric", 6: roles.is_category_name(field.name),
        7: roles.is_date(field), 8: roles.is_id(field.name), 9: roles.is_numeric_name(field.name),
    }
    return {2, 3, 4} | {section for section, applies in roles_of.items() if applies}


class _Measurements:
    """The records of one table, filled in pass by pass."""

    def __init__(
        self,
        df: DataFrame,
        header: Sequence[str],
        expected_columns: Sequence[str],
        as_of: str | date | datetime | None,
        order_by: Sequence[str],
        before: _Measurements | None = None,
        touched: Collection[str] | None = None,
    ):
        self.before = before  # of the same rows, with other values in the touched columns
        self.touched = None if touched is None else set(touched)
        self.df = df
        self.spark = df.sparkSession
        self.as_of = as_of
        self.order_by = order_by
        self.columns: dict[str, dict] = {}
        self.links: list[dict] = []
        self.wanted: dict[str, list[str]] = {}  # keys and the categories they are held against
        self.rule: tuple[str, str] | None = None  # product and category column
        self.errors: list[tuple[str, str]] = []
        self.unread: list[tuple[str, str]] = []  # columns or measures that failed, and why
        self.withheld: set[int] = set()
        self.spelled: dict[str, tuple[str, ...]] = {}  # formats of dates in other spellings
        counts = Counter(header)
        self.table: dict = {
            "n_columns": len(df.columns),
            "n_blank_names": sum(1 for name in header if not name.strip()),
            "duplicate_names": [name for name, n in counts.items() if n > 1],
            "technical_columns": [name for name in df.columns if roles.is_technical(name)],
            "missing_columns": (
                [name for name in expected_columns if name not in header]
                if expected_columns
                else None
            ),
            "column_types": [
                {"column": field.name, "type": field.dataType.simpleString()}
                for field in df.schema.fields
            ],
            "soft_key": roles.soft_key(df.columns),
            "n_id_columns": sum(map(roles.is_id, df.columns)),
            "n_date_columns": sum(map(roles.is_date, df.schema.fields)),
        }

    def run(self) -> None:
        """The scan first, then the passes that build on it, several jobs at a time.

        A column that cannot be read is left out of all of them and reported.

        A pass that fails is reported and the others go on; the sections it serves
        get no closing OK.
        """
        self._attempt(self.scan, ())
        if self.errors:
            return
        self._attempt(self.spellings, ())
        passes: tuple[tuple[Callable[[], None], tuple[int, ...]], ...] = (
            (self.categories_and_keys, (6, 8, 9)),
            (self.duplicates, ()),
            (self.lengths, (8,)),
            (self.outliers, (5,)),
            (self.calendar, (7,)),
            (self.payments, (9,)),
            (self.samples, ()),
        )
        attempt = inheritable_thread_target(self.spark)(self._attempt)
        with ThreadPoolExecutor(max_workers=CONCURRENT_JOBS) as pool:
            list(pool.map(lambda one: attempt(*one), passes))

    def _attempt(self, step: Callable[[], None], sections: tuple[int, ...]) -> None:
        try:
            step()
        except Exception as error:
            self.errors.append((step.__name__, f"{type(error).__name__}: {error}"))
            self.withheld.update(sections)

    def _merge(self, frame: DataFrame, only: Iterable[str] | None = None) -> None:
        """Add a frame with one row per column to the records of the columns."""
        for row in frame.collect():
            record = row.asDict()
            name = record.pop("column")
            kept = record if only is None else {key: record[key] for key in only}
            self.columns[name].update(kept)

    def _named(self, test: Callable[[dict], bool]) -> list[str]:
        return [name for name, record in self.columns.items() if test(record)]

    def is_touched(self, name: str) -> bool:
        return self.touched is None or name in self.touched

    def differs(self, names: Collection[str] | None, before: Collection[str] | None) -> bool:
        """Whether a measure of these columns has to be taken again."""
        return self.touched is None or names != before or any(map(self.is_touched, names or ()))

    def rescan(self) -> None:
        """Measure the touched columns, and what the table's measures share with them."""
        before = self.before
        old_rules, rules = (
            {"n_mismatch": profile.total_rule(df), "n_discount_ignored": profile.discount_rule(df)}
            for df in (before.df, self.df)
        )
        columns_of = lambda rule: tuple(rule.values()) if isinstance(rule, dict) else rule
        again = [
            name for name, rule in rules.items() if self.differs(columns_of(rule), columns_of(old_rules[name]))
        ]
        names = [name for name in self.df.columns if name in self.touched]
        found = profile.measured(self.df, names, again)
        for position, name in enumerate(self.df.columns):
            record = found[0].get(name) or {**before.columns[name]}
            self.columns[name] = record | {"position": position, "n_rows": before.table["n_rows"]}
        self.table.update({name: before.table.get(name) for name in (*profile.TABLE_MEASURES, "n_rows")})
        self.table.update(found[1])
        gaps = any(self.columns[name]["n_values"] != before.columns[name]["n_values"] for name in names)
        if gaps or len(self.df.columns) != len(before.df.columns):
            self.table.update(profile.measured(self.df, (), ("n_mostly_empty",))[1])
        for name, formats in before.spelled.items():
            if name in self.columns and name not in self.touched:
                self.spelled[name] = formats
        self._name_gaps()

    def scan(self) -> None:
        if self.before is not None:
            return self.rescan()
        columns, table, failures = profile.isolated_scan(self.df)
        self.columns = {record["column"]: record for record in columns}
        self.table.update(table)
        unread = [field for field in self.df.schema.fields if field.name in failures]
        for name, error in failures.items():
            self.unread.append((name, f"{type(error).__name__}: {error}"))
        for field in unread:
            self.withheld.update(_sections_of(field))
        if unread:
            self.df = self.df.select(*(ident(name) for name in self.columns))
        self._name_gaps()

    def _name_gaps(self) -> None:
        missing = {name: c["n_rows"] - c["n_values"] for name, c in self.columns.items()}
        self.table["empty_columns"] = self._named(lambda c: c["n_values"] == 0)
        self.table["null_columns"] = [
            {"column": name, "n": n, "critical": roles.is_critical(name)}
            for name, n in missing.items()
            if n > 0
        ]
        self.table["pseudo_columns"] = [
            {"column": name, "n": c["n_pseudo"]} for name, c in self.columns.items() if c["n_pseudo"]
        ]

    def spellings(self) -> None:
        """Look closer at text that is named like a date and no known format reads well."""
        names = self._named(
            lambda c: self.is_touched(c["column"])
            and c["kind"] == "text"
            and c["date_hits"] is not None
            and not calendar.usable_format(c["date_hits"], c["n_values"])[1]
            and c["n_values"] > 0
        )
        if not names:
            return
        for name, (formats, n_parsed) in date_shapes.spelled_dates(self.df, names).items():
            hits = list(self.columns[name]["date_hits"])
            if n_parsed > max(hits):
                hits[dates.CANDIDATES.index(dates.AUTO)] = n_parsed
                self.columns[name]["date_hits"] = hits
                self.spelled[name] = formats

    def categories(self) -> None:
        candidates = self._named(
            lambda c: self.is_touched(c["column"])
            and (
                roles.is_category_name(c["column"])
                or (
                    c["kind"] == "text"
                    and c["n_values"] > 0
                    and c["distinct_floor"] <= profile.FEW_VALUES
                )
            )
        )
        for name in candidates:
            self.columns[name].update(n_distinct=0, n_normalised=0, n_placeholder=0)
        if candidates:
            self._merge(values.category_values(self.df, candidates))
        chosen = self._named(self.is_category)
        self.table["n_category_columns"] = len(chosen)
        listed = [
            name for name in chosen if name in candidates and 0 < self.columns[name]["n_distinct"] <= 30
        ]
        if listed:
            self._merge(values.smallest_values(self.df, listed))

    @staticmethod
    def is_category(record: dict) -> bool:
        if roles.is_category_name(record["column"]):
            return True
        return (
            record["kind"] == "text"
            and record["n_values"] > 0
            and record.get("n_distinct") is not None
            and record["n_distinct"] <= profile.FEW_VALUES
            and record["n_distinct"] / record["n_values"] < profile.FEW_VALUES_SHARE
        )

    def categories_and_keys(self) -> None:
        self.categories()
        self.keys()

    def keys(self) -> None:
        """One grouping per key column: distinct keys, and keys with several categories."""
        ids = [name for name in self.columns if roles.is_id(name)]
        categories = [name for name, c in self.columns.items() if self.is_category(c)]
        linked = {
            key: [name for name in categories if name != key][:2]
            for key in ids
            if self.columns[key]["n_values"] > 0
        }
        wanted = {key: list(linked.get(key, ())) for key in ids}
        product = roles.product_id_column(self.df.columns)
        category = roles.category_column(self.df.columns)
        has_rule = product is not None and category is not None and product != category
        if has_rule:
            self.rule = (product, category)
        if has_rule and category not in wanted.setdefault(product, []):
            wanted[product].append(category)
        self.wanted = {key: list(against) for key, against in wanted.items()}
        if self.before is not None:
            wanted = self._untold(wanted, linked, product if has_rule else None, category)
        if not wanted:
            return
        hashable = [
            name
            for name, c in self.columns.items()
            if c.get("n_hashes") is not None and c["n_hashes"] == c["n_distinct"]
        ]
        for row in duplicates.key_summary(self.df, wanted, hashable).collect():
            key = row["column"]
            found = {link["category"]: link["n_keys"] for link in row["links"]}
            self.columns[key]["n_distinct"] = row["n_distinct"]
            self.links += [
                {
                    "position": self.columns[key]["position"],
                    "column": key,
                    "category": name,
                    "n_keys": found[name],
                }
                for name in linked.get(key, ())
            ]
            if has_rule and key == product:
                self.table["n_multi_category"] = found[category]

    def _untold(self, wanted, linked, product, category) -> dict[str, list[str]]:
        """The keys that have to be grouped again; what is known of the others is kept."""
        before = self.before
        known = {(link["column"], link["category"]): link["n_keys"] for link in before.links}
        multi = before.table.get("n_multi_category")
        again = {}
        for key, against in wanted.items():
            same = not self.differs([key, *against], [key, *before.wanted.get(key, ())])
            kept = [(key, name) for name in linked.get(key, ())]
            rule_known = key != product or (before.rule == (product, category) and multi is not None)
            if not same or not rule_known or any(pair not in known for pair in kept):
                again[key] = against
                continue
            self.links += [
                {
                    "position": self.columns[key]["position"], "column": key, "category": name,
                    "n_keys": known[key, name],
                }
                for _, name in kept
            ]
            if key == product:
                self.table["n_multi_category"] = multi
        return again

    def lengths(self) -> None:
        ids = [name for name in self.columns if roles.is_id(name) and self.is_touched(name)]
        if ids:
            self._merge(values.length_summary(self.df, ids))

    def outliers(self) -> None:
        counts = {
            name: c["n_values"]
            for name, c in self.columns.items()
            if self.is_touched(name) and c["kind"] == "numeric" and c["n_values"] > 0
        }
        if not counts:
            return
        found = quantiles.exact_quantiles(self.df, counts)
        suspects = {}
        for name, (first, median, third) in found.items():
            record = self.columns[name]
            low, high = quantiles.fences((first, median, third))
            record.update(q1=first, median=median, q3=third)
            # The extremes of the scan often show that nothing can be outside.
            if third > first:
                record["n_outliers"] = 0
                if record["min_value"] < low or record["max_value"] > high:
                    suspects[name] = (first, median, third)
        if suspects:
            self._merge(quantiles.outlier_counts(self.df, suspects), ("n_outliers",))

    def calendar(self) -> None:
        formats = {}
        for field in self.df.schema.fields:
            if not roles.is_date(field) or not self.is_touched(field.name):
                continue
            record = self.columns[field.name]
            if record["kind"] == "datetime":
                formats[field.name] = None
                continue
            found, enough = calendar.usable_format(record["date_hits"], record["n_values"])
            record["date_format"] = found
            if enough:
                formats[field.name] = self.spelled.get(field.name, found)
        if formats:
            self._merge(calendar.date_summary(self.df, formats, self.as_of))

    def duplicates(self) -> None:
        rows, before = self.table["n_rows"], self.before
        if self.differs(self.df.columns, None if before is None else before.df.columns):
            self.table["n_duplicates"] = duplicates.duplicate_rows(self.df, rows).first()[0]
        else:
            self.table["n_duplicates"] = before.table["n_duplicates"]
        soft_key = self.table["soft_key"]
        if soft_key and not self.differs(soft_key, None if before is None else before.table["soft_key"]):
            self.table["n_soft_duplicates"] = before.table["n_soft_duplicates"]
        elif soft_key:
            soft = duplicates.surplus_rows(self.df, self.table["soft_key"])
            self.table["n_soft_duplicates"] = soft.first()[0]

    def payments(self) -> None:
        column = roles.payment_column(self.df.columns)
        if column is None:
            return
        before = None if self.before is None else roles.payment_column(self.before.df.columns)
        if not self.differs([column], [before]):
            for name in ("suspicious", "n_suspicious"):
                self.table[name] = self.before.table.get(name)
            return
        suspicious = values.suspicious_values(self.df, column)
        rows = suspicious.orderBy("value").limit(values.LISTED_SUSPECTS).collect()
        self.table["suspicious"] = [row["value"] for row in rows]
        self.table["n_suspicious"] = (
            len(rows) if len(rows) < values.LISTED_SUSPECTS else suspicious.count()
        )

    def samples(self) -> None:
        def doubtful(c: dict) -> bool:
            if not self.is_touched(c["column"]) or c["kind"] != "text" or c["n_values"] == 0:
                return False
            of = c["n_values"]
            dated = c["date_hits"] is not None
            return (
                (dated and max(c["date_hits"]) / of <= 0.7)
                or (c["n_clean"] is not None and c["n_clean"] / of > 0.7)
                or 0.1 < c["n_numeric"] / of < 0.9
            )

        names = self._named(doubtful)
        if names:
            self._merge(values.column_samples(self.df, names, self.order_by))

    def frames(self) -> dict[str, DataFrame]:
        return {
            "table": _local_frame(self.spark, [self.table], TABLE_FRAME),
            "columns": _local_frame(self.spark, list(self.columns.values()), COLUMNS_FRAME),
            "links": _local_frame(self.spark, self.links, LINKS_FRAME),
        }


@cache
def _schema(definition: str) -> T.StructType:
    return SparkSession.active().createDataFrame([], definition).schema


def _local_frame(spark: SparkSession, records: list[dict], definition: str) -> DataFrame:
    """A local relation of a few records; what a record lacks is null."""
    schema = _schema(definition)
    return spark.createDataFrame(
        pa.Table.from_pylist(records, schema=to_arrow_schema(schema)), schema
    )


def _local(found: DataFrame) -> DataFrame:
    """The same few rows as a local relation: one per finding, bounded by the schema."""
    return found.sparkSession.createDataFrame(found.toArrow(), found.schema)


def _closings(found: DataFrame, table: DataFrame, withheld: Iterable[int]) -> DataFrame:
    """The OK of each section that applies and has no problem."""
    entries = (
        f"struct({c.section} AS section_no, {literal(c.message)} AS message, {c.when} AS applies)"
        for c in checks.CLOSINGS
        if c.section not in withheld
    )
    problems = one_of(tuple(check.name for check in checks.CHECKS if check.problem))
    blamed = found.where(f"check IN {problems} AND severity IN ('CRITICAL', 'WARNING')")
    return (
        table.selectExpr(f"inline(array({', '.join(entries)}))")
        .where("applies")
        .join(blamed.select("section_no").distinct(), "section_no", "left_anti")
        .selectExpr(
            "inline(array(cast(struct('section_ok', section_no, 'OK', CAST(NULL AS string), "
            "CAST(NULL AS string), 0D, "
            f"cast(map() AS map<string, double>), message, '', '', {checks.NO_FIXES}, 10000000L) "
            f"AS {checks.FINDING})))"
        )
    )


def issues_frame(found: DataFrame) -> DataFrame:
    """Findings with their section name and an id that is the same in every run."""
    names = f"array{one_of(checks.SECTIONS)}"
    section = f"coalesce(get({names}, section_no - 1), {literal(checks.ERROR_SECTION)})"
    return found.selectExpr(
        f"sha2(concat_ws('|', check, {section}, coalesce(`column`, ''), coalesce(related, '')), "
        "256) AS issue_id",
        "check",
        f"{section} AS section",
        *ISSUE_COLUMNS[3:],
    )


def single_issue(
    spark: SparkSession, check: str, section_no: int, severity: str, message: str,
    fix_text: str = "", column: str | None = None, related: str | None = None,
) -> DataFrame:
    row = (check, section_no, severity, column, related, 0.0, {}, message, fix_text, "", [], -1)
    return issues_frame(
        spark.createDataFrame([(row,)], f"f {checks.FINDING}").select("f.*")
    )


def validate(
    df: DataFrame,
    *,
    header: Sequence[str] | None = None,
    expected_columns: Sequence[str] = (),
    as_of: str | date | datetime | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Run all checks and return the issues.

    ``header`` is the raw header where it differs from the column names (blank or
    repeated names). ``as_of`` is the time that dates are measured against, the
    current time by default. ``order_by`` is the row order that samples follow.

    The table is read once per pass, each pass reading only its columns. A table
    that is costly to compute should be written first; see ``sources.staging``.
    """
    return measured(
        df, header=header, expected_columns=expected_columns, as_of=as_of, order_by=order_by
    ).issues


@dataclass(frozen=True)
class Validated:
    """A table, its issues, and the measures behind them."""

    df: DataFrame
    issues: DataFrame
    options: Mapping
    measurements: _Measurements = field(repr=False)


def measured(
    df: DataFrame,
    *,
    header: Sequence[str] | None = None,
    expected_columns: Sequence[str] = (),
    as_of: str | date | datetime | None = None,
    order_by: Sequence[str] = (),
) -> Validated:
    """What ``validate`` finds, with the measures, so that ``revalidated`` can go on from them."""
    options = {"expected_columns": expected_columns, "as_of": as_of, "order_by": order_by}
    names = unique_names(df.columns)
    table = nan_to_null(df if names == df.columns else df.toDF(*names))
    found = _Measurements(table, list(df.columns if header is None else header), **options)
    found.run()
    return Validated(table, _issues(found), options, found)


def revalidated(
    before: Validated, fix_id: str, params: Mapping[str, str] | None = None
) -> Validated:
    """The table after one fix with its issues, measured again as far as the fix reaches.

    A fix of one column has its passes read that column, and others only where a rule, a key
    or a whole row holds it against them; without the column that ``drop_column`` and
    ``drop_empty_columns`` take away nothing else changes. A fix that drops rows changes every
    measure: its table is written and measured anew. So is a table of which a measure failed.
    The table is also written after a fix that parses text, else each pass would parse again.
    """
    options = before.options
    df = apply_fix(before.df, fix_id, params, as_of=options["as_of"], order_by=options["order_by"])
    by_column = fix_id in COLUMN_FIXES or fix_id in COLUMN_DROPS
    if not by_column or fix_id in PARSING_FIXES:  # many passes follow, and plans of many fixes do not grow
        df = stage(df)
    touched = {(params or {}).get("col")} if fix_id in COLUMN_FIXES else set()
    old = before.measurements
    if not by_column or old.errors or old.unread:
        return measured(df, **options)
    found = _Measurements(df, list(df.columns), **options, before=old, touched=touched)
    found.run()
    if found.errors:
        return measured(df, **options)
    return Validated(df, _issues(found), options, found)


def _issues(measured: _Measurements) -> DataFrame:
    if any(name == "scan" for name, _ in measured.errors):
        found = None
    else:
        frames = measured.frames()
        found = checks.findings("table", frames["table"])
        for name in ("columns", "links"):
            found = found.unionAll(checks.findings(name, frames[name]))
        found = _local(found)
        found = _local(found.unionAll(_closings(found, frames["table"], measured.withheld)))
    spark = measured.spark
    result = None if found is None else issues_frame(found)
    failed = [("error", None, f"Step {name} failed: {message}") for name, message in measured.errors]
    failed += [
        ("unreadable", name, f"'{name}' could not be measured: {message}") for name, message in measured.unread
    ]
    for check, name, message in failed:
        error = single_issue(spark, check, 0, "WARNING", message, column=name)
        result = error if result is None else result.unionAll(error)
    return result

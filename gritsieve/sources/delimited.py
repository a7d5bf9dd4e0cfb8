"""Read and write delimited text: find out encoding and separator, infer types.

What a file needs is decided by one distributed pass over its raw lines (bytes
that are no UTF-8, quotes left open at the end of a line), and by its first line.
Files of a folder that need the same are read together, once, with these settings;
their columns are put together by name.
"""

from __future__ import annotations

import csv
import os.path
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import partial, reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gritsieve.functions import text
from gritsieve.functions.numbers import text_to_number
from gritsieve.functions.text import ident, literal
from gritsieve.plans.validate import single_issue, unique_names, validate
from gritsieve.sources import quoted

# Separators and encodings in the order they are tried.
SEPARATORS = (",", ";", "\t", "|")
UTF8, CP1251, LATIN1 = "utf-8", "cp1251", "latin-1"

# The one byte that has no character in cp1251.
NOT_CP1251 = 0x98

LISTED_FILES = 20

TRUE_TEXT = ("True", "TRUE", "true")
FALSE_TEXT = ("False", "FALSE", "false")
INTEGER_TEXT = r"r'^[+-]?\d+\z'"


@dataclass(frozen=True)
class Layout:
    """How a file has to be read."""

    separator: str
    encoding: str
    header: tuple[str, ...]
    multi_line: bool
    files: tuple[str, ...] = ()


@dataclass(frozen=True)
class Loaded:
    """A loaded table with the raw header and the issues met on the way."""

    df: DataFrame | None
    issues: DataFrame
    header: tuple[str, ...] = ()
    layout: Layout | None = field(default=None)
    layouts: tuple[Layout, ...] = ()

    @property
    def ok(self) -> bool:
        return self.df is not None


def file_flags(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: what its bytes and quotes are like, and which line is its first.

    Every buffer has a fixed size, so lines are counted where they are read.
    """
    quotes = "octet_length(value) - octet_length(replace(value, '\"', ''))"
    return _file_lines(spark, path).groupBy("file").agg(
        F.expr("coalesce(bool_or(NOT is_valid_utf8(value)), false) AS not_utf8"),
        F.expr(
            f"coalesce(bool_or(contains(CAST(value AS BINARY), X'{NOT_CP1251:02X}')), false) "
            "AS not_cp1251"
        ),
        F.expr(f"coalesce(bool_or(({quotes}) % 2 = 1), false) AS open_quote"),
        F.expr("min(CASE WHEN start = 0 AND octet_length(value) > 0 THEN at END) AS head_at"),
    )


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).selectExpr(
        "value", "_metadata.file_path AS file", "_metadata.file_block_start AS start",
        "monotonically_increasing_id() AS at",
    )


def _heads(spark: SparkSession, path: str, flags: list) -> dict[str, bytes]:
    """The first line of each file that has one."""
    if len(flags) == 1:
        first = spark.read.text(path).where("octet_length(value) > 0").selectExpr("CAST(value AS BINARY)").first()
        return {} if first is None else {flags[0]["file"]: bytes(first[0])}
    places = [(row["file"], row["head_at"]) for row in flags if row["head_at"] is not None]
    if not places:
        return {}
    wanted = F.broadcast(spark.createDataFrame(places, "file string, at long"))  # a row per file
    found = _file_lines(spark, path).join(wanted, ["file", "at"]).selectExpr("file", "CAST(value AS BINARY) AS head")
    heads = {row["file"]: bytes(row["head"]) for row in found.collect()}
    if len(heads) != len(places):
        raise RuntimeError("the files were cut into other ranges than before; load them again")
    return heads


def sniff_all(
    spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None
) -> list[Layout]:
    """The layouts of a file or folder, each with its files; that of the most files first.

    Encoding and quoting come from all lines of a file, separator and header from its
    first one that is not empty. A file without lines has no layout. The driver gets a
    record per file, as it does when it lists a folder.
    """
    flags = file_flags(spark, path).collect()
    heads = _heads(spark, path, flags)
    files: dict[Layout, list[str]] = {}
    for row in sorted(flags, key=lambda row: row["file"]):
        if row["file"] not in heads:
            continue
        chars = encoding or UTF8
        if encoding is None and row["not_utf8"]:
            chars = LATIN1 if row["not_cp1251"] else CP1251
        line = heads[row["file"]].decode("utf-8-sig" if chars == UTF8 else chars)
        cells = separator or next((s for s in SEPARATORS if len(_split(line, s)) > 1), ",")
        layout = Layout(cells, chars, tuple(_split(line, cells)), row["open_quote"])
        files.setdefault(layout, []).append(row["file"])
    ordered = sorted(files, key=lambda layout: (-len(files[layout]), files[layout][0]))
    if len(ordered) == 1:
        return [replace(ordered[0], files=(path,))]
    return [replace(layout, files=tuple(map(unquote, files[layout]))) for layout in ordered]


def sniff(
    spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None
) -> Layout:
    """The layout of a file, or the one that most files of a folder have."""
    layouts = sniff_all(spark, path, separator, encoding)
    if not layouts:
        raise ValueError("the file has no header")
    return layouts[0]


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding, separator, n_columns, quoted_line_breaks) of each file that has lines."""
    rows = [
        (file, x.encoding, x.separator, len(x.header), x.multi_line)
        for x in sniff_all(spark, path) for file in x.files
    ]
    return spark.createDataFrame(
        rows, "file string, encoding string, separator string, n_columns int, quoted_line_breaks boolean"
    )


def _split(line: str, separator: str) -> list[str]:
    return next(csv.reader([line], delimiter=separator))


def _from_cp1251(value: str) -> str:
    """Text that was read as latin-1, with the characters that cp1251 means."""
    high = [code for code in range(0x80, 0x100) if code != NOT_CP1251]
    wrong = "".join(map(chr, high))
    right = bytes(high).decode(CP1251)
    return f"translate({value}, {literal(wrong)}, {literal(right)})"


def _line_end(spark: SparkSession, path: str) -> str:
    """What ends the lines of a file; a carriage return alone in files of old systems."""
    first = spark.read.option("lineSep", "\n").text(path).selectExpr("CAST(value AS BINARY)").first()
    line = b"" if first is None else bytes(first[0]).rstrip(b"\r")
    return "\r" if b"\r" in line.split(quoted.QUOTE)[0] else "\n"


def read_text_table(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """All columns as text, nulls for the tokens that stand for them.

    Files with quoted line breaks are cut into records by many tasks (see ``quoted``), all
    others by Spark's reader. cp1251 is read as latin-1 and translated, because Spark
    accepts it as a charset only with a legacy setting.
    """
    paths = list(layout.files) or [path]
    names = unique_names(layout.header)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    if layout.multi_line:
        found = quoted.records(spark, paths, layout.separator, _line_end(spark, paths[0]))
        df = quoted.parsed(found, names, layout.separator, layout.encoding != UTF8)
    else:
        df = (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", True)
            .option("sep", layout.separator)
            .option("encoding", "UTF-8" if layout.encoding == UTF8 else "ISO-8859-1")
            .option("quote", '"')
            .option("escape", '"')
            .csv(paths)
        )

    def cell(name: str) -> str:
        value = ident(name)
        if layout.encoding == CP1251:
            value = _from_cp1251(value)
        return f"{text.csv_null_tokens_to_null(value)} AS {ident(name)}"

    return df.selectExpr(*map(cell, names))


def _type_name(value: str) -> str:
    """The narrowest type that all values fit; a gap turns integers into doubles."""
    number = text.strip(value)
    integers = f"CASE WHEN {number} RLIKE {INTEGER_TEXT} THEN try_cast({number} AS BIGINT) END"
    flags = f"CASE WHEN {value} IN {text.one_of(TRUE_TEXT + FALSE_TEXT)} THEN true END"
    return (
        f"CASE WHEN count({value}) = 0 THEN 'double' "
        f"WHEN count({integers}) = count(1) THEN 'bigint' "
        f"WHEN count({text_to_number(value)}) = count({value}) THEN 'double' "
        f"WHEN count({flags}) = count(1) THEN 'boolean' ELSE 'string' END"
    )


def inferred_types(df: DataFrame) -> DataFrame:
    """(column, inferred_type) of the text columns, from one scan."""
    entries = (
        f"struct({literal(item.name)} AS `column`, {_type_name(ident(item.name))} "
        "AS inferred_type)"
        for item in df.schema.fields
        if isinstance(item.dataType, T.StringType)
    )
    return df.selectExpr(f"inline(array({', '.join(entries)}))")


def infer_types(df: DataFrame) -> DataFrame:
    """Cast every text column to the type that all its values fit."""
    if not any(isinstance(item.dataType, T.StringType) for item in df.schema.fields):
        return df
    # One row per column of the schema.
    types = {row["column"]: row["inferred_type"] for row in inferred_types(df).collect()}

    def converted(name: str) -> str:
        value = ident(name)
        to = types.get(name, "string")
        if to == "bigint":
            return f"try_cast({text.strip(value)} AS BIGINT) AS {value}"
        if to == "double":
            return f"{text_to_number(value)} AS {value}"
        if to == "boolean":
            return f"{value} IN {text.one_of(TRUE_TEXT)} AS {value}"
        return value

    return df.selectExpr(*map(converted, df.columns))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return False
        raise
    return True


def load(
    spark: SparkSession,
    path: str,
    *,
    separator: str | None = None,
    encoding: str | None = None,
) -> Loaded:
    """Read a delimited file or folder; what went wrong is told by the issues."""
    if not _exists(spark, path):
        return Loaded(None, single_issue(
            spark, "file_missing", 1, "CRITICAL", f"There is no file at {path}",
            "Check the path.",
        ))
    notes = []
    suffix = os.path.splitext(path.rstrip("/"))[1]
    if suffix.lower() != ".csv":
        notes.append(single_issue(
            spark, "file_extension", 1, "WARNING", f"The file is not named .csv but {suffix!r}",
            "Make sure that it is a delimited text file.",
        ))
    df, found = None, []
    try:
        found = sniff_all(spark, path, separator, encoding)
        if not found:
            raise ValueError("the file has no header")
        tables = [read_text_table(spark, path, layout) for layout in found]
        df = infer_types(reduce(partial(DataFrame.unionByName, allowMissingColumns=True), tables))
        notes += _loaded_notes(spark, found)
    except Exception as error:
        notes.append(single_issue(
            spark, "file_unreadable", 1, "CRITICAL",
            f"The file could not be read: {error}", "Save it as UTF-8 with commas.",
        ))
    issues = notes[0]
    for note in notes[1:]:
        issues = issues.unionAll(note)
    header = list(found[0].header) if found else []
    for layout in found[1:]:
        header += [name for name in layout.header if name not in header]
    return Loaded(df, issues, tuple(header), found[0] if found else None, tuple(found))


def _loaded_notes(spark: SparkSession, found: list[Layout]) -> list[DataFrame]:
    """What was found: one line for a single layout, else one for each and a warning."""
    def said(layout: Layout) -> str:
        return f"encoding {layout.encoding} and separator {layout.separator!r}"

    if len(found) == 1:
        return [single_issue(spark, "file_loaded", 1, "INFO", f"Loaded with {said(found[0])}")]
    columns = {tuple(unique_names(layout.header)) for layout in found}
    notes = [single_issue(
        spark, "files_differ", 1, "WARNING",
        f"The files have {len(found)} layouts" + (" and not the same columns" if len(columns) > 1 else ""),
        "Columns were put together by name; save all files alike.",
    )]
    for layout in found:
        names = [os.path.basename(file) for file in layout.files]
        more = f" and {len(names) - LISTED_FILES} more" if len(names) > LISTED_FILES else ""
        notes.append(single_issue(
            spark, "file_loaded", 1, "INFO",
            f"Loaded {', '.join(names[:LISTED_FILES])}{more} with {said(layout)}", related=names[0],
        ))
    return notes


def validate_file(spark: SparkSession, path: str, **options) -> Loaded:
    """Load and validate; the issues of both steps together.

    A text file is parsed again by every pass; stage the loaded table first where
    that matters.
    """
    loaded = load(spark, path)
    if not loaded.ok:
        return loaded
    issues = loaded.issues.unionAll(validate(loaded.df, header=loaded.header, **options))
    return Loaded(loaded.df, issues, loaded.header, loaded.layout)


def write_cleaned(df: DataFrame, folder: str, source: str) -> str:
    """Write ``<name of the source>_cleaned.csv`` (a folder of parts) and return its path."""
    stem = os.path.splitext(os.path.basename(source.rstrip("/")))[0]
    path = f"{folder.rstrip('/')}/{stem}_cleaned.csv"
    (
        df.write.option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )
    return path


def preview(df: DataFrame, order_by: Sequence[str], k: int = 100) -> DataFrame:
    """The first k rows by a given order, datetimes as text; a top-k, not a full sort."""
    shown = []
    for item in df.schema.fields:
        name = value = ident(item.name)
        if isinstance(item.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = f"date_format({name}, 'yyyy-MM-dd HH:mm:ss')"
        elif isinstance(item.dataType, T.DateType):
            value = f"CAST({name} AS STRING)"
        elif isinstance(item.dataType, (T.FloatType, T.DoubleType)):
            value = f"nanvl({name}, CAST(NULL AS {item.dataType.simpleString()}))"
        shown.append(f"{value} AS {name}")
    return df.orderBy(*map(ident, order_by)).limit(k).selectExpr(*shown)


def describe(df: DataFrame) -> DataFrame:
    """(position, column, type, n_rows, n_columns), one row per column."""
    entries = (
        f"struct({position} AS position, {literal(item.name)} AS `column`, "
        f"{literal(item.dataType.simpleString())} AS type)"
        for position, item in enumerate(df.schema.fields)
    )
    return df.selectExpr("count(1) AS n_rows").selectExpr(
        f"inline(array({', '.join(entries)}))",
        "n_rows",
        f"CAST({len(df.columns)} AS BIGINT) AS n_columns",
    )

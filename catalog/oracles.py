"""The same results in plain SQL, for comparison in DuckDB.

Columns are listed here by hand, by the role their name gives them, so that the
SQL does not depend on the code it checks.
"""

from __future__ import annotations

from catalog.fixture import (
    AS_OF, COLUMNS, DATED, DIRTY_SQL, MONTHLY, SPELLED, TOKENS, TYPED, derived_sql,
)

ORACLES: dict[str, str] = {}

# Formats and placeholder words, as SQL.
FORMATS = (
    "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y", "%Y/%m/%d", "%d-%m-%Y",
    "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%Y-%m-%dT%H:%M:%S",
)
PLACEHOLDERS = (
    "('n/a', 'na', 'nan', 'null', 'none', 'nil', '-', '--', '---', 'unknown', 'missing', "
    "'empty', '', ' ', 'not available', 'undefined')"
)
NULL_TOKENS = (
    "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', "
    "'1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
)

NUMERIC = ("row_id", "customer_id", "product_id", "quantity", "price", "discount", "total_amount")
TEXT = ("order_id", "category", "payment_method", "revenue", "order_date", "unnamed_0")
IDS = ("row_id", "order_id", "customer_id", "product_id")
CATEGORIES = ("category", "payment_method")
CRITICAL = (
    "row_id", "order_id", "customer_id", "product_id", "category", "quantity", "price",
    "total_amount", "revenue", "order_date",
)
NON_NEGATIVE = ("quantity", "price", "total_amount")
NON_ZERO = ("price", "total_amount")
ORDER_ALL = ", ".join(
    f"{name} ASC NULLS FIRST"
    for name in ("row_id", "order_id", *(c for c in COLUMNS if c not in ("row_id", "order_id")))
)

TYPES = {
    "row_id": "bigint", "order_id": "string", "customer_id": "bigint", "product_id": "bigint",
    "category": "string", "payment_method": "string", "quantity": "double", "price": "double",
    "discount": "double", "total_amount": "double", "revenue": "string", "order_date": "string",
    "unnamed_0": "string",
}


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def normal(c: str) -> str:
    return f"lower({strip(c)})"


def number(c: str) -> str:
    pattern = r"[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf(inity)?)"
    return (
        f"CASE WHEN regexp_full_match({strip(c)}, '{pattern}', 'i') "
        f"THEN TRY_CAST({strip(c)} AS DOUBLE) END"
    )


def currency(c: str) -> str:
    return number(rf"regexp_replace({c}, '[%,$€£\s]', '', 'g')")


def parsed(c: str, fmt: str) -> str:
    return f"try_strptime({c}, '{fmt}')"


def anyhow(c: str) -> str:
    return f"coalesce({', '.join(parsed(c, fmt) for fmt in FORMATS)})"


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def dirty(name: str, select: str) -> None:
    ORACLES[name] = f"WITH dirty_sales AS ({DIRTY_SQL}) {select}"


def per_column(columns, template: str, where: str = "") -> str:
    """The template once per column, {c} being its name."""
    body = union(f"SELECT '{c}' AS \"column\", {template.format(c=c)} FROM t" for c in columns)
    return f"SELECT * FROM ({body}) {where}"


def dirty_columns(name: str, columns, template: str, where: str = "") -> None:
    dirty(name, per_column(columns, template, where).replace("FROM t)", "FROM dirty_sales)")
          .replace("FROM t ", "FROM dirty_sales "))


COUNT_IF = "CAST(count(*) FILTER (WHERE {}) AS BIGINT)"


def count_if(condition: str) -> str:
    return COUNT_IF.format(condition)


# Scans, sources, sinks

dirty("describe_shape", "SELECT v.*, (SELECT count(*) FROM dirty_sales) AS n_rows, "
      "CAST(13 AS BIGINT) AS n_columns FROM ("
      + union(
          f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{t}' AS type"
          for i, (c, t) in enumerate(TYPES.items())
      ) + ") v")
dirty("preview_100", "SELECT * FROM dirty_sales ORDER BY "
      + ", ".join(f"{c} ASC NULLS FIRST" for c in COLUMNS) + " LIMIT 100")
ORACLES["null_tokens_on_load"] = (
    f"SELECT o_orderkey, CASE WHEN raw NOT IN {NULL_TOKENS} THEN raw END AS cleaned "
    f"FROM ({derived_sql(TOKENS)})"
)
ORACLES["infer_types"] = f"WITH t AS ({derived_sql(TYPED)}) " + union(
    f"SELECT '{c}' AS \"column\", CASE WHEN count({c}) = 0 THEN 'double' "
    f"WHEN count(*) = count(*) FILTER (WHERE regexp_full_match({c}, '[+-]?\\d+')) THEN 'bigint' "
    f"WHEN count({c}) = count({number(c)}) THEN 'double' "
    f"WHEN count(*) = count(*) FILTER (WHERE lower({c}) IN ('true', 'false')) THEN 'boolean' "
    "ELSE 'string' END AS inferred_type FROM t"
    for c in TYPED
)

# Scalars

dirty("to_number", f"SELECT row_id, {number('order_id')} AS number FROM dirty_sales")
dirty("clean_currency", f"SELECT row_id, {currency('revenue')} AS amount FROM dirty_sales")
dirty("strip_lower", f"SELECT row_id, {normal('category')} AS normal FROM dirty_sales")
ORACLES["title_case"] = (
    "SELECT o_orderkey, array_to_string(list_transform(regexp_extract_all("
    r"lower(o_orderpriority), '([a-z]+|[^a-z]+)'), lambda s: upper(s[1:1]) || s[2:]), '') "
    "AS title FROM orders"
)
dirty("pseudo_null_flag",
      f"SELECT row_id, {normal('category')} IN {PLACEHOLDERS} AS is_placeholder FROM dirty_sales")

# Structure

ORACLES["few_rows"] = (
    "SELECT * FROM (SELECT 'region' AS source, count(*) AS n_rows, 'WARNING' AS severity "
    "FROM region UNION ALL SELECT 'orders_by_status', count(DISTINCT o_orderstatus), 'WARNING' "
    "FROM orders) WHERE n_rows BETWEEN 1 AND 4"
)
dirty_columns("empty_columns", COLUMNS, "count(*) AS n_rows, count({c}) AS n",)
dirty("empty_columns", "SELECT \"column\", n_rows FROM (" + union(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n FROM dirty_sales"
    for c in COLUMNS) + ") WHERE n = 0")

# Types

_DATED = f"WITH t AS ({derived_sql(DATED)}), ratios AS (" + union(
    f"SELECT '{c}' AS \"column\", '{fmt}' AS date_format, {place} AS place, "
    f"count({anyhow(c) if fmt == 'auto-inferred' else parsed(c, fmt)}) AS n_parsed, "
    f"count({c}) AS n FROM t"
    for c in ("order_date", "slash_date", "stamp_time")
    for place, fmt in enumerate((*FORMATS, "auto-inferred"))
) + ") "
ORACLES["date_format_ratios"] = (
    _DATED + 'SELECT "column", date_format, n_parsed, round(n_parsed / n, 6) AS ratio FROM ratios'
)
ORACLES["best_date_format"] = (
    _DATED + 'SELECT "column", arg_max(date_format, n_parsed * 100 - place) AS date_format, '
    'max(n_parsed) AS n_parsed FROM ratios GROUP BY "column"'
)
dirty("text_dates",
      "SELECT 'order_date' AS \"column\", CASE WHEN n / t > 0.7 THEN 'WARNING' ELSE 'CRITICAL' "
      "END AS severity, '%Y-%m-%d' AS date_format, round(n / t, 6) AS ratio FROM (SELECT "
      f"count({parsed('order_date', '%Y-%m-%d')}) AS n, count(order_date) AS t FROM dirty_sales)")
dirty("text_numbers",
      "SELECT 'revenue' AS \"column\", 'WARNING' AS severity, n AS n_clean, "
      f"round(n / t, 6) AS ratio FROM (SELECT count({currency('revenue')}) AS n, "
      "count(revenue) AS t FROM dirty_sales) WHERE n / t > 0.7")
_MIXED = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({number(c)}) AS n_numeric, count({c}) AS t "
    "FROM dirty_sales" for c in TEXT
)
dirty("mixed_types",
      "SELECT \"column\", 'WARNING' AS severity, n_numeric, round(n_numeric / t, 6) AS ratio "
      f"FROM ({_MIXED}) WHERE n_numeric / t > 0.1 AND n_numeric / t < 0.9")

# Missing values

dirty("null_counts", union(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, "
    f"{'true' if c in CRITICAL else 'false'} AS is_critical FROM dirty_sales" for c in COLUMNS))
_NULLS = union(
    f"SELECT '{c}' AS \"column\", count(*) AS t, count(*) - count({c}) AS n_null, "
    f"{'true' if c in CRITICAL else 'false'} AS critical FROM dirty_sales" for c in COLUMNS
)
dirty("null_severity",
      "SELECT \"column\", CASE WHEN critical AND n_null / t > 0.3 THEN 'CRITICAL' ELSE 'WARNING' "
      f"END AS severity, n_null FROM ({_NULLS}) WHERE n_null > 0")
_PROPOSED = []
for _c in COLUMNS:
    _gap = f"(SELECT count(*) > count({_c}) FROM dirty_sales)"
    _labels = []
    if _c in NUMERIC:
        _labels += [
            ("fill_mean", f"printf('Fill ''{_c}'' with the mean (%.2f)', avg({_c}))"),
            ("fill_median",
             f"printf('Fill ''{_c}'' with the median (%.2f)', quantile_cont({_c}, 0.5))"),
            ("fill_zero", f"'Fill ''{_c}'' with 0'"),
        ]
    if _c in TEXT:
        _labels += [
            ("fill_mode", f"'Fill ''{_c}'' with its most frequent value'"),
            ("fill_unknown", f"'Fill ''{_c}'' with Unknown'"),
        ]
    _labels.append(("drop_null_rows", f"'Drop the rows without ''{_c}'''"))
    _PROPOSED += [
        f"SELECT '{_c}' AS \"column\", '{fix_id}' AS fix_id, {label} AS label, "
        f"count(*) > count({_c}) AS gap FROM dirty_sales"
        for fix_id, label in _labels
    ]
dirty("fix_proposals", f"SELECT \"column\", fix_id, label FROM ({union(_PROPOSED)}) WHERE gap")
dirty("mostly_empty_rows",
      "SELECT n_rows, n_mostly_empty, 'WARNING' AS severity FROM (SELECT count(*) AS n_rows, "
      + count_if(
          "(CASE WHEN order_id IS NULL THEN 1 ELSE 0 END + CASE WHEN quantity IS NULL THEN 1 "
          "ELSE 0 END + CASE WHEN price IS NULL THEN 1 ELSE 0 END + CASE WHEN unnamed_0 IS NULL "
          "THEN 1 ELSE 0 END) / 4 > 0.5"
      ) + " AS n_mostly_empty FROM dirty_sales) WHERE n_mostly_empty > 0")
dirty("pseudo_null_counts", union(
    f"SELECT '{c}' AS \"column\", {count_if(f'{normal(c)} IN {PLACEHOLDERS}')} AS n_pseudo "
    "FROM dirty_sales" for c in TEXT))

# Duplicates

dirty("full_duplicates",
      "SELECT (SELECT count(*) FROM dirty_sales) - (SELECT count(*) FROM "
      "(SELECT DISTINCT * FROM dirty_sales)) AS n_duplicates")
_ID_COUNTS = union(
    f"SELECT '{c}' AS \"column\", count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct, "
    f"{'true' if c == 'order_id' else 'false'} AS sale FROM dirty_sales" for c in IDS
)
dirty("id_duplicates",
      "SELECT \"column\", CASE WHEN n_values = n_distinct THEN 'OK' WHEN sale THEN 'CRITICAL' "
      "ELSE 'WARNING' END AS severity, n_values, n_values - n_distinct AS n_duplicates "
      f"FROM ({_ID_COUNTS})")
_SOFT_KEY = "customer_id, product_id, order_date, price"
dirty("soft_key_duplicates",
      "SELECT (SELECT count(*) FROM dirty_sales) - (SELECT count(*) FROM "
      f"(SELECT DISTINCT {_SOFT_KEY} FROM dirty_sales)) AS n_duplicates")

# Numbers

dirty("negative_values", "SELECT * FROM (" + union(
    f"SELECT '{c}' AS \"column\", 'CRITICAL' AS severity, {count_if(f'{c} < 0')} AS n_negative, "
    f"min({c}) AS min_value FROM dirty_sales" for c in NON_NEGATIVE) + ") WHERE n_negative > 0")
dirty("zero_values", "SELECT * FROM (" + union(
    f"SELECT '{c}' AS \"column\", 'WARNING' AS severity, {count_if(f'{c} = 0')} AS n_zero "
    "FROM dirty_sales" for c in NON_ZERO) + ") WHERE n_zero > 0")
dirty("percent_out_of_range",
      "SELECT 'discount' AS \"column\", 'WARNING' AS severity, "
      + count_if("discount < 0 OR discount > 100")
      + " AS n_out_of_range FROM dirty_sales HAVING n_out_of_range > 0")


def outliers(table: str, columns) -> str:
    return union(
        f"SELECT '{c}' AS \"column\", {count_if(f'{c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)')} "
        f"AS n_outliers, CAST(min({c}) AS DOUBLE) AS min_value, "
        f"CAST(max({c}) AS DOUBLE) AS max_value, any_value(q1) AS q1, any_value(median) AS median, "
        f"any_value(q3) AS q3, count({c}) AS n FROM {table}, "
        f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, "
        f"quantile_cont({c}, 0.75) AS q3 FROM {table}) WHERE q3 > q1"
        for c in columns
    )


dirty("iqr_outliers",
      "SELECT \"column\", 'WARNING' AS severity, n_outliers, min_value, max_value, "
      "round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3 FROM ("
      + outliers("dirty_sales", NUMERIC) + ") WHERE n_outliers / n > 0.01")


def mismatch(table: str) -> str:
    return (
        f"SELECT {count_if('abs(total_amount - e) / (abs(e) + 1e-9) > 0.05')} AS n_mismatch "
        "FROM (SELECT total_amount, quantity * price * (1 - discount / CASE WHEN max(discount) "
        f"OVER () > 1 THEN 100 ELSE 1 END) AS e FROM {table} WHERE quantity IS NOT NULL AND price "
        "IS NOT NULL AND total_amount IS NOT NULL AND discount IS NOT NULL)"
    )


dirty("total_mismatch", mismatch("dirty_sales"))

# Categories


def categories(table: str, columns) -> str:
    return union(
        f"SELECT '{c}' AS \"column\", count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct, "
        f"count(DISTINCT {normal(c)}) AS n_normalised, "
        f"{count_if(f'{normal(c)} IN {PLACEHOLDERS}')} AS n_placeholder FROM {table}"
        for c in columns
    )


_CATEGORIES = categories("dirty_sales", CATEGORIES)
dirty("category_columns",
      "SELECT \"column\", n_values, n_distinct FROM (" + categories("dirty_sales", TEXT) + ") "
      "WHERE \"column\" IN ('category', 'payment_method') OR (n_distinct <= 50 AND n_values > 0 "
      "AND n_distinct / n_values < 0.1)")
dirty("case_variants",
      "SELECT \"column\", 'WARNING' AS severity, n_distinct, n_normalised FROM "
      f"({_CATEGORIES}) WHERE n_normalised < n_distinct")
dirty("category_placeholders",
      "SELECT \"column\", 'WARNING' AS severity, n_placeholder FROM "
      f"({_CATEGORIES}) WHERE n_placeholder > 0")
ORACLES["high_cardinality"] = (
    "SELECT 'segment' AS \"column\", 'WARNING' AS severity, "
    "count(DISTINCT CAST(o_custkey AS STRING)) AS n_distinct FROM orders HAVING n_distinct > 100"
)
dirty("category_values", "SELECT * FROM (" + union(
    f"SELECT '{c}' AS \"column\", 'INFO' AS severity, count(*) AS n_distinct, "
    f"string_agg({c}, '|' ORDER BY {c}) FILTER (WHERE place <= 20) AS listed FROM "
    f"(SELECT {c}, row_number() OVER (ORDER BY {c}) AS place FROM "
    f"(SELECT DISTINCT {c} FROM dirty_sales WHERE {c} IS NOT NULL))" for c in CATEGORIES)
      + ") WHERE n_distinct <= 30")

# Dates

_DATES = f"SELECT {parsed('order_date', '%Y-%m-%d')} AS moment, order_date FROM dirty_sales"
dirty("date_parse_ratio",
      "SELECT 'order_date' AS \"column\", count(order_date) AS n_values, count(moment) AS n_parsed, "
      f"count(moment) / count(order_date) < 0.8 AS too_few FROM ({_DATES})")
dirty("unparsed_dates",
      "SELECT 'order_date' AS \"column\", 'WARNING' AS severity, "
      f"count(order_date) - count(moment) AS n_unparsed FROM ({_DATES}) HAVING n_unparsed > 0")
dirty("future_dates",
      "SELECT 'order_date' AS \"column\", 'WARNING' AS severity, "
      + count_if(f"moment > TIMESTAMP '{AS_OF}'") + f" AS n_future FROM ({_DATES}) HAVING n_future > 0")
dirty("old_dates",
      "SELECT 'order_date' AS \"column\", 'WARNING' AS severity, "
      + count_if("moment < TIMESTAMP '1990-01-01'") + f" AS n_old FROM ({_DATES}) HAVING n_old > 0")
dirty("date_range",
      "SELECT 'order_date' AS \"column\", 'INFO' AS severity, "
      "strftime(min(moment), '%Y-%m-%d') AS first_date, strftime(max(moment), '%Y-%m-%d') AS last_date, "
      f"datediff('day', min(moment), max(moment)) AS n_days FROM ({_DATES})")
ORACLES["ambiguous_dates"] = (
    f"SELECT 'slash_date' AS \"column\", count(*) AS n_ambiguous FROM ({derived_sql(DATED)}) "
    r"WHERE regexp_full_match(slash_date, '\d{2}/\d{2}/\d{4}')"
)
ORACLES["date_density"] = (
    "SELECT 'month_date' AS \"column\", 'WARNING' AS severity, count(DISTINCT month_date) AS n_days, "
    "datediff('day', min(month_date), max(month_date)) + 1 AS n_possible "
    f"FROM ({derived_sql(MONTHLY)})"
)

# Keys

dirty("null_ids", "SELECT * FROM (" + union(
    f"SELECT '{c}' AS \"column\", 'WARNING' AS severity, count(*) - count({c}) AS n_null "
    "FROM dirty_sales" for c in IDS) + ") WHERE n_null > 0")
dirty("mixed_id_types",
      "SELECT \"column\", 'WARNING' AS severity, n_numeric, round(n_numeric / t, 6) AS ratio "
      f"FROM (SELECT 'order_id' AS \"column\", count({number('order_id')}) AS n_numeric, "
      "count(order_id) AS t FROM dirty_sales) WHERE n_numeric / t > 0.05 AND n_numeric / t < 0.95")
_LENGTHS = union(
    f"SELECT '{c}' AS \"column\", length(CAST({c} AS STRING)) AS length, count(*) AS n "
    f"FROM dirty_sales WHERE {c} IS NOT NULL GROUP BY ALL" for c in IDS
)
dirty("id_length_histogram", f"SELECT * FROM ({_LENGTHS})")
dirty("id_lengths",
      "SELECT \"column\", 'WARNING' AS severity, any_value(n_lengths) AS n_lengths, "
      "string_agg(length || ':' || n, '|' ORDER BY n DESC, length) AS top_lengths FROM "
      "(SELECT *, count(*) OVER (PARTITION BY \"column\") AS n_lengths, row_number() OVER "
      f"(PARTITION BY \"column\" ORDER BY n DESC, length) AS place FROM ({_LENGTHS})) "
      "WHERE place <= 5 AND n_lengths > 3 GROUP BY \"column\"")


def links(table: str, pairs) -> str:
    return union(
        f"SELECT '{key}' AS \"column\", '{cat}' AS category, {count_if('n > 1')} AS n_keys FROM "
        f"(SELECT count(DISTINCT {cat}) AS n FROM {table} WHERE {key} IS NOT NULL GROUP BY {key})"
        for key, cat in pairs
    )


PAIRS = tuple((key, cat) for key in IDS for cat in CATEGORIES)
dirty("id_maps_to_many_categories",
      f"SELECT *, 'WARNING' AS severity FROM ({links('dirty_sales', PAIRS)}) WHERE n_keys > 0")

# Business logic


def ignored_discount(table: str) -> str:
    return (
        f"SELECT {count_if('discount > 0 AND total_amount > price')} AS n_discount_ignored "
        f"FROM {table}"
    )


dirty("discount_not_applied", ignored_discount("dirty_sales"))
dirty("product_multi_category", links("dirty_sales", [("product_id", "category")]))
dirty("suspicious_payment",
      f"SELECT DISTINCT 'payment_method' AS \"column\", {normal('payment_method')} AS value "
      f"FROM dirty_sales WHERE {normal('payment_method')} IN {PLACEHOLDERS} "
      f"OR length({normal('payment_method')}) > 50")

# Fixes


def replacing(name: str, expression: str, where: str = "") -> None:
    dirty(f"fix_{name}", f"SELECT * REPLACE ({expression}) FROM dirty_sales {where}")


replacing("fill_mean", "coalesce(price, (SELECT round(avg(price), 4) FROM dirty_sales)) AS price")
replacing("fill_median",
          "coalesce(price, (SELECT round(quantile_cont(price, 0.5), 4) FROM dirty_sales)) AS price")
replacing("fill_mode",
          "coalesce(order_id, (SELECT order_id FROM dirty_sales WHERE order_id IS NOT NULL "
          "GROUP BY order_id ORDER BY count(*) DESC, order_id LIMIT 1)) AS order_id")
replacing("fill_zero", "coalesce(quantity, 0.0E0) AS quantity")
replacing("fill_unknown", "coalesce(order_id, 'Unknown') AS order_id")
dirty("fix_drop_null_rows", "SELECT * FROM dirty_sales WHERE price IS NOT NULL")
dirty("fix_drop_full_duplicates", "SELECT DISTINCT * FROM dirty_sales")
dirty("fix_drop_col_duplicates",
      "SELECT * FROM dirty_sales QUALIFY row_number() OVER (PARTITION BY order_id "
      f"ORDER BY {ORDER_ALL}) = 1")
replacing("cast_to_numeric", f"{currency('revenue')} AS revenue")
replacing("cast_to_datetime", f"{parsed('order_date', '%Y-%m-%d')} AS order_date")
replacing("cast_to_string", "CAST(customer_id AS STRING) AS customer_id")
replacing("strip_lowercase", f"{normal('category')} AS category")
replacing("strip_titlecase",
          f"CASE {normal('category')} WHEN 'toys' THEN 'Toys' WHEN 'books' THEN 'Books' "
          "WHEN 'garden' THEN 'Garden' WHEN 'n/a' THEN 'N/A' END AS category")
replacing("replace_pseudo_nulls",
          f"CASE WHEN {normal('category')} NOT IN {PLACEHOLDERS} THEN category END AS category")
dirty("fix_drop_negative_rows",
      "SELECT * FROM dirty_sales WHERE quantity IS NULL OR quantity >= 0")
replacing("abs_negative", "abs(quantity) AS quantity")


def capped(table: str) -> str:
    return (
        "CASE WHEN price IS NOT NULL THEN least(greatest(price, (SELECT quantile_cont(price, 0.25) "
        f"- 3 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) FROM {table})), "
        "(SELECT quantile_cont(price, 0.75) + 3 * (quantile_cont(price, 0.75) - "
        f"quantile_cont(price, 0.25)) FROM {table})) END"
    )


replacing("cap_outliers_iqr", f"{capped('dirty_sales')} AS price")
dirty("fix_drop_zero_rows", "SELECT * FROM dirty_sales WHERE price IS NULL OR price <> 0")
replacing("percent_divide_100", "discount / 100 AS discount")
dirty("fix_drop_column", "SELECT * EXCLUDE (unnamed_0) FROM dirty_sales")
dirty("fix_drop_empty_columns", "SELECT * EXCLUDE (unnamed_0) FROM dirty_sales")
dirty("fix_drop_duplicate_columns", "SELECT * FROM dirty_sales")
dirty("fix_drop_future_dates",
      f"SELECT * FROM dirty_sales WHERE {parsed('order_date', '%Y-%m-%d')} IS NULL "
      f"OR {parsed('order_date', '%Y-%m-%d')} <= TIMESTAMP '{AS_OF}'")


def audited(fix_id: str, column: str | None, dropped="0", changed="0", columns="0") -> str:
    name = "CAST(NULL AS STRING)" if column is None else f"'{column}'"
    return (
        f"SELECT '{fix_id}' AS fix_id, {name} AS \"column\", n AS rows_before, "
        f"CAST(n - d AS BIGINT) AS rows_after, CAST(d AS BIGINT) AS rows_dropped, "
        f"CAST(c AS BIGINT) AS values_changed, CAST({columns} AS INTEGER) AS columns_dropped FROM "
        f"(SELECT count(*) AS n, {dropped} AS d, {changed} AS c FROM dirty_sales)"
    )


dirty("fix_audit", union((
    audited("fill_mean", "price", changed=count_if("price IS NULL")),
    audited("fill_mode", "order_id", changed=count_if("order_id IS NULL")),
    audited("drop_null_rows", "price", dropped=count_if("price IS NULL")),
    audited("drop_full_duplicates", None,
            dropped="count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_sales))"),
    audited("drop_col_duplicates", "order_id",
            dropped="count(*) - count(DISTINCT order_id) - 1"),
    audited("replace_pseudo_nulls", "category",
            changed=count_if(f"{normal('category')} IN {PLACEHOLDERS}")),
    audited("drop_negative_rows", "quantity", dropped=count_if("quantity < 0")),
    audited("cap_outliers_iqr", "price", changed=count_if("price <> " + capped("dirty_sales"))),
    audited("drop_zero_rows", "price", dropped=count_if("price = 0")),
    audited("drop_future_dates", "order_date",
            dropped=count_if(f"{parsed('order_date', '%Y-%m-%d')} > TIMESTAMP '{AS_OF}'")),
    audited("drop_empty_columns", None, columns="1"),
)))

# Reports

SECTIONS = {
    1: "1. Dataset Structure", 2: "2. Data Types", 3: "3. Missing Values", 4: "4. Duplicates",
    5: "5. Numeric Values", 6: "6. Categorical Data", 7: "7. Dates & Time Range",
    8: "8. Keys & Identifiers", 9: "9. Business Logic",
}


def issue(section: int, check: str, severity: str, value: str, source: str, column: str = "NULL",
          when: str = "true") -> str:
    return (
        f"SELECT '{SECTIONS[section]}' AS section, '{check}' AS \"check\", "
        f"CAST({column} AS STRING) AS \"column\", {severity} AS severity, "
        f"round(CAST({value} AS DOUBLE), 6) AS value FROM ({source}) WHERE {when}"
    )


def report_sql(table: str, columns, numeric, text, ids, dates, categories_, dates_as_text,
               critical, non_negative, non_zero, percent, money_text, sale_ids,
               soft_key=None, total_rule=True, payment=None) -> str:
    """Every finding on a table whose columns have the given roles, and the closing OKs."""
    of_columns = union(
        f"SELECT '{c}' AS c, {'true' if c in critical else 'false'} AS critical, "
        f"count(*) AS t, count({c}) AS n FROM {table}" for c in columns
    )
    named = '"column"'
    parts = [
        issue(1, "shape", "'INFO'", "n", f"SELECT count(*) AS n FROM {table}"),
        issue(1, "empty_columns", "'WARNING'", "n",
              f"SELECT count(*) AS n FROM ({of_columns}) WHERE n = 0", when="n > 0"),
        issue(1, "technical_columns", "'WARNING'", "n",
              f"SELECT {sum(c.startswith('unnamed') for c in columns)} AS n", when="n > 0"),
        issue(2, "column_types", "'INFO'", "n", f"SELECT {len(columns)} AS n"),
        issue(3, "null_summary", "'WARNING'", "n",
              f"SELECT count(*) AS n FROM ({of_columns}) WHERE n < t", when="n > 0"),
        issue(3, "null_severity",
              "CASE WHEN critical AND (t - n) / t > 0.3 THEN 'CRITICAL' ELSE 'WARNING' END",
              "t - n", of_columns, "c", "n < t"),
        issue(3, "mostly_empty_rows", "'WARNING'", "n",
              "SELECT " + count_if(
                  " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in columns)
                  + f" > {len(columns) / 2}") + f" AS n FROM {table}", when="n > 0"),
        issue(4, "full_duplicates", "CASE WHEN n > 0 THEN 'CRITICAL' ELSE 'OK' END", "n",
              f"SELECT (SELECT count(*) FROM {table}) - (SELECT count(*) FROM "
              f"(SELECT DISTINCT * FROM {table})) AS n"),
    ]
    if text:
        pseudo = union(
            f"SELECT '{c}' AS c, {count_if(f'{normal(c)} IN {PLACEHOLDERS}')} AS n, "
            f"count({c}) AS t, count({number(c)}) AS n_numeric FROM {table}" for c in text
        )
        parts += [
            issue(3, "pseudo_nulls", "'WARNING'", "n",
                  f"SELECT count(*) AS n FROM ({pseudo}) WHERE n > 0", when="n > 0"),
            issue(2, "mixed_types", "'WARNING'", "n_numeric / t", pseudo, "c",
                  "n_numeric / t > 0.1 AND n_numeric / t < 0.9"),
        ]
        text_ids = [c for c in text if c in ids]
        if text_ids:
            parts.append(issue(
                8, "mixed_id_types", "'WARNING'", "n_numeric / t",
                f"SELECT * FROM ({pseudo}) WHERE c IN ({', '.join(repr(c) for c in text_ids)})",
                "c", "n_numeric / t > 0.05 AND n_numeric / t < 0.95"))
    if money_text:
        parts.append(issue(
            2, "text_numbers", "'WARNING'", "n / t",
            union(f"SELECT '{c}' AS c, count({currency(c)}) AS n, count({c}) AS t FROM {table}"
                  for c in money_text), "c", "n / t > 0.7"))
    counts = union(
        f"SELECT '{c}' AS c, {'true' if c in sale_ids else 'false'} AS sale, count(*) AS total, "
        f"count({c}) AS n, count(DISTINCT {c}) AS d FROM {table}" for c in ids
    )
    lengths = union(
        f"SELECT '{c}' AS c, count(DISTINCT length(CAST({c} AS STRING))) AS n FROM {table}"
        for c in ids
    )
    parts += [
        issue(4, "id_duplicates",
              "CASE WHEN n = d THEN 'OK' WHEN sale THEN 'CRITICAL' ELSE 'WARNING' END", "n - d",
              counts, "c"),
        issue(8, "null_ids", "'WARNING'", "total - n", counts, "c", "n > 0 AND n < total"),
        issue(8, "id_lengths", "'WARNING'", "n", lengths, "c", "n > 3"),
    ]
    pairs = [(key, cat) for key in ids for cat in [c for c in categories_ if c != key][:2]]
    if pairs:
        parts.append(issue(8, "id_maps_to_many_categories", "'WARNING'", "n_keys",
                           links(table, pairs), named, "n_keys > 0"))
    if soft_key:
        parts.append(issue(
            4, "soft_key_duplicates", "'WARNING'", "n",
            f"SELECT (SELECT count(*) FROM {table}) - (SELECT count(*) FROM "
            f"(SELECT DISTINCT {soft_key} FROM {table})) AS n", when="n > 0"))
    for check, names, condition, severity in (
        ("negative_values", non_negative, "{c} < 0", "CRITICAL"),
        ("zero_values", non_zero, "{c} = 0", "WARNING"),
        ("percent_out_of_range", percent, "{c} < 0 OR {c} > 100", "WARNING"),
    ):
        parts.append(issue(
            5, check, f"'{severity}'", "n",
            union(f"SELECT '{c}' AS c, {count_if(condition.format(c=c))} AS n FROM {table}"
                  for c in names), "c", "n > 0"))
    parts.append(issue(5, "iqr_outliers", "'WARNING'", "n_outliers", outliers(table, numeric),
                       named, "n_outliers / n > 0.01"))
    if total_rule:
        parts += [
            issue(5, "total_mismatch", "'WARNING'", "n_mismatch", mismatch(table),
                  when="n_mismatch > 0"),
            issue(9, "discount_not_applied", "'WARNING'", "n_discount_ignored",
                  ignored_discount(table), when="n_discount_ignored > 0"),
            issue(9, "product_multi_category", "'CRITICAL'", "n_keys",
                  links(table, [("product_id", "category")]), when="n_keys > 0"),
        ]
    if payment:
        parts.append(issue(
            9, "suspicious_payment", "'WARNING'", "n",
            f"SELECT count(DISTINCT {normal(payment)}) AS n FROM {table} WHERE "
            f"{normal(payment)} IN {PLACEHOLDERS} OR length({normal(payment)}) > 50",
            when="n > 0"))
    cats = categories(table, categories_)
    parts += [
        issue(6, "case_variants", "'WARNING'", "n_distinct - n_normalised", cats, named,
              "n_normalised < n_distinct"),
        issue(6, "category_placeholders", "'WARNING'", "n_placeholder", cats, named,
              "n_placeholder > 0"),
        issue(6, "high_cardinality", "'WARNING'", "n_distinct", cats, named, "n_distinct > 100"),
        issue(6, "category_values", "'INFO'", "n_distinct", cats, named, "n_distinct <= 30"),
    ]
    for c in dates:
        at = parsed(c, "%Y-%m-%d") if dates_as_text else c
        summary = (
            f"SELECT count({c}) AS t, count({at}) AS n, count(DISTINCT CAST({at} AS DATE)) AS days, "
            f"datediff('day', min({at}), max({at})) AS span, "
            + count_if(f"{at} > TIMESTAMP '{AS_OF}'") + " AS future, "
            + count_if(f"{at} < TIMESTAMP '1990-01-01'") + f" AS old FROM {table}"
        )
        if dates_as_text:
            parts += [
                issue(2, "text_dates",
                      "CASE WHEN n / t > 0.7 THEN 'WARNING' ELSE 'CRITICAL' END", "n / t", summary,
                      f"'{c}'"),
                issue(7, "date_parse_ratio", "'CRITICAL'", "n / t", summary, f"'{c}'",
                      "n / t < 0.8"),
                issue(7, "unparsed_dates", "'WARNING'", "t - n", summary, f"'{c}'",
                      "n / t >= 0.8 AND n < t"),
            ]
        ok = "n / t >= 0.8 AND " if dates_as_text else ""
        parts += [
            issue(7, "date_range", "'INFO'", "span", summary, f"'{c}'", f"{ok}n > 0"),
            issue(7, "future_dates", "'WARNING'", "future", summary, f"'{c}'", f"{ok}future > 0"),
            issue(7, "old_dates", "'WARNING'", "old", summary, f"'{c}'", f"{ok}old > 0"),
            issue(7, "date_density", "'WARNING'", "days", summary, f"'{c}'",
                  f"{ok}n > 30 AND days / (span + 1) < 0.5"),
        ]
    neutral = (
        "('shape', 'few_rows', 'column_types', 'mostly_empty_rows', 'category_values', 'date_range')"
    )
    sections = union(f"SELECT {n} AS no, '{name}' AS section"
                     for n, name in SECTIONS.items() if n != 4)
    return (
        f"findings AS ({union(parts)}), issues AS (SELECT * FROM findings UNION ALL "
        "SELECT section, 'section_ok', NULL, 'OK', 0.0E0 FROM (" + sections + ") s WHERE section "
        "NOT IN (SELECT section FROM findings WHERE severity IN ('CRITICAL', 'WARNING') "
        f"AND \"check\" NOT IN {neutral}))"
    )


DIRTY_REPORT = report_sql(
    "dirty_sales", COLUMNS, NUMERIC, TEXT, IDS, ("order_date",), CATEGORIES, True, CRITICAL,
    NON_NEGATIVE, NON_ZERO, ("discount",), ("revenue",), ("order_id",), _SOFT_KEY,
    payment="payment_method",
)


def reported(name: str, select: str) -> None:
    ORACLES[name] = f"WITH dirty_sales AS ({DIRTY_SQL}), {DIRTY_REPORT} {select}"


reported("validate_report", "SELECT * FROM issues")
reported("report_ordered", "SELECT * FROM issues")
reported("report_filtered", "SELECT * FROM issues WHERE severity = 'CRITICAL'")
reported("severity_summary",
         "SELECT s.severity, count(i.severity) AS n_issues FROM (SELECT 'CRITICAL' AS severity "
         "UNION ALL SELECT 'WARNING' UNION ALL SELECT 'INFO' UNION ALL SELECT 'OK') s "
         "LEFT JOIN issues i ON i.severity = s.severity GROUP BY s.severity")
reported("section_status",
         "SELECT section, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' "
         "WHEN bool_or(severity = 'WARNING') THEN 'WARNING' WHEN bool_or(severity = 'INFO') "
         "THEN 'INFO' ELSE 'OK' END AS status FROM issues GROUP BY section")
reported("overall_status",
         "SELECT CASE WHEN n_critical > 0 THEN 'critical' WHEN n_warning > 0 THEN 'warning' "
         "ELSE 'ok' END AS status, * FROM (SELECT " + count_if("severity = 'CRITICAL'")
         + " AS n_critical, " + count_if("severity = 'WARNING'") + " AS n_warning FROM issues)")

ORACLES["validate_lineitem"] = "WITH " + report_sql(
    "lineitem",
    ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
     "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
     "l_discount", "l_tax"),
    ("l_returnflag", "l_linestatus"),
    ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
    ("l_shipdate",), ("l_returnflag", "l_linestatus"), False,
    ("l_orderkey", "l_quantity", "l_extendedprice", "l_shipdate"),
    ("l_quantity", "l_extendedprice"), ("l_extendedprice",), ("l_discount",), (),
    ("l_orderkey",), total_rule=False,
) + " SELECT * FROM issues"

_ON = tuple(c for c in COLUMNS if c != "unnamed_0")
_CLEAN = (
    "first AS (SELECT DISTINCT * FROM dirty_sales), second AS (SELECT * REPLACE ("
    f"CASE WHEN {normal('category')} NOT IN {PLACEHOLDERS} THEN {normal('category')} END AS "
    f"category, {currency('revenue')} AS revenue, {parsed('order_date', '%Y-%m-%d')} AS "
    "order_date) FROM first), third AS (SELECT * FROM second WHERE (order_date IS NULL OR "
    f"order_date <= TIMESTAMP '{AS_OF}') AND (quantity IS NULL OR quantity >= 0)), "
    f"fourth AS (SELECT * REPLACE ({capped('third')} AS price) FROM third), "
    "cleaned AS (SELECT * EXCLUDE (unnamed_0) REPLACE (coalesce(price, (SELECT "
    "round(quantile_cont(price, 0.5), 4) FROM fourth)) AS price) FROM fourth)"
)
ORACLES["clean_then_validate"] = (
    f"WITH dirty_sales AS ({DIRTY_SQL}), {_CLEAN}, " + report_sql(
        "cleaned", _ON, (*NUMERIC, "revenue"), ("order_id", "category", "payment_method"), IDS,
        ("order_date",), CATEGORIES, False, CRITICAL, (*NON_NEGATIVE, "revenue"), NON_ZERO,
        ("discount",), (), ("order_id",), _SOFT_KEY, payment="payment_method",
    ) + " SELECT * FROM issues"
)

_OUTCOMES = (  # fix, column, rows before and after, values changed, columns dropped
    ("drop_full_duplicates", None, "r0", "r1", "0", "0"),
    ("replace_pseudo_nulls", "category", "r1", "r1",
     f"(SELECT count(*) FROM first WHERE {normal('category')} IN {PLACEHOLDERS})", "0"),
    ("strip_lowercase", "category", "r1", "r1",
     f"(SELECT count(*) FROM first WHERE {normal('category')} NOT IN {PLACEHOLDERS} "
     f"AND category <> {normal('category')})", "0"),
    ("cast_to_numeric", "revenue", "r1", "r1", "(SELECT count(revenue) FROM first)", "0"),
    ("cast_to_datetime", "order_date", "r1", "r1", "(SELECT count(order_date) FROM first)", "0"),
    ("drop_future_dates", "order_date", "r1", "r2", "0", "0"),
    ("drop_negative_rows", "quantity", "r2", "r3", "0", "0"),
    ("cap_outliers_iqr", "price", "r3", "r3",
     f"(SELECT count(*) FROM third WHERE price <> {capped('third')})", "0"),
    ("fill_median", "price", "r3", "r3", "(SELECT count(*) FROM fourth WHERE price IS NULL)", "0"),
    ("drop_empty_columns", None, "r3", "r3", "0", "1"),
)
ORACLES["plan_outcomes"] = (
    f"WITH dirty_sales AS ({DIRTY_SQL}), {_CLEAN}, r AS (SELECT (SELECT count(*) FROM dirty_sales) AS r0, "
    "(SELECT count(*) FROM first) AS r1, (SELECT count(*) FROM second WHERE order_date IS NULL OR "
    f"order_date <= TIMESTAMP '{AS_OF}') AS r2, (SELECT count(*) FROM third) AS r3) " + union(
        f"SELECT CAST({place} AS INTEGER) AS position, '{fix}' AS fix_id, "
        f"{f"'{c}'" if c else 'CAST(NULL AS VARCHAR)'} AS \"column\", CAST({before} AS BIGINT) AS rows_before, "
        f"CAST({after} AS BIGINT) AS rows_after, CAST({before} - {after} AS BIGINT) AS rows_dropped, "
        f"CAST({changed} AS BIGINT) AS values_changed, CAST({dropped} AS BIGINT) AS columns_dropped FROM r"
        for place, (fix, c, before, after, changed, dropped) in enumerate(_OUTCOMES, start=1)
    )
)

dirty("column_samples", union(
    f"SELECT '{c}' AS \"column\", string_agg(v, '|' ORDER BY row_id, k NULLS FIRST, v) AS sample FROM "
    f"(SELECT row_id, order_id AS k, {c} AS v FROM dirty_sales WHERE {c} IS NOT NULL "
    f"ORDER BY row_id, order_id NULLS FIRST, {c} LIMIT 5)" for c in TEXT if c != "unnamed_0"))

ORACLES["quoted_csv"] = (
    f"SELECT doc_id, CASE WHEN text NOT IN {NULL_TOKENS} THEN text END AS text, lang, source, n_chars FROM documents"
)
ORACLES["folder_of_layouts"] = """
    SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS DOUBLE) AS nation, CAST(s_acctbal AS DOUBLE) AS balance,
      CAST(NULL AS VARCHAR) AS segment FROM supplier
    UNION ALL SELECT c_custkey, 'Заказчик ' || c_name, NULL, CAST(c_acctbal AS DOUBLE), c_mktsegment FROM customer
    UNION ALL SELECT n_nationkey, n_name || chr(10) || n_regionkey, NULL, NULL, NULL FROM nation
"""
ORACLES["file_layouts"] = """
    SELECT * FROM (VALUES ('utf-8', ',', 4::INTEGER, false), ('cp1251', ';', 4, false), ('utf-8', chr(9), 2, true))
      AS t(encoding, separator, n_columns, quoted_line_breaks)
"""

# Column, shape, format, and which orders have it.
SPELLINGS = (
    ("named_date", "%2 %B %Y", "%d %B %Y", "o_orderkey % 5 = 0 AND month(o_orderdate) <> 5"),
    ("named_date", "%2 %b %Y", "%d %b %Y", "o_orderkey % 5 = 0 AND month(o_orderdate) = 5"),
    ("named_date", "%2-%b-%2", "%d-%b-%y", "o_orderkey % 5 = 1"),
    ("named_date", "%b %2, %Y", "%b %d, %Y", "o_orderkey % 5 = 2"),
    ("named_date", "%8", "%Y%m%d", "o_orderkey % 5 = 3"),
    ("named_date", None, None, "o_orderkey % 5 = 4"),
    ("short_date", "%2/%2/%2", "%m/%d/%y", "true"),
    ("clock_date", "%2.%2.%Y %2:%2 %p", "%d.%m.%Y %I:%M %p", "o_orderkey % 3 < 2"),
    ("clock_date", "%2.%2.%Y %2:%2:%2 %p", "%d.%m.%Y %I:%M:%S %p", "o_orderkey % 3 = 2"),
    ("zoned_date", "%Y-%2-%2T%2:%2:%2.%f%z", "%Y-%m-%dT%H:%M:%S.%f%z", "true"),
)


def zoned(c: str) -> str:
    return rf"regexp_replace({c}, 'Z$', '+00:00')"


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


ORACLES["date_shapes"] = f"WITH t AS (SELECT *, o_orderdate FROM ({derived_sql(SPELLED)}) JOIN orders USING (o_orderkey)) " + (
    "SELECT * FROM (" + union(
        f"SELECT '{c}' AS \"column\", {_text(s)} AS shape, {_text(f)} AS date_format, count(*) AS n_values, "
        f"count({f'try_strptime({zoned(c)}, {_text(f)})' if f else 'NULL'}) AS n_parsed FROM t WHERE {where}"
        for c, s, f, where in SPELLINGS
    ) + ") WHERE n_values > 0"
)
_DAY = "date_trunc('day', o_orderdate)"
ORACLES["spelled_dates"] = (
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN {_DAY}::TIMESTAMP END AS named_date, "
    f"{_DAY}::TIMESTAMP AS short_date, {_DAY} + CASE o_orderkey % 3 WHEN 0 THEN INTERVAL '00:05:00' "
    f"WHEN 1 THEN INTERVAL '12:05:00' ELSE INTERVAL '19:08:09' END AS clock_date, "
    f"{_DAY} + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL '04:38:09.25' ELSE INTERVAL '07:08:09.25' END AS zoned_date "
    "FROM orders"
)
ORACLES["unreadable_column"] = (
    "SELECT * REPLACE (CASE WHEN \"check\" = 'column_types' THEN value + 1 ELSE value END AS value) "
    f"FROM ({ORACLES['validate_report']}) "
    "UNION ALL SELECT 'Error', 'unreadable', 'broken', 'WARNING', CAST(0 AS DOUBLE)"
)
ORACLES["revalidated_plan"] = ORACLES["clean_then_validate"]

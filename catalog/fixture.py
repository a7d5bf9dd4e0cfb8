"""Tables that the queries run on, all derived from the whole given tables.

``dirty_sales`` plants every kind of defect into ``orders``. The expressions are
plain enough to mean the same in Spark and in DuckDB, so both sides share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2026-01-01"

# Name and defining expression of each column over ``orders``.
DIRTY = {
    "row_id": "o_orderkey",
    "order_id": (
        "CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 53 = 0 THEN 'A1' "
        "WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey AS STRING) "
        "ELSE concat('A', CAST(o_orderkey AS STRING)) END"
    ),
    "customer_id": "o_custkey",
    "product_id": "o_orderkey % 400",
    "category": (
        "CASE WHEN o_orderkey % 6 = 0 THEN ' toys' WHEN o_orderkey % 6 = 1 THEN 'Toys' "
        "WHEN o_orderkey % 6 = 2 THEN 'BOOKS' WHEN o_orderkey % 6 = 3 THEN 'books' "
        "WHEN o_orderkey % 6 = 4 THEN 'n/a' ELSE 'Garden' END"
    ),
    "payment_method": (
        "CASE WHEN o_orderkey % 19 = 0 THEN '-' WHEN o_orderkey % 2 = 0 THEN 'Credit Card' "
        "ELSE 'cash' END"
    ),
    "quantity": (
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN -1.0E0 "
        "ELSE CAST(o_orderkey % 50 + 1 AS DOUBLE) END"
    ),
    "price": (
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 200 = 1 THEN 0.0E0 "
        "WHEN o_orderkey % 50 = 2 THEN 100000.0E0 "
        "ELSE CAST(o_orderkey % 200 AS DOUBLE) / 4 + 1 END"
    ),
    "discount": (
        "CAST(o_orderkey % 5 AS DOUBLE) * 5 "
        "+ CASE WHEN o_orderkey % 500 = 4 THEN 100 ELSE 0 END"
    ),
    "total_amount": (
        "CAST(o_orderkey % 50 + 1 AS DOUBLE) * (CAST(o_orderkey % 200 AS DOUBLE) / 4 + 1) "
        "* CASE WHEN o_orderkey % 37 = 0 THEN 2 ELSE 1 END"
    ),
    "revenue": (
        "concat('$', CAST(o_orderkey % 9 AS STRING), ',', "
        "CAST(100 + o_orderkey % 900 AS STRING), '.50')"
    ),
    "order_date": (
        "CASE WHEN o_orderkey % 13 = 0 THEN 'not a date' "
        "WHEN o_orderkey % 41 = 0 THEN '2199-01-01' "
        "WHEN o_orderkey % 43 = 0 THEN '1975-06-01' "
        "ELSE substring(CAST(o_orderdate AS STRING), 1, 10) END"
    ),
    "unnamed_0": "CAST(NULL AS STRING)",
}
# The rows that are appended twice for some of the orders.
REPEATED = DIRTY | {
    "order_id": "concat('A', CAST(o_orderkey AS STRING))",
    "category": "'Garden'",
    "payment_method": "'cash'",
    "quantity": "1.0E0",
    "price": "1.0E0",
    "discount": "0.0E0",
    "total_amount": "1.0E0",
    "revenue": "'$1,100.50'",
    "order_date": "'2001-02-03'",
}
WHERE_REPEATED = "o_orderkey % 500 = 3"

COLUMNS = tuple(DIRTY)

# Orders with dates spelled out in several ways, as text.
DATED = {
    "o_orderkey": "o_orderkey",
    "order_date": "substring(CAST(o_orderdate AS STRING), 1, 10)",
    "slash_date": (
        "concat(substring(CAST(o_orderdate AS STRING), 9, 2), '/', "
        "substring(CAST(o_orderdate AS STRING), 6, 2), '/', "
        "substring(CAST(o_orderdate AS STRING), 1, 4))"
    ),
    "stamp_time": (
        "CASE WHEN o_orderkey % 4 = 0 THEN concat(substring(CAST(o_orderdate AS STRING), 1, 10), "
        "' 07:08:09') ELSE concat(substring(CAST(o_orderdate AS STRING), 1, 10), 'T23:59:01') END"
    ),
}

_YEAR, _MONTH, _DAY = (
    f"substring(CAST(o_orderdate AS STRING), {at}, {size})" for at, size in ((1, 4), (6, 2), (9, 2))
)
_NAMES = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
)


def _named_month(length: int) -> str:
    cases = " ".join(f"WHEN '{i:02}' THEN '{name[:length]}'" for i, name in enumerate(_NAMES, start=1))
    return f"CASE {_MONTH} {cases} END"


# Order dates in spellings that no known format reads; the clock has noon and midnight.
SPELLED = {
    "o_orderkey": "o_orderkey",
    "named_date": (
        f"CASE o_orderkey % 5 WHEN 0 THEN concat({_DAY}, ' ', {_named_month(9)}, ' ', {_YEAR}) "
        f"WHEN 1 THEN concat({_DAY}, '-', upper({_named_month(3)}), '-', substring({_YEAR}, 3, 2)) "
        f"WHEN 2 THEN concat({_named_month(3)}, ' ', {_DAY}, ', ', {_YEAR}) "
        f"WHEN 3 THEN concat({_YEAR}, {_MONTH}, {_DAY}) ELSE concat('week ', {_DAY}) END"
    ),
    "short_date": f"concat({_MONTH}, '/', {_DAY}, '/', substring({_YEAR}, 3, 2))",
    "clock_date": (
        f"concat({_DAY}, '.', {_MONTH}, '.', {_YEAR}, CASE o_orderkey % 3 WHEN 0 THEN ' 12:05 AM' "
        "WHEN 1 THEN ' 12:05 pm' ELSE ' 07:08:09 PM' END)"
    ),
    "zoned_date": (
        f"concat({_YEAR}, '-', {_MONTH}, '-', {_DAY}, 'T07:08:09.250', "
        "CASE WHEN o_orderkey % 2 = 0 THEN '+02:30' ELSE 'Z' END)"
    ),
}

# Orders moved to the first day of their month: many dates, few days.
MONTHLY = {
    "o_orderkey": "o_orderkey",
    "month_date": "CAST(concat(substring(CAST(o_orderdate AS STRING), 1, 7), '-01') AS DATE)",
}

# Text as a reader meets it, with tokens for missing values.
TOKENS = {
    "o_orderkey": "o_orderkey",
    "raw": (
        "CASE o_orderkey % 12 WHEN 0 THEN '' WHEN 1 THEN 'NA' WHEN 2 THEN 'N/A' "
        "WHEN 3 THEN 'null' WHEN 4 THEN 'Null' WHEN 5 THEN 'nan' WHEN 6 THEN '-' "
        "WHEN 7 THEN '<NA>' WHEN 8 THEN 'na' WHEN 9 THEN 'None' WHEN 10 THEN '#N/A' "
        "ELSE o_orderpriority END"
    ),
}
TYPED = {
    "whole": "CAST(o_orderkey AS STRING)",
    "whole_gap": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END",
    "decimal": "concat(CAST(o_custkey AS STRING), '.25')",
    "flag": "CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'false' END",
    "flag_gap": (
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'True' "
        "ELSE 'false' END"
    ),
    "word": "o_orderpriority",
    "mixed": "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS STRING) ELSE 'x1d' END",
    "empty": "CAST(NULL AS STRING)",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The same rows spread evenly over the tasks of the session, for work that is costly per
    row: a file is read by no more tasks than it has row groups, however many rows they hold."""
    tasks = 3 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(tasks, df.rdd.getNumPartitions()))


def _expressions(columns: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in columns.items()]


def derived(spark: SparkSession, folder: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(*_expressions(columns))


def spelled(spark: SparkSession, folder: str) -> DataFrame:
    """SPELLED, whose columns go through many regular expressions."""
    return dealt(table(spark, folder, "orders")).selectExpr(*_expressions(SPELLED))


def dirty_sales(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    repeated = (
        orders.where(WHERE_REPEATED)
        .withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
        .selectExpr(*_expressions(REPEATED))
    )
    return orders.selectExpr(*_expressions(DIRTY)).unionAll(repeated)


def derived_sql(columns: dict[str, str]) -> str:
    return f"SELECT {', '.join(_expressions(columns))} FROM orders"


DIRTY_SQL = (
    f"{derived_sql(DIRTY)} UNION ALL SELECT {', '.join(_expressions(REPEATED))} "
    f"FROM orders, (SELECT 1 AS k UNION ALL SELECT 2) WHERE {WHERE_REPEATED}"
)

"""Duplicate rows, duplicate keys, and keys that map to several values."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from gritsieve.functions.text import count_where, ident, literal
from gritsieve.operators.values import union

# Row fingerprints that may be broadcast: 8 bytes each, 8 MB in all.
BROADCAST_FINGERPRINTS = 1_000_000
# Rows so few that shuffling them whole costs less than a second pass.
FEW_ROWS = 1_000_000


def surplus_rows(df: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """One row, ``n_duplicates``: occurrences after the first; nulls are equal.

    Equal rows meet in the partial aggregate of their task, so a heavily repeated
    row is one record per task in the shuffle.
    """
    columns = map(ident, df.columns if key is None else key)
    return (
        df.groupBy(*columns)
        .agg(F.expr("count(1) AS copies"))
        .selectExpr("coalesce(sum(copies - 1), 0) AS n_duplicates")
    )


def _fingerprint(df: DataFrame) -> str:
    return f"xxhash64({', '.join(map(ident, df.columns))})"


def repeated_fingerprints(df: DataFrame) -> DataFrame:
    """64-bit row hashes that occur more than once: a superset of the duplicates."""
    return (
        df.selectExpr(f"{_fingerprint(df)} AS fingerprint")
        .groupBy("fingerprint")
        .agg(F.expr("count(1) AS copies"))
        .where("copies > 1")
        .select("fingerprint")
    )


def duplicate_rows(
    df: DataFrame, rows: int | None = None, bound: int = BROADCAST_FINGERPRINTS
) -> DataFrame:
    """``surplus_rows`` of whole rows without shuffling whole rows.

    Only 8-byte fingerprints are shuffled first. Rows whose fingerprint is unique
    are certainly unique; the few others are compared in full, so a hash
    collision cannot change the count. With more repeated fingerprints than
    ``bound`` the full rows are grouped instead, and nothing is broadcast. A table
    known to have few ``rows`` is grouped right away.
    """
    if rows is not None and rows <= FEW_ROWS:
        return surplus_rows(df)
    repeated = repeated_fingerprints(df).persist()
    try:
        found = repeated.limit(bound + 1).count()
        if found > bound:
            return surplus_rows(df)
        schema = "fingerprint bigint"
        suspects = df.sparkSession.createDataFrame(repeated.toArrow(), schema)
    finally:
        repeated.unpersist()
    if found == 0:
        return df.sparkSession.range(1).selectExpr("0L AS n_duplicates")
    hashed = df.selectExpr("*", f"{_fingerprint(df)} AS `row fingerprint`")
    same = F.expr("`row fingerprint` = fingerprint")
    return surplus_rows(
        hashed.join(F.broadcast(suspects), same, "left_semi").drop("row fingerprint")
    )


def key_summary(
    df: DataFrame, categories: Mapping[str, Sequence[str]], hashable: Collection[str] = ()
) -> DataFrame:
    """(column, n_distinct, links): what grouping by each key column shows at once.

    ``links`` lists, per category asked for, how many keys have more than one
    distinct value of it. Null keys and null categories are ignored.

    Each key column is shuffled once, in its own type, after partial aggregation: a
    hot key is one record per task. Whether a key has several categories shows in
    the smallest and largest hash of its categories, given that the hash keeps the
    values of that column apart (``hashable``); otherwise values are counted, which
    takes a second shuffle.
    """
    return union([_one_key(df, key, found, hashable) for key, found in categories.items()])


def _one_key(
    df: DataFrame, key: str, categories: Sequence[str], hashable: Collection[str]
) -> DataFrame:
    several = []
    for i, name in enumerate(categories):
        if name in hashable:
            value = f"CAST({ident(name)} AS STRING)"
            hashed = f"CASE WHEN {value} IS NOT NULL THEN xxhash64({value}) END"
            several.append(f"min({hashed}) < max({hashed}) AS several_{i}")
        else:
            several.append(f"count(DISTINCT {ident(name)}) > 1 AS several_{i}")
    groups = df.where(f"{ident(key)} IS NOT NULL").groupBy(ident(key))
    grouped = groups.agg(*map(F.expr, several)) if several else groups.agg(F.expr("1 AS present"))
    links = ", ".join(
        f"struct({literal(name)} AS category, {count_where(f'several_{i}')} AS n_keys)"
        for i, name in enumerate(categories)
    )
    return grouped.selectExpr(
        f"{literal(key)} AS `column`",
        "count(1) AS n_distinct",
        f"CAST(array({links}) AS array<struct<category: string, n_keys: bigint>>) AS links",
    )


def multi_valued_keys(
    df: DataFrame, categories: Mapping[str, Sequence[str]], hashable: Collection[str] = ()
) -> DataFrame:
    """(column, category, n_keys): keys with more than one value of a category."""
    return key_summary(df, categories, hashable).selectExpr("`column`", "inline(links)")
